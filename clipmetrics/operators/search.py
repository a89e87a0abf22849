"""Topic expansion, fan-out over sources, phrase search over landed text, source health."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from ahocorasick import Automaton
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clipmetrics import rules
from clipmetrics.functions.text import strip
from clipmetrics.operators import grams
from clipmetrics.operators.jobs import search_mode
from clipmetrics.params import per_query_limit
from clipmetrics.session import written

def with_phrases(df: DataFrame, topic: str, limit: int = 0, groups: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """Add phrases: the topic first, then the terms of all matching groups in binary order; null for a blank topic.

    A positive limit keeps that many phrases; params.expansion_limit gives the limit of a request.

    The lower-cased topic and the found terms are columns of their own, so each is computed once per row.
    """
    none = F.array().cast("array<string>")
    low = df.withColumn("_topic", strip(F.col(topic))).withColumn("_low", F.lower("_topic"))
    terms = []
    for markers, phrases in groups or rules.EXPANSION_RULES:
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains("_low", F.lit(marker))
        terms.append(F.when(hit, F.array(*[F.lit(p.strip()) for p in phrases])).otherwise(none))
    found = low.withColumn("_found", F.concat(*terms))
    keyed = F.transform("_found", lambda t, i: F.struct(F.lower(t).alias("k"), i.alias("i"), t.alias("t")))
    fresh = found.withColumn("_keyed", F.array_sort(F.filter(keyed, lambda p: (p.k != "") & (p.k != F.col("_low")))))
    # sorted by (key, position): the first of equal keys is the first spelling
    first = F.filter("_keyed", lambda p, i: (i == 0) | (F.get(F.col("_keyed"), i - 1).k != p.k))
    ordered = F.concat(F.array("_topic"), F.array_sort(F.transform(first, lambda p: p.t)))
    phrases = F.when(F.col("_topic") != "", F.slice(ordered, 1, limit) if limit > 0 else ordered)
    return fresh.withColumn("phrases", phrases).drop("_topic", "_low", "_found", "_keyed")


def expand_topics(df: DataFrame, topic: str, limit: int = 0) -> DataFrame:
    """One row per phrase: phrase_no from 0, phrase."""
    keep = [c for c in df.columns if c != topic]
    # Exploding an expression, not the bare column: for a column Spark infers a filter on its size and
    # pushes it below the projections, which computes the phrases a second time, all steps inlined.
    phrases = F.filter("phrases", lambda p: p.isNotNull())
    return with_phrases(df, topic, limit).select(*keep, F.posexplode(phrases).alias("phrase_no", "phrase"))


def clean_sources(sources: Column) -> Column:
    """Lower-cased, trimmed, distinct in order; an empty list means every source."""
    names = F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.lower(strip(s)))
    every = F.array(*[F.lit(s) for s in rules.ALL_SOURCES])
    return F.when(F.size(names) == 0, every).otherwise(F.array_distinct(F.filter(names, lambda s: s != "")))


def fan_out(requests: DataFrame, known: list[str] | None = None, public_phrases: int = 3) -> DataFrame:
    """requests(phrases, sources, limit, ...) to one row per (source, phrase); unknown sources become error rows.

    query_limit is what a source may return for a phrase: the request's share of its limit, or in the channel mode of
    an optional column mode a wider set, as creators are told apart afterwards.
    """
    limit = F.col("limit")
    bounded = F.when(limit <= 0, 30).otherwise(F.least(limit, F.lit(100)))
    channel = search_mode(F.col("mode")) == "channel" if "mode" in requests.columns else F.lit(False)
    per_query = F.when(channel, per_query_limit(bounded, F.size("phrases"), True)).otherwise(per_query_limit(bounded, F.size("phrases")))
    one = requests.withColumn("query_limit", per_query.cast("int")).withColumn("source", F.explode(clean_sources(F.col("sources"))))
    is_known = F.col("source").isin(known or rules.ALL_SOURCES)
    public = F.col("source").isin(rules.PUBLIC_SOURCES)
    phrases = F.when(~is_known, F.array(F.lit(None).cast("string")))
    phrases = phrases.when(public, F.slice("phrases", 1, public_phrases)).otherwise(F.col("phrases"))
    rest = [c for c in requests.columns if c not in ("phrases", "sources", "limit")]
    return one.select(
        *rest, "source", "query_limit", F.when(~is_known, "unknown source").alias("error"),
        F.posexplode(phrases).alias("phrase_no", "phrase"),
    )


def phrase_matches(corpus: DataFrame, ids: list[str], text: str, phrases: DataFrame, automaton_bytes: int = 1 << 20) -> DataFrame:
    """phrases(phrase_id, phrase) found in the text of a landed corpus: (ids, phrase_id, phrase).

    Needles of no more than automaton_bytes in all, which is checked, become one multi-pattern automaton that reads
    every text where it lies. More needles are joined with the texts by their rarest gram (operators/grams.py): the
    texts are read a fixed number of times and no needle passes through the driver, however many there are. Only what
    was found meets the phrases again. Blank phrases are found nowhere; a null text holds nothing.
    """
    named = phrases.withColumn("_needle", F.lower(strip(F.col("phrase")))).where(F.col("_needle") != "")
    needles = written(named.select("_needle").distinct(), "needles")
    total = needles.agg(F.sum(F.octet_length("_needle"))).first()[0] or 0
    texts = corpus.select(*ids, F.lower(F.col(text)).alias("_low"))
    if total <= automaton_bytes:
        schema = StructType([*[f for f in texts.schema.fields if f.name != "_low"], StructField("_needle", StringType())])
        wanted = corpus.sparkSession.sparkContext.broadcast([r[0] for r in needles.collect()])  # at most automaton_bytes
        found = texts.mapInArrow(partial(_automaton_hits, wanted), schema)
    else:
        # Rows equal in ids and text have one key; where others share it, the text itself decides.
        keyed = texts.where(F.col("_low").isNotNull()).withColumn("_key", F.xxhash64(*ids, "_low"))
        pairs = grams.candidates(
            keyed.select(F.col("_key").alias("key"), F.col("_low").alias("text")), needles.select(F.col("_needle").alias("needle")))
        pairs = pairs.select(F.col("key").alias("_of"), F.col("needle").alias("_needle"))
        found = keyed.join(pairs, (F.col("_key") == F.col("_of")) & F.contains("_low", "_needle")).select(*ids, "_needle")
    return found.join(named.select("phrase_id", "phrase", "_needle"), "_needle").select(*ids, "phrase_id", "phrase")


def _automaton_hits(wanted: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every text a row per needle in it; the other columns are repeated."""
    automaton = Automaton()
    for needle in wanted.value:
        automaton.add_word(needle, needle)
    automaton.make_automaton()
    for batch in batches:
        rows, needles = [], []
        for row, low in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            seen = {needle for _, needle in automaton.iter(low)} if low and wanted.value else ()
            rows += [row] * len(seen)
            needles += sorted(seen)
        kept = batch.select(batch.schema.names[:-1]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(needles, pa.string())], names=[*kept.schema.names, "_needle"])


def limit_per_phrase(hits: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """First rows of each (source, phrase) in arrival order."""
    order = Window.partitionBy(*(by or ["source", "phrase_id"])).orderBy("seq")
    return hits.withColumn("hit_no", F.row_number().over(order)).where(F.col("hit_no") <= limit)


def source_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def error_summary(runs: DataFrame, shown: int = 2) -> DataFrame:
    """runs(seq, source, keyword, error, n_results): message per source without any success.

    Messages are made distinct before anything is ranked, and the ranking keeps two rows per source.
    """
    message = F.when(F.coalesce(F.col("keyword"), F.lit("")) != "", F.concat_ws(": ", "keyword", "error")).otherwise(F.col("error"))
    per_message = runs.groupBy("source", F.when(F.col("error").isNotNull(), message).alias("message")).agg(
        F.min("seq").alias("first_seq"),
        F.sum(F.when(F.col("error").isNull(), F.coalesce(F.col("n_results"), F.lit(0))).otherwise(0)).alias("successes"),
    )
    totals = per_message.groupBy("source").agg(
        F.sum("successes").alias("successes"), F.count("message").alias("distinct_errors"),
    ).where((F.col("successes") == 0) & (F.col("distinct_errors") > 0))
    order = Window.partitionBy("source").orderBy("first_seq", "message")
    first = per_message.where(F.col("message").isNotNull()).withColumn("k", F.row_number().over(order)).where(F.col("k") <= shown)
    joined = first.groupBy("source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "message"))), lambda m: m.message), " | ").alias("head")
    )
    more = F.col("distinct_errors") - shown
    tail = F.when(more > 0, F.concat(F.lit(" | +"), more.cast("string"), F.lit(" lỗi tương tự"))).otherwise("")
    return totals.join(joined, "source").select("source", "distinct_errors", F.concat("head", tail).alias("summary"))
