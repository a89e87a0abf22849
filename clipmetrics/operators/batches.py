"""Text batches for a user-supplied transformer: context, calls, checks, bisection of failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmetrics import rules
from clipmetrics.functions import text
from clipmetrics.functions.text import strip
from clipmetrics.operators.ordered import row_numbers, with_slices
from clipmetrics.params import PackingParams
from clipmetrics.session import written

Transformer = Callable[[list[dict], dict], object]


def context_batches(segments: DataFrame, params: PackingParams = PackingParams(), slice_rows: float = 600.0) -> DataFrame:
    """segments(video_id, ord, start_s, text) to batches with neighbours: items, before, after per (video, batch).

    Every row is sent to the batch it belongs to and to those it is context of; a group never exceeds
    the batch plus its context, whatever the length of the video.
    """
    numbered = row_numbers(with_slices(segments, F.col("start_s"), slice_rows), ["video_id"], ["start_s", "ord"], "rn")
    at = F.col("rn") - 1
    own = F.floor(at / params.batch_size)
    first, last = F.floor((at - params.context) / params.batch_size), F.floor((at + params.context) / params.batch_size)
    sent = numbered.withColumn("own", own).withColumn("batch_no", F.explode(F.sequence(F.greatest(F.lit(0), first), last)))
    item = F.struct("rn", F.col("ord").alias("id"), strip("text").alias("text"))
    part = lambda cond: F.array_sort(F.collect_list(F.when(cond, item)))
    grouped = sent.groupBy("video_id", "batch_no").agg(
        part(F.col("own") == F.col("batch_no")).alias("items"), part(F.col("own") < F.col("batch_no")).alias("before"),
        part(F.col("own") > F.col("batch_no")).alias("after"),
    )
    # a video's last rows may point at a batch that does not exist
    return grouped.where(F.size("items") > 0)


def normalize_response(response: object, items: list[dict]) -> dict[int, str]:
    """Loose answers (object, list, strings, alternative keys) as id to text; raises when nothing usable is left."""
    if isinstance(response, dict):
        response = response["translations"] if "translations" in response else [response] if "id" in response else None
    if isinstance(response, (str, dict)):
        response = [response]
    if not isinstance(response, list):
        raise ValueError("response must contain a list")
    aligned = len(response) == len(items)
    texts: dict[int, str] = {}
    for position, entry in enumerate(response):
        fields = {"text": entry} if isinstance(entry, str) else entry
        if not isinstance(fields, dict):
            raise ValueError("response item must be an object or a string")
        key = fields.get("id")
        if key is None:
            if not aligned:
                raise ValueError("response item has no id")
            key = items[position]["id"]
        value = next((fields[k] for k in ("text", "vi", "translation") if fields.get(k) is not None), "")
        if str(value).strip():
            texts[int(key)] = str(value).strip()
    if not texts:
        raise ValueError("response has no usable text")
    return texts


ANSWERS = "video_id string, batch_no long, part string, id long, text string, error string"


def transform_batches(batches: DataFrame, transformer: Transformer) -> DataFrame:
    """Call the transformer once per batch inside the tasks: one row per answered id, or one error row per batch."""
    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            rows = []
            for b in frame.itertuples(index=False):
                items = [{"id": int(i["id"]), "text": i["text"]} for i in b.items]
                context = {"before": [c["text"] for c in b.before], "after": [c["text"] for c in b.after]}
                try:
                    answers = normalize_response(transformer(items, context), items)
                    rows += [(b.video_id, b.batch_no, b.part, i, t, None) for i, t in answers.items()]
                except Exception as error:  # the transformer is foreign code: any failure marks the batch
                    rows.append((b.video_id, b.batch_no, b.part, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["video_id", "batch_no", "part", "id", "text", "error"]).astype({"id": "Int64"})

    ready = batches if "part" in batches.columns else batches.withColumn("part", F.lit(""))
    fields = ready.select(F.col("video_id").cast("string"), F.col("batch_no").cast("long"), "part", "items", "before", "after")
    return fields.mapInPandas(call, ANSWERS)


def with_bisection(batches: DataFrame, transformer: Transformer, script: str = rules.HAN, batch_size: int = 10) -> DataFrame:
    """Answers for every item it can get: failed, incomplete or untranslated batches are halved until single items.

    One Spark job per round and at most log2(batch size) + 2 rounds; each round is written to the shared
    folder, so a lost executor does not repeat earlier calls.
    """
    open_ = batches.select(F.col("video_id").cast("string").alias("video_id"), F.col("batch_no").cast("long").alias("batch_no"),
                           F.lit("").alias("part"), "items", "before", "after")
    done: DataFrame | None = None
    for _ in range(batch_size.bit_length() + 2):
        keys = ["video_id", "batch_no", "part"]
        answers = written(transform_batches(open_, transformer), "answers")
        source = open_.select(*keys, F.explode("items").alias("i")).select(*keys, F.col("i.id").alias("id"), F.col("i.text").alias("source_text"))
        checked = source.join(answers.where(F.col("error").isNull()).drop("error"), [*keys, "id"], "left")
        bad = F.col("text").isNull() | text.looks_untranslated(F.col("source_text"), F.col("text"), script)
        checked = written(checked.withColumn("bad", bad), "checked")
        failed = checked.groupBy(*keys).agg(F.bool_or("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
        good = checked.join(failed.where(~F.col("bad")).select(*keys), keys, "left_semi").select("video_id", "id", "text", F.lit(None).cast("string").alias("error"))
        single = failed.where(F.col("bad") & (F.col("n") == 1)).select(*keys)
        lost = checked.join(single, keys, "left_semi").select("video_id", "id", F.lit(None).cast("string").alias("text"), F.lit("no translation").alias("error"))
        done = good.unionByName(lost) if done is None else done.unionByName(good).unionByName(lost)
        again = open_.join(failed.where(F.col("bad") & (F.col("n") > 1)).select(*keys), keys, "left_semi")
        half = F.greatest(F.lit(1), F.floor(F.size("items") / 2)).cast("int")
        left = again.withColumns({"part": F.concat("part", F.lit("0")), "items": F.slice("items", F.lit(1), half)})
        right = again.withColumns({"part": F.concat("part", F.lit("1")), "items": F.slice("items", half + 1, F.size("items"))})
        open_ = written(left.unionByName(right), "open")
        if open_.isEmpty():
            break
    return done


def attach_translations(segments: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments with their non-empty translation, segments the transformer left out)."""
    usable = answers.where(strip(F.coalesce(F.col("text"), F.lit(""))) != "").select("video_id", F.col("id").alias("ord"), strip("text").alias("translation"))
    return segments.join(usable, ["video_id", "ord"]), segments.join(usable, ["video_id", "ord"], "left_anti")


def untranslated(pairs: DataFrame, script: str = rules.HAN) -> DataFrame:
    """pairs(id, source_text, target_text) whose target still is the source script."""
    return pairs.where(text.looks_untranslated(F.col("source_text"), F.col("target_text"), script))


def bad_id_lists(pairs: DataFrame, batch: Column, script: str = rules.HAN) -> DataFrame:
    """Rejected ids per batch, comma separated in id order (a batch has a bounded number of items)."""
    rejected = untranslated(pairs, script).groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rejected.select("batch", F.size("ids").alias("n_bad"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("bad_ids"))
