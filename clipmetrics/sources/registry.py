"""Source plug-ins: anything that turns a table of phrases into candidate rows."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics.operators.candidates import union_sources
from clipmetrics.functions.text import strip
from clipmetrics.operators.jobs import search_mode
from clipmetrics.operators.search import fan_out, limit_per_phrase, phrase_matches, with_phrases
from clipmetrics.params import expansion_limit, search_limit


class Source(Protocol):
    """A source has a name, says whether it can be used and searches many phrases at once."""

    name: str

    def available(self) -> str | None:
        """None when usable, else the reason."""

    def search(self, phrases: DataFrame, limit: int) -> DataFrame:
        """phrases(phrase_id, phrase) to candidate rows with phrase_id."""


_SOURCES: dict[str, Source] = {}


def register(source: Source) -> None:
    _SOURCES[source.name.strip().lower()] = source


def names() -> list[str]:
    return sorted(_SOURCES)


class LandedSource:
    """A source over candidates already landed as a table: its search is phrase matching on some of their texts."""

    def __init__(self, name: str, candidates: DataFrame, columns: tuple[str, ...] = ("title",)) -> None:
        self.name = name
        self.candidates = candidates
        self.columns = columns

    def available(self) -> str | None:
        return None

    def search(self, phrases: DataFrame, limit: int) -> DataFrame:
        texts = self.candidates.select("seq", F.concat_ws("\n", *self.columns).alias("_said"))
        hits = phrase_matches(texts, ["seq"], "_said", phrases)
        found = hits.join(self.candidates, "seq").withColumn("source", F.lit(self.name))
        return limit_per_phrase(found.withColumn("search_source", F.col("phrase")), limit)


def search_request(
    spark: SparkSession, topic: str, wanted: list[str], limit: int = 0, mode: str = "keyword", expand: bool = True,
    groups: list[tuple[list[str], list[str]]] | None = None,
) -> tuple[DataFrame | None, dict[str, str]]:
    """Candidates of one request from all wanted sources, and the reason of every source that could not be used.

    The topic is expanded to phrases (in keyword mode), each goes to every source, and each source returns its first
    query_limit rows. An empty list wants every registered source.
    """
    request = spark.createDataFrame([(topic, wanted or names(), search_limit(limit), mode)], "topic string, sources array<string>, limit int, mode string")
    alone = F.array(strip(F.col("topic")))
    if expand:
        phrased = with_phrases(request, "topic", expansion_limit(0), groups)
        phrased = phrased.withColumn("phrases", F.when(search_mode(F.col("mode")) == "channel", alone).otherwise(F.col("phrases")))
    else:
        phrased = request.withColumn("phrases", alone)
    parts, errors = [], {}
    calls: dict[str, list] = {}
    for call in fan_out(phrased, names()).orderBy("source", "phrase_no").collect():  # a request's few phrases and sources
        calls.setdefault(call.source, []).append(call)
    for name, asked in calls.items():
        reason = asked[0].error or _SOURCES[name].available()
        if reason:
            errors[name] = reason
            continue
        phrases = spark.createDataFrame([(str(c.phrase_no), c.phrase) for c in asked], "phrase_id string, phrase string")
        parts.append(_SOURCES[name].search(phrases, asked[0].query_limit))
    return (union_sources(*parts) if parts else None), errors


def search_all(wanted: list[str], phrases: DataFrame, limit: int) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the wanted sources' rows and the reason of every source that could not be used."""
    parts, errors = [], {}
    for name in dict.fromkeys(w.strip().lower() for w in wanted if w.strip()):
        source = _SOURCES.get(name)
        reason = "unknown source" if source is None else source.available()
        if reason:
            errors[name] = reason
        else:
            parts.append(source.search(phrases, limit))
    return (union_sources(*parts) if parts else None), errors
