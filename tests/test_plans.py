"""Shape of the physical plans: no pairing of everything with everything, no window in a single task."""

from __future__ import annotations

import re

import pytest

from clipmetrics.operators import candidates, ranking, search
from clipmetrics.params import SearchFilters
from clipmetrics.plans import adapters, catalogue

SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in catalogue.queries() if not n.startswith("st_"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_or_global_windows(spark, name):
    plan = plan_of(catalogue.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name != "json_line_files":  # numbers one row per file block
        assert not re.search(r"Window \[.*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan)
    assert "BatchEvalPython" not in plan  # row-at-a-time Python


def test_bounded_rankings_shrink_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(catalogue.queries()["rank_multi_query"](spark, SF))
    assert "WindowGroupLimit" in plan_of(catalogue.queries()["phrase_search_topk"](spark, SF))
    assert "TakeOrderedAndProject" in plan_of(catalogue.queries()["trend_topn"](spark, SF))


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(candidates.merge_candidates(adapters.event_hits(spark, SF)).select("video_id", "likes"))
    read = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert "props" not in read and "event_type" not in read


def test_filters_reach_the_scan(spark):
    kept = candidates.filter_candidates(adapters.table(spark, SF, "orders").withColumnRenamed("o_totalprice", "likes"), SearchFilters(min_likes=1000), adapters.now())
    assert "1000" in re.search(r"DataFilters: \[([^\]]*)", plan_of(kept)).group(1)


def test_few_needles_search_texts_where_they_are_read(spark):
    docs = adapters.table(spark, SF, "documents")
    phrases = adapters.table(spark, SF, "benchmark").selectExpr("item_id as phrase_id", "text as phrase")
    plan = plan_of(search.phrase_matches(docs, ["doc_id"], "text", phrases))
    searches = re.findall(r"MapInArrow(.*?)FileScan parquet", plan, re.S)
    assert len(searches) == 1 and "Exchange" not in searches[0]


def test_many_needles_are_joined_with_the_texts(spark):
    """Neither side of a join is broadcast by hand, and the texts are read twice whatever the number of needles."""
    docs = adapters.table(spark, SF, "documents")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what Spark itself finds small is its own affair
    for copies in (1, 50):
        phrases = adapters.table(spark, SF, "benchmark").crossJoin(spark.range(copies)).selectExpr("id as phrase_id", "concat(text, id) as phrase")
        plan = plan_of(search.phrase_matches(docs, ["doc_id"], "text", phrases, 0))
        assert "BroadcastExchange" not in plan and len(re.findall(r"FileScan parquet \[doc_id", plan)) == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


@pytest.mark.parametrize("name", ["trend_topn", "rank_sort_modes", "rank_multi_query"])
def test_ranking_merges_once(spark, name):
    """Rows and maxima come from the written candidates; no source table is read again and none is merged twice."""
    plan = plan_of(catalogue.queries()[name](spark, SF))
    assert "documents.parquet" not in plan and "events.parquet" not in plan and "candidates-" in plan


def test_pages_are_not_joined_with_their_links(spark):
    assert "Join" not in plan_of(catalogue.queries()["page_video_ids"](spark, SF))


def test_single_query_maxima_are_a_subquery(spark):
    from pyspark.sql import functions as F

    plan = plan_of(ranking.score(adapters.hits(spark, SF), F.lit("word"), adapters.now()))
    assert "Subquery" in plan and "Join" not in plan


def test_workers_can_import_the_package(spark):
    from pathlib import Path

    import clipmetrics

    root = str(Path(clipmetrics.__file__).resolve().parents[1])
    assert root in spark.sparkContext.environment["PYTHONPATH"].split(":")


def test_rows_are_not_dealt_by_query_for_its_maxima(spark):
    """The maxima of each query are written, so that their size is known and their rows are sent to the candidates."""
    plan = plan_of(catalogue.queries()["rank_multi_query"](spark, SF))
    assert "maxima-" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
