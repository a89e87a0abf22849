"""The landed_lines and subtitles formats: whole reads whatever the split, conditions, streams, round trips."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from clipmetrics.sources import formats, landed, subtitles

GOOD = [{"bvid": f"BV{i}", "title": "标题" * (i % 5), "like_count": i % 7, "url": None if i % 3 else "https://v.example.com/x"} for i in range(60)]


def land(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as out:
        out.write("\n".join(lines))


@pytest.fixture
def folder(tmp_path):
    lines = [json.dumps(r, ensure_ascii=bool(i % 2)) for i, r in enumerate(GOOD)]
    land(tmp_path / "in", "a.jsonl", lines[:37] + ["", "not json", "[1]", '"text"', '{"bvid": 5, "like_count": "7", "view_count": true}\r'])
    land(tmp_path / "in", "b.jsonl", lines[37:])
    land(tmp_path / "in", "_hidden", lines)
    land(tmp_path / "in", "empty.jsonl", [])
    return str(tmp_path / "in")


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_every_line_once_whatever_the_split(spark, folder, split):
    formats.register_formats(spark)
    rows = spark.read.format("landed_lines").option("split_bytes", split).load(folder).orderBy("file", "at").collect()
    assert [r.bvid for r in rows if r.bvid] == [g["bvid"] for g in GOOD]
    odd = [r for r in rows if r.bvid is None]
    assert len(odd) == 1 and odd[0].like_count is None and odd[0].view_count is None
    assert [(r.title, r.url) for r in rows if r.bvid] == [(g["title"], g["url"]) for g in GOOD]


@pytest.mark.parametrize("condition", ["like_count >= 3", "like_count = 3 and url is not null", "bvid in ('BV1', 'BV38', 'nothing')", "like_count <> 3", "url is null", "like_count < 2 or bvid = 'BV5'", "title like '%题' and like_count <= 4", "like_count in (1, null)"])
def test_conditions_keep_their_meaning(spark, folder, condition):
    formats.register_formats(spark)
    read = lambda: spark.read.format("landed_lines").load(folder)
    plain = spark.createDataFrame(read().collect(), read().schema)
    assert sorted(read().where(condition).collect(), key=str) == sorted(plain.where(condition).collect(), key=str)


def test_conditions_are_answered_by_the_reader(spark, folder):
    plan = landed.read_landed_lines(spark, folder, "k", F.col("like_count") >= 3)._jdf.queryExecution().executedPlan().toString()
    assert "(like_count" not in plan.split("BatchScan")[0]  # no filter on it is left to Spark


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert landed.read_landed_lines(spark, str(tmp_path / "none"), "k").count() == 0
    assert subtitles.read_subtitles(spark, str(tmp_path / "none")).count() == 0


def test_landed_lines_as_a_stream(spark, folder, tmp_path):
    formats.register_formats(spark)
    stream = spark.readStream.format("landed_lines").option("settle_seconds", 0).load(folder).where("bvid is not null").select("bvid")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).start()
    try:
        query.processAllAvailable()
        time.sleep(0.05)
        land(folder, "c.jsonl", [json.dumps({"bvid": "late"})])
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.bvid for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted([g["bvid"] for g in GOOD] + ["late"])


CUES = "video_id string, ord long, start_s double, end_s double, text string"


def test_subtitles_round_trip(spark, tmp_path):
    """Keys with slashes, dots and spaces; many videos in few files; a video over several archives."""
    names = ["a/b", "..", "x y", "视频", "v.1"]
    rows = [(names[i % 5], i, float(i), i + 0.5, f"text {i}\nmore") for i in range(200)] + [("long", i, float(i), i + 0.5, "w" * 50) for i in range(3000)]
    path = str(tmp_path / "out")
    subtitles.write_subtitles(spark.createDataFrame(rows, CUES), path)
    back = subtitles.read_subtitles(spark, path).orderBy("video", "part", "block_no").collect()
    want = sorted((v, s, e, t.replace("\n", " ")) for v, _, s, e, t in rows)
    assert sorted((r.video, r.start_s, r.end_s, r.text) for r in back) == want
    assert [r.start_s for r in back if r.video == "long"] == [float(i) for i in range(3000)]
    assert 1 <= len(os.listdir(path)) <= 8


def test_members_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "MEMBER_BYTES", 100)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"video": ["v"] * 50, "part": list(range(1, 51)), "content": ["c" * 30] * 50})
    writer = formats.SubtitleWriter(str(tmp_path / "out"))
    done = writer.write(iter([batch]))
    assert formats._listed(str(tmp_path / "out")) == []  # nothing is seen before the commit
    writer.commit([done, None, formats.Archived(None)])
    schema = pa.schema([("video", pa.string()), ("part", pa.int64()), ("content", pa.string())])
    reader = formats.SubtitleReader(str(tmp_path / "out"), schema)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["part"] for r in rows] == list(range(1, 51, 4)) and sum(r["content"].count("c") for r in rows) == 1500


def test_failed_writes_leave_nothing_visible(tmp_path):
    import pyarrow as pa
    writer = formats.SubtitleWriter(str(tmp_path / "out"))
    done = writer.write(iter([pa.RecordBatch.from_pydict({"video": ["v"], "part": [1], "content": ["c"]})]))
    writer.abort([done, None])
    assert os.listdir(tmp_path / "out") == []


def test_plain_subtitle_files_are_read_too(spark, tmp_path):
    land(tmp_path / "in" / "deep", "clip.one.srt", ["1", "00:00:01,000 --> 00:00:02,000", "hello"])
    rows = subtitles.read_subtitles(spark, str(tmp_path / "in")).collect()
    assert [(r.video, r.start_s, r.text) for r in rows] == [("deep/clip.one", 1.0, "hello")]
