"""Streams drained to their end give what the batch operators give."""

import json
import os

from pyspark.sql import functions as F

from quillspark.operators import telemetry
from quillspark.sources import sinks
from quillspark.streaming import telemetry as streams

POINTS = "run_id string, key string, value double, ts timestamp"


def test_windows_and_duplicates(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"run_id": "r", "key": f"k{i % 2}", "value": float(i), "ts": f"2024-01-01T00:{i % 60:02d}:00Z"} for i in range(120)]
    for n in range(4):
        (source / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows[n * 30 : n * 30 + 30]))
    got = []
    stream = streams.windowed(streams.file_stream(spark, str(source), POINTS, 2), "10 minutes", by=["key"], late="2 hours")
    streams.drain(stream, str(tmp_path / "cp"), lambda batch, _: got.append(batch.collect()), "update")
    last = {(r["start"], r["key"]): (r["n"], r["total"]) for batch in got for r in batch}
    batch = spark.read.schema(POINTS).json(str(source))
    assert last == {(r["start"], r["key"]): (r["n"], r["total"]) for r in telemetry.windowed(batch, "10 minutes", by=["key"]).collect()}


def test_active_steps_go_on_across_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = ["a", "Starting validation at step 5", "b", "c", "starting validation at step 9", "d"]
    for n, line in enumerate(lines):
        (source / f"{n}.json").write_text(json.dumps({"run_id": "r", "n": n, "line": line}))
        os.utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    got = {}
    stream = streams.active_steps(streams.file_stream(spark, str(source), "run_id string, n long, line string", 1))
    streams.drain(stream, str(tmp_path / "cp"), lambda batch, _: got.update({r["n"]: r["step"] for r in batch.collect()}))
    assert [got[i] for i in range(6)] == [None, 5, 5, 5, 9, 9]


def test_failed_posts_fall_back(spark, tmp_path):
    def refuse(_rows):
        raise OSError("down")

    sinks.post_batches(refuse, str(tmp_path / "lost"), size=2)(spark.range(5).withColumn("x", F.lit("a")), 3)
    assert spark.read.json(str(tmp_path / "lost")).count() == 5
