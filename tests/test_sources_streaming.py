"""File sources, sinks and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from hewn.sources import files, sinks
from hewn.streaming import events


def test_json_sources(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"variant": "a", "question_id": "q1", "qa": 0.5}\nnot json\n{"variant": null, "question_id": "q2", "qa": 1}\n{"variant": "b", "question_id": "q1", "qa": null}\n')
    assert [(r.variant, r.qa) for r in files.metrics(spark, str(p), "qa").collect()] == [("a", 0.5)]
    a = tmp_path / "a.json"
    a.write_text(json.dumps({"annotations": [{"annotator_id": "x", "file_path": "f", "relevance_score": 4}, {"annotator_id": None, "file_path": "f", "relevance_score": 1}]}, indent=1))
    assert [r.relevance_score for r in files.annotations(spark, str(a)).collect()] == [4]
    (tmp_path / "r1.jsonl").write_text('{"system": "s", "budget": 1, "qa_score": 0.25}\n')
    assert files.results(spark, str(tmp_path / "r*.jsonl")).first().qa_score == 0.25


def test_repository_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x = 'é'\n")
    (tmp_path / "b.pyc").write_bytes(b"\0\1")
    (tmp_path / "big.txt").write_text("y" * 200)
    got = files.repository(spark, str(tmp_path), 100).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.py"] and got[0].content == "x = 'é'\n"


PATCH = "diff --git a/x.py b/x.py\nnew file mode 1\n--- /dev/null\n+++ b/x.py\n+one\n+two\ndiff --git a/y.py b/z.py\nrename from y.py\n--- a/y.py\n+++ b/z.py\n-old\n+new\n"


def test_diffs(spark):
    d = files.diffs(spark.createDataFrame([(1, PATCH), (2, None), (3, "")], "patch_id int, patch string"))
    assert sorted((r.file_path, r.change_type, r.additions, r.deletions) for r in d.collect()) == [("x.py", "added", 2, 0), ("z.py", "renamed", 1, 1)]
    s = spark.createDataFrame([("x.py", 0.9)], "file_path string, score double")
    assert [r.file_path for r in files.relevant_diffs(d, s, 0.5).collect()] == ["x.py"]
    assert files.relevant_diffs(d, s, 0.0, most_lines=2).filter("file_path = 'x.py'").first().diff.count("\n") == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 2, "b<.py", "x & y"), ("p", 1, "a.py", None)], "pack_id string, position int, path string, content string")
    got = {r.position: r.s for r in df.select("position", sinks.section(F.col("path"), F.col("content"), "html").alias("s")).collect()}
    assert got[2] == "<section><h2>b&lt;.py</h2><pre>x &amp; y</pre></section>" and got[1].endswith("<pre></pre></section>")
    for form in ("json", "markdown", "plain", "xml"):
        sinks.write_pack(df, str(tmp_path / form), form)
        assert spark.read.text(str(tmp_path / form)).count() >= 2
    for form in ("csv", "json", "parquet"):
        sinks.export(df, str(tmp_path / f"e{form}"), form)
    assert spark.read.parquet(str(tmp_path / "eparquet")).count() == 2
    with pytest.raises(ValueError):
        sinks.section(F.col("path"), F.col("content"), "pdf")


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", u, k, 1.0) for i, (h, m, u, k) in enumerate([(0, 5, 1, "view"), (0, 10, 1, "error"), (0, 20, 1, "view"), (2, 0, 1, "view"), (0, 40, 2, "view"), (9, 0, 2, "view")])]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double")
    df = df.select("event_id", F.to_timestamp("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    return events.source(spark, path, df.schema), tmp_path


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def test_windows_and_sessions(spark, stream):
    got = run(spark, events.windowed(stream[0]), "w1")
    assert {(r.start.hour, r.event_type, r.n) for r in got} >= {(0, "view", 3), (0, "error", 1), (2, "view", 1)}
    s = run(spark, events.sessions(stream[0]), "s1")
    assert {(r.user_id, r.n) for r in s} >= {(1, 3), (1, 1), (2, 1)}


def test_bans_and_metric_store(spark, stream):
    got = {r.event_id: r.banned for r in run(spark, events.bans(stream[0]), "b1")}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False}
    out = str(stream[1] / "store")
    events.append_metrics(stream[0], out, str(stream[1] / "ck")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 6 and os.path.isdir(out)
