"""Streams over files: the newest wins, cancelled requests never run."""

import json

from spanveil.streaming import requests


def test_admitted(spark, tmp_path):
    rows = [("o", "c", "1", "cancel", 1), ("o", "c", "1", "scan", 2), ("o", "c", "2", "scan", 1), ("o", "c", "2", "cancel", 3), ("o", "c", "3", "scan", 1), ("o", "c", "3", "scan", 2)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("owner", "client", "request", "kind", "ts"), r, strict=True))) for r in rows))
    events = spark.readStream.schema("owner string, client string, request string, kind string, ts long").json(str(tmp_path / "in"))
    q = requests.admitted(events).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = sorted((r.request, r.outcome) for r in spark.table("admitted").collect())
    assert out == [("1", "CANCELLED"), ("2", "RUN"), ("3", "INVALID_INPUT"), ("3", "RUN")]


def streamed(spark, folder, schema, rows):
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    return spark.readStream.schema(schema).json(str(folder))


def test_newest_of_a_stream(spark, tmp_path):
    rows = [{"k": "a", "ts": f"2024-01-01T00:00:0{i}", "v": v} for i, v in ((1, "x"), (3, "y"), (2, "z"))] + [{"k": "b", "ts": "2024-01-01T00:00:01", "v": "w"}]
    events = streamed(spark, tmp_path / "in", "k string, ts timestamp, v string", rows)
    q = requests.newest(events, "1 minute", "k", "ts").writeStream.format("memory").queryName("newest").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.table("newest").collect()) == [("a", "y"), ("b", "w")]


def test_decisions_meet_requests(spark, tmp_path):
    asked = streamed(spark, tmp_path / "asked", "session string, ts timestamp", [{"session": s, "ts": "2024-01-01T00:00:00"} for s in ("one", "two", "three")])
    made = streamed(spark, tmp_path / "made", "session string, decided_at timestamp", [{"session": "one", "decided_at": "2024-01-01T00:05:00"}, {"session": "two", "decided_at": "2024-01-01T00:20:00"}, {"session": "three", "decided_at": "2023-12-31T23:59:00"}, {"session": "four", "decided_at": "2024-01-01T00:01:00"}])
    q = requests.reviewed(asked, made).writeStream.format("memory").queryName("reviewed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.session for r in spark.table("reviewed").collect()] == ["one"]


def test_newest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, ts long, v string")
    assert sorted((r.k, r.v) for r in requests.newest_batch(df, "k", ["ts"]).collect()) == [("a", "y"), ("b", "w")]
    batch = spark.createDataFrame([("1", 5), ("2", 6), ("2", 6)], "request string, x int")
    sent = spark.createDataFrame([("1",)], "request string")
    assert [r.request for r in requests.once_per_request(batch, sent).collect()] == ["2"]
