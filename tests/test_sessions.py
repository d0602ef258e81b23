"""Stateful streams: sessions, requests, reviews with a deadline, versions, bound work, sinks."""

import base64
import datetime as dt
import itertools
import json
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spanveil.operators import messages
from spanveil.streaming import binding, desk, requests, sessions, sinks, versions

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
FAR = 10**7


def at(seconds):
    return (START + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


@pytest.fixture
def rocks(spark):
    """The state store that map state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


names = (f"t{i}" for i in itertools.count())


def run(spark, folder, schema, batches, make):
    """make(stream) over files, one micro-batch each; the rows of all."""
    source, name = folder / "in", next(names)
    source.mkdir(exist_ok=True)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    for i, rows in enumerate(batches):
        (source / f"{i:04d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(source / f"{i:04d}.json", (1e9 + i, 1e9 + i))  # files are taken in order of their times
    query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name).collect()


class Lines:
    """A reader of files of lines, for the tests."""

    def __init__(self, content):
        if content.startswith(b"%"):
            raise ValueError("encrypted")
        self.lines = content.decode().split("\n")
        self.segments = [SimpleNamespace(segment_id=str(i), text=t) for i, t in enumerate(self.lines)]

    def masked(self, masks):
        out = [list(t) for t in self.lines]
        for i, spans in masks.items():
            for a, b in spans:
                out[int(i)][a:b] = "#" * (b - a)
        return "\n".join(map("".join, out)).encode()


def b64(x):
    return base64.b64encode(x).decode()


def test_document_sessions(rocks, tmp_path):
    seq = itertools.count()

    def op(op, session="s", owner="o", host="h", t=None, **more):
        k = next(seq)
        return {"host": host, "owner": owner, "session": session, "kind": "docx", "op": op, "seq": k, "ts": at(k if t is None else t), **more}

    masks = [{"segment_id": "1", "spans": [{"start": 0, "stop": 3}]}]
    whole = [op("begin"), op("append", data=b64(b"one\ntw")), op("append", data=b64(b"o three")), op("open"), op("rebuild", masks=masks), op("read", offset=0), op("read", offset=10), op("close"), op("read", offset=0)]
    order = [op("begin", "a"), op("open", "a"), op("begin", "a"), op("begin", "a"), op("append", "b", data=b64(b"x")), op("begin", "c", kind="zip"), op("close", "nothing")]
    bad = [op("begin", "d"), op("append", "d", data=b64(b"%x")), op("open", "d"), op("begin", "d"), op("append", "d", data="x" * 100), op("read", "d", offset=0)]
    scoped = [op("begin", "s", "p"), op("append", "s", "p", data=b64(b"p")), op("append", "s", "q", data=b64(b"q")), op("open", "s", "p"), op("close", "s", "p")]
    many = [op("begin", f"m{i}", host="h2") for i in range(9)]
    late = [op("append", "a", t=900, data=b64(b"x")), op("begin", "m8", host="h2", t=901)]
    batches = [whole[:3], whole[3:5], whole[5:], order, bad, scoped, many, late]
    found = {r.seq: r for r in run(rocks, tmp_path, sessions.OPERATIONS, batches, lambda s: sessions.answers(s, {"docx": Lines}, limits={"piece": 10}))}
    assert len(found) == sum(map(len, batches))
    text = lambda rows: [found[r["seq"]].code or "ok" for r in rows]
    assert text(whole) == ["ok"] * 8 + ["DOCUMENT_SESSION"]
    assert [s.text for s in found[3].segments] == ["one", "two three"] and found[4].size == 13
    assert base64.b64decode(found[5].data) + base64.b64decode(found[6].data) == b"one\n### three"
    assert text(order) == ["ok", "DOCUMENT_FAILED", "ok", "DOCUMENT_LIMIT", "DOCUMENT_SESSION", "DOCUMENT_FAILED", "ok"]
    assert text(bad) == ["ok", "ok", "DOCUMENT_FORMAT", "ok", "DOCUMENT_FAILED", "DOCUMENT_SESSION"]
    assert text(scoped) == ["ok", "ok", "DOCUMENT_SESSION", "ok", "ok"]
    assert text(many) == ["ok"] * 8 + ["DOCUMENT_LIMIT"]
    assert text(late) == ["DOCUMENT_SESSION", "ok"]


def told(rows):
    """Messages by a Desk of its own, in order."""
    d = desk.Desk({}, {}, 0, False, 1)
    for kind, request, seq, t, *more in rows:
        d.take(kind, ("c", request), seq, t * 1000, *more)
    return [(s[1], s[2], s[3], s[4]) for s in d.steps]


def test_requests_one_by_one():
    run_, done = (lambda r, s: (r, s, "run", None)), (lambda r, s, c=None: (r, s, "answer", c))
    assert told([("cancel", "a", 1, 1), ("scan", "a", 2, 2), ("scan", "a", 3, 3)]) == [done("a", 2, "CANCELLED"), run_("a", 3)]
    assert told([("scan", "a", 1, 1), ("cancel", "a", 2, 2), ("done", "a", 3, 3, None, 1), ("cancel", "a", 4, 4)]) == [run_("a", 1), ("a", 1, "abort", None), done("a", 1, "CANCELLED")]
    assert told([("scan", "a", 1, 1), ("done", "a", 2, 2, None, 1), ("cancel", "a", 3, 3), ("scan", "a", 4, 4)]) == [run_("a", 1), done("a", 1), run_("a", 4)]
    assert told([("scan", "a", 1, 1), ("scan", "a", 2, 1), ("failed", "a", 3, 2, None, 1, "OUT_OF_MEMORY")]) == [run_("a", 1), done("a", 2, "INVALID_INPUT"), done("a", 1, "OUT_OF_MEMORY")]
    assert told([("scan", "a", 1, 1), ("scan", "b", 2, 1), ("cancel", "b", 3, 2), ("done", "a", 4, 3, None, 1)]) == [run_("a", 1), done("b", 2, "CANCELLED"), done("a", 1)]
    assert told([("scan", "a", 1, 1, 5000), ("scan", "b", 2, 2), ("init", "i", 3, 60)]) == [run_("a", 1), ("a", 1, "abort", None), done("a", 1, "INFERENCE_FAILED"), run_("b", 2), run_("i", 3)]
    assert told([("init", "i", 1, 1), ("cancel", "i", 2, 2), ("done", "i", 3, 3, None, 1)]) == [run_("i", 1), done("i", 1)]
    assert told([("scan", "a", 1, 1), ("dispose", "", 2, 2), ("scan", "b", 3, 3), ("cancel", "b", 4, 4)]) == [run_("a", 1), ("a", 1, "abort", None), done("a", 1, "MODEL_NOT_READY"), done("b", 3, "MODEL_NOT_READY")]
    assert told([("cancel", "a", 1, 1), ("scan", "a", 2, 700)]) == [run_("a", 2)]
    old = [("cancel", str(i), i, 1) for i in range(513)]
    assert told([*old, ("scan", "0", 900, 2), ("scan", "1", 901, 3)]) == [run_("0", 900), done("1", 901, "CANCELLED")]


def test_requests_replay(rocks, tmp_path):
    """The stream in batches of any size says what the messages say one by one, and every request has one answer."""
    rng, rows = random.Random(3), []
    for seq in range(300):
        kind = rng.choice(["scan", "scan", "scan", "cancel", "done", "failed", "init"])
        rows.append({"owner": f"o{seq % 2}", "client": "c", "request": str(rng.randrange(8)), "kind": kind, "seq": seq, "ts": at(seq * 7), "wait_ms": 40_000, "run": seq - rng.randrange(1, 12)})
    asked = [r for r in rows if r["kind"] in ("scan", "init")]
    rows.append({"owner": "end", "client": "c", "request": "", "kind": "cancel", "seq": 999, "ts": at(FAR)})
    want = []
    for owner in ("o0", "o1"):
        d = desk.Desk({}, {}, 0, False, 1)
        for r in rows:
            if r["owner"] == owner:
                d.take(r["kind"], (r["client"], r["request"]), r["seq"], round(dt.datetime.fromisoformat(r["ts"]).timestamp() * 1000), r["wait_ms"], r["run"])
        d.time_out(10**15)
        want += [(owner, *s) for s in d.steps]
    for k, size in enumerate((11, 150)):
        (tmp_path / str(k)).mkdir()
        batches = [rows[i : i + size] for i in range(0, len(rows), size)] + [[rows[-1] | {"ts": at(FAR + 10_000)}]]
        got = [tuple(r) for r in run(rocks, tmp_path / str(k), desk.MESSAGES, batches, desk.steps)]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    answers = [r[3] for r in want if r[4] == "answer"]
    assert sorted(answers) == sorted(r["seq"] for r in asked)


def test_reviews_have_one_outcome(spark, tmp_path):
    schema = "kind string, review string, t timestamp, status string"
    asked = [{"kind": "ask", "review": f"r{i}", "t": at(i)} for i in range(6)]
    made = [("r0", 5, "approved"), ("r0", 6, "cancelled"), ("r1", 17, "approved"), ("r2", 16, "approved"), ("r9", 5, "approved"), ("r4", 10, "approved"), ("r4", 10, "approved")]
    made = [{"kind": "made", "review": r, "t": at(t), "status": s} for r, t, s in made]
    end = [[{"kind": k, "review": f"end{j}", "t": at(FAR * (j + 1))} for k in ("ask", "made")] for j in range(3)]

    def make(s):
        asks = s.filter("kind = 'ask'").select("review", F.col("t").alias("ts"))
        return requests.settled(asks, s.filter("kind = 'made'").select("review", F.col("t").alias("decided_at"), "status"))

    got = run(spark, tmp_path, schema, [asked, asked[:2] + made, *end], make)
    found = sorted((r.review, r.status, round(r.at.astimezone(dt.UTC).timestamp() - START.timestamp())) for r in got if r.review.startswith("r"))
    assert found == [("r0", "approved", 5), ("r1", "cancelled", 16), ("r2", "approved", 16), ("r3", "cancelled", 18), ("r4", "approved", 10), ("r5", "cancelled", 20)]


def test_versions_in_any_order(rocks, tmp_path):
    rng = random.Random(8)
    rows = [{"user": f"u{rng.randrange(3)}", "ts": at(rng.randrange(50)), **({"version": f"v{i:03d}"} if rng.random() < 0.4 else {"question": f"q{i}"})} for i in range(150)]
    saves = rocks.createDataFrame([(r["user"], r["ts"], r["version"]) for r in rows if "version" in r], "user string, ts string, version string").groupBy("user", "ts").agg(F.max("version").alias("version"))
    asks = rocks.createDataFrame([(r["user"], r["ts"], r["question"]) for r in rows if "question" in r], "user string, ts string, question string")
    want = {(r.user, r.question, r.version) for r in messages.as_of(asks, saves, "user", "ts", "version").collect()}
    for k in range(2):
        rng.shuffle(rows)
        (tmp_path / str(k)).mkdir()
        batches = [*(rows[i : i + 40] for i in range(0, 150, 40)), [{"user": "end", "ts": at(FAR), "question": "end"}], [{"user": "end", "ts": at(2 * FAR), "question": "last"}]]
        make = lambda s: versions.in_force(s.filter("version is not null").select("user", "ts", "version"), s.filter("question is not null").select("user", "ts", "question"))
        got = {tuple(r) for r in run(rocks, tmp_path / str(k), versions.EVENTS, batches, make)}
        assert {r for r in got if r[0] != "end"} == want


def test_bound_work(rocks, tmp_path):
    seq = itertools.count()
    e = lambda kind, work=None, url="u", conversation="c", tab=1, t=None: {"tab": tab, "seq": (k := next(seq)), "ts": at(k if t is None else t), "kind": kind, "work": work, "url": url, "conversation": conversation}
    rows = [e("start", "a"), e("finish", "a"), e("finish", "a"), e("start", "b"), e("move", url="v"), e("move"), e("finish", "b"), e("start", "c"), e("finish", "c", url="v"), e("start", "d"), e("finish", "d", conversation=None), e("start", "e", conversation=None), e("finish", "e", conversation=None), e("start", "f"), e("move", tab=2), e("finish", "f"), e("finish", "f", tab=2)]
    want = [(1, "a", "write"), (1, "a", "unknown"), (1, "b", "moved"), (1, "c", "elsewhere"), (1, "d", "elsewhere"), (1, "e", "write"), (1, "f", "write"), (2, "f", "unknown")]
    got = run(rocks, tmp_path, binding.EVENTS, [rows[:5], rows[5:]], binding.verdicts)
    assert sorted(tuple(r) for r in got) == sorted(want)
    table = rocks.createDataFrame([tuple(r.values()) for r in rows], "tab long, seq long, ts string, kind string, work string, url string, conversation string")
    assert sorted((r.tab, r.work, r.verdict) for r in binding.verdicts_batch(table).collect()) == sorted(want)


def test_routes(spark):
    schema = "n int, sender string, context string, tab long, frame long, document string, url string, claimed string"
    rows = [(1, "ext", None, 7, 0, "d", "https://x", "forged"), (2, "other", None, 7, 0, "d", "https://x", None), (3, "ext", None, None, None, None, "bg.js", "owner"), (4, "ext", None, None, None, None, "https://x", "owner"), (5, "ext", None, 7, 0, "d", "bg.js", "owner"), (6, "ext", None, None, None, None, None, None), (7, None, None, 1, 0, "d", "u", "o")]
    df = spark.createDataFrame(rows, schema)
    owners = {r.n: r.owner for r in binding.routed(df, "ext", "background", "bg.js").collect()}
    assert set(owners) == {1, 3, 4, 5, 6} and "forged" not in owners[1] and owners[1] == owners[5] != owners[3]
    assert {r.n: r.owner for r in binding.routed(df, "ext", "offscreen", "bg.js").collect()} == {3: "owner"}


def test_ledger_after_a_crash(spark, tmp_path):
    sent, fail = [], [True]

    def send(rows):
        sent.extend(r.request for r in rows.collect())
        if fail.pop():
            raise OSError("lost")

    ledger = sinks.Ledger(f"file://{tmp_path}/ledger", send)
    one, two = (spark.createDataFrame([(x,) for x in xs], "request string") for xs in ("aab", "bc"))
    with pytest.raises(OSError, match="lost"):
        ledger(one, 0)
    fail[:] = [False] * 9
    for frame, number in ((one, 0), (one, 0), (two, 1), (two, 1), (one, 2)):
        ledger(frame, number)
    assert sorted(sent) == ["a", "a", "b", "b", "c"]  # the batch that failed within send() is sent again, no other is


def test_settings(spark, tmp_path):
    path = f"file://{tmp_path}/settings"
    assert sinks.load_settings(spark, path) is None
    frame = lambda v: spark.createDataFrame([("PHONE", v)], "type string, policy string")
    assert [sinks.save_settings(frame(v), path) for v in ("a", "b")] == [1, 2]
    (tmp_path / "settings" / "000000003").mkdir()
    frame("half").write.parquet(f"{path}/000000003/rows-x")
    assert sinks.load_settings(spark, path).first().policy == "b"
    assert sinks.save_settings(frame("c"), path) == 4 and sinks.load_settings(spark, path).first().policy == "c"
