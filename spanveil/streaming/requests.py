"""Requests as streams: the newest wins, cancelled ones never run, decisions meet their requests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.policy import latest

KEYS = ["owner", "client", "request"]
TTL_MS = 600_000
OUTPUT = "owner string, client string, request string, outcome string"


def newest(events: DataFrame, watermark: str, key: str, ts: str) -> DataFrame:
    """A stream's newest event of each key, updated as events come; late ones beyond the watermark are dropped."""
    rest = [c for c in events.columns if c != key]
    timed = events.withWatermark(ts, watermark)
    return timed.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("x")).select(key, "x.*")


def newest_batch(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    return latest(events, key, order)


def _admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    """One request's state: cancelled beforehand, or already seen; both are forgotten after the time to live.

    A cancel that comes before its scan is used up by the first scan. A second scan of a known request is
    invalid. A cancel after a scan changes nothing.
    """
    if state.hasTimedOut:
        state.remove()
        return
    seen, cancelled = state.get if state.exists else (False, False)
    rows = pd.concat(list(batches)).sort_values(["ts", "kind"], kind="stable")
    out = []
    for kind in rows["kind"]:
        if kind == "cancel":
            cancelled = cancelled or not seen
        elif cancelled:
            out.append("CANCELLED")
            seen, cancelled = True, False
        else:
            out.append("INVALID_INPUT" if seen else "RUN")
            seen = True
    state.update((seen, cancelled))
    state.setTimeoutDuration(TTL_MS)
    if out:
        yield pd.DataFrame([(*key, x) for x in out], columns=[*KEYS, "outcome"])


def admitted(events: DataFrame) -> DataFrame:
    """events(owner, client, request, kind in scan/cancel, ts) to the outcome of every scan."""
    return events.groupBy(*KEYS).applyInPandasWithState(_admit, OUTPUT, "seen boolean, cancelled boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def reviewed(requests: DataFrame, decisions: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Stream-stream join of requests(session, ts) with the decisions(session, decided_at) that follow in time."""
    r, d = requests.withWatermark("ts", within), decisions.withWatermark("decided_at", within)
    on = (r["session"] == d["session"]) & (d["decided_at"] >= r["ts"]) & (d["decided_at"] <= r["ts"] + F.expr(f"INTERVAL {within}"))
    return r.join(d, on).drop(d["session"])


def settled(requests: DataFrame, decisions: DataFrame, deadline: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Every one of requests(review, ts, ...) once, with status and at: as its first decision(review, decided_at, status) within
    the deadline says, cancelled at the deadline where there is none. Both are streams; decisions after it change nothing."""
    r = requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["review"])
    d = decisions.select(F.col("review").alias("_review"), "decided_at", "status").withWatermark("decided_at", late).dropDuplicatesWithinWatermark(["_review"])
    end = F.col("ts") + F.expr(f"INTERVAL {deadline}")
    on = (F.col("review") == F.col("_review")) & (F.col("decided_at") >= F.col("ts")) & (F.col("decided_at") <= end)
    both = r.join(d, on, "leftOuter")
    return both.select(*requests.columns, F.coalesce("status", F.lit("cancelled")).alias("status"), F.coalesce("decided_at", end).alias("at"))


def once_per_request(batch: DataFrame, sent: DataFrame, key: str = "request") -> DataFrame:
    """Rows of a micro-batch that no earlier one has sent: an idempotent sink's filter."""
    return batch.dropDuplicates([key]).join(sent.select(key), key, "left_anti")
