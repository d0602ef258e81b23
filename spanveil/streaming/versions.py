"""Preferences as a stream: every question gets the version that was in force at its time, in whatever order events come.

Saves and questions of a user meet in one state. A question waits until the watermark has passed it, so a save that
comes after it but is older still counts; of saves at one time the greatest value counts. Saves that a newer one
replaced before every open question are forgotten. What is later than the watermark is dropped by Spark.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

EVENTS = "user string, ts timestamp, question string, version string"
ANSWERS = "user string, question string, version string"


class Versions(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.saved = handle.getMapState("saved", "at long", "version string")
        self.asked = handle.getMapState("asked", "question string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            at = round(r.ts.timestamp() * 1e6)
            if r.question is None:
                if not self.saved.containsKey((at,)) or self.saved.getValue((at,))[0] < r.version:
                    self.saved.updateValue((at,), (r.version,))
                self.handle.registerTimer(at // 1000 + 1)
            else:
                self.asked.updateValue((r.question,), (at,))
                self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        saves = sorted((k[0], v[0]) for k, v in self.saved.iterator())
        times, asks = [t for t, _ in saves], sorted((v[0], k[0]) for k, v in self.asked.iterator())
        for at, question in asks:
            if at < now:
                place = bisect_right(times, at)
                self.asked.removeKey((question,))
                yield Row(user=key[0], question=question, version=saves[place - 1][1] if place else None)
        for at in times[: max(0, bisect_right(times, now - 1) - 1)]:  # none of them is the last before what may still come
            self.saved.removeKey((at,))


def in_force(saves: DataFrame, questions: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """questions(user, ts, question) with the version of saves(user, ts, version); null before the first. Both are streams."""
    none = F.lit(None).cast("string")
    both = saves.select("user", "ts", none.alias("question"), "version").unionByName(questions.select("user", "ts", "question", none.alias("version")))
    return both.withWatermark("ts", watermark).groupBy("user").transformWithState(Versions(), ANSWERS, "append", "EventTime")
