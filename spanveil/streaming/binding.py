"""Work that is bound to a conversation: a result is written back only where nothing has moved since its work began.

Events of a tab: start binds a work to the address and conversation of its event; move says where the tab is now; finish
asks whether the work's result may be written. Any move between the two ends it for good, away and back as well; so does a
finish elsewhere. Owners come from what the transport says of a sender, never from a message.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from ..operators.messages import owner_key

EVENTS = "tab long, seq long, ts timestamp, kind string, work string, url string, conversation string"
VERDICTS = "tab long, work string, verdict string"
LASTS_MS = 600_000


class Tab(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "work string", "url string, conversation string, moved boolean, ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.ts, r.seq)):
            now = int(r.ts.timestamp() * 1000)
            if r.kind == "start":
                self.open.updateValue((r.work,), (r.url, r.conversation, False, now + LASTS_MS))
                self.handle.registerTimer(now + LASTS_MS)
            elif r.kind == "move":
                for work, (url, conversation, _, ends) in [(k, v) for k, v in self.open.iterator()]:
                    self.open.updateValue(tuple(work), (url, conversation, True, ends))
            else:
                bound = self.open.getValue((r.work,)) if self.open.containsKey((r.work,)) else None
                if bound:
                    self.open.removeKey((r.work,))
                yield Row(tab=r.tab, work=r.work, verdict=self._verdict(bound, r, now))

    @staticmethod
    def _verdict(bound, r, now: int) -> str:
        if bound is None or bound[3] <= now:
            return "unknown"
        if bound[2]:
            return "moved"
        return "write" if (bound[0], bound[1]) == (r.url, r.conversation) else "elsewhere"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for work in [tuple(k) for k, v in self.open.iterator() if v[3] <= expiredTimerInfo.getExpiryTimeInMs()]:
            self.open.removeKey(work)
        return iter(())


def verdicts(events: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """A verdict for every finish of EVENTS."""
    return events.withWatermark("ts", watermark).groupBy("tab").transformWithState(Tab(), VERDICTS, "append", "EventTime")


def verdicts_batch(events: DataFrame) -> DataFrame:
    """The same over a table, where no work outlasts its time: by running counts of a tab's moves, one sort."""
    w = Window.partitionBy("tab").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("tab", "work").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    moves = events.withColumn("_moves", F.sum((F.col("kind") == "move").cast("long")).over(w)).filter("kind <> 'move'")
    before = moves.withColumn("_at", F.last(F.struct("kind", "url", "conversation", "_moves")).over(own)).filter("kind = 'finish'")
    there = F.col("_at.url").eqNullSafe(F.col("url")) & F.col("_at.conversation").eqNullSafe(F.col("conversation"))
    verdict = F.when(~F.coalesce(F.col("_at.kind") == "start", F.lit(False)), "unknown").when(F.col("_at._moves") < F.col("_moves"), "moved").when(there, "write").otherwise("elsewhere")
    return before.select("tab", "work", "seq", verdict.alias("verdict"))


def own_sender(sender: Column | str, own: str) -> Column:
    """Whether the transport's sender is the installation itself."""
    return (F.col(sender) if isinstance(sender, str) else sender).eqNullSafe(F.lit(own))


def routed(messages: DataFrame, own: str, target: str, background: str) -> DataFrame:
    """messages(sender, context, tab, frame, document, url, claimed, ...) that the target may take, with owner.

    The background derives owners from the sender and drops what a message claims. Other targets take only what the
    background passes on: no tab, its own address if any, and an owner named by it.
    """
    mine = messages.filter(own_sender("sender", own))
    if target == "background":
        return mine.withColumn("owner", owner_key("sender", "context", "tab", "frame", "document", "url")).drop("claimed")
    passed = F.col("claimed").isNotNull() & F.col("tab").isNull() & (F.coalesce(F.col("url"), F.lit(background)) == background)
    return mine.filter(passed).withColumnRenamed("claimed", "owner")
