"""Scan requests as a stream: every one has exactly one answer, whatever is cancelled, late, doubled or never done.

Messages of an owner: scan and init ask, cancel takes a request back, done and failed report a run (by its number, the
seq of the message that asked), dispose ends the service. At most ``slots`` scans run at once, others wait in order; one
that is cancelled while it waits never runs. A cancel may come before its scan; then it is remembered, among the last 512
settled requests of the owner, for ten minutes. A request that is not answered in time is answered as failed. All
times are event times, so a replay of the stream gives the same answers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

MESSAGES = "owner string, client string, request string, kind string, seq long, ts timestamp, wait_ms long, run long, code string"
STEPS = "owner string, client string, request string, seq long, step string, code string"
REMEMBERED, LASTS_MS = 512, 600_000
QUEUED, RUNNING, LOADING = "queued", "running", "loading"


class Desk:
    """One owner's open requests {key: (seq, phase, deadline)} and settled ones {key: (cancelled, expires, place)}."""

    def __init__(self, pending: dict, settled: dict, places: int, disposed: bool, slots: int):
        self.pending, self.settled, self.places, self.disposed, self.slots = pending, settled, places, disposed, slots
        self.steps: list[tuple] = []

    def say(self, key: tuple, seq: int, step: str, code: str | None = None) -> None:
        self.steps.append((*key, seq, step, code))

    def remember(self, key: tuple, cancelled: bool, now: int) -> None:
        self.settled = {k: v for k, v in self.settled.items() if v[1] > now and k != key}
        self.places += 1
        self.settled[key] = (cancelled, now + LASTS_MS, self.places)
        for old in sorted(self.settled, key=lambda k: self.settled[k][2])[: max(0, len(self.settled) - REMEMBERED)]:
            del self.settled[old]

    def finish(self, key: tuple, code: str | None, now: int, reported: bool = False) -> None:
        seq, phase, _ = self.pending.pop(key)
        if phase == RUNNING and not reported:
            self.say(key, seq, "abort")
        self.remember(key, False, now)
        self.say(key, seq, "answer", code)

    def fill(self) -> None:
        running = sum(1 for p in self.pending.values() if p[1] == RUNNING)
        waiting = sorted((p[0], k) for k, p in self.pending.items() if p[1] == QUEUED)
        for seq, key in waiting[: max(0, self.slots - running)]:
            self.pending[key] = (seq, RUNNING, self.pending[key][2])
            self.say(key, seq, "run")

    def time_out(self, now: int) -> None:
        for deadline, key in sorted((p[2], k) for k, p in self.pending.items() if p[2] <= now):
            self.finish(key, "INFERENCE_FAILED", deadline)
            self.fill()

    def take(self, kind: str, key: tuple, seq: int, now: int, wait_ms: int | None = None, run: int | None = None, code: str | None = None) -> None:
        self.time_out(now)
        known = self.settled.get(key)
        known = known if known and known[1] > now else None
        if kind == "dispose":
            for open_ in sorted(self.pending, key=lambda k: self.pending[k][0]):
                self.finish(open_, "MODEL_NOT_READY", now)
            self.settled, self.disposed = {}, True
        elif kind in ("scan", "init"):
            if self.disposed:
                self.say(key, seq, "answer", "MODEL_NOT_READY")
            elif key in self.pending:
                self.say(key, seq, "answer", "INVALID_INPUT")
            elif kind == "scan" and known and known[0]:
                self.remember(key, False, now)
                self.say(key, seq, "answer", "CANCELLED")
            else:
                self.pending[key] = (seq, QUEUED if kind == "scan" else LOADING, now + (wait_ms or LASTS_MS))
                if kind == "init":
                    self.say(key, seq, "run")
        elif kind == "cancel" and not self.disposed:
            if key in self.pending:
                if self.pending[key][1] != LOADING:
                    self.finish(key, "CANCELLED", now)
            elif not known:
                self.remember(key, True, now)
        elif kind in ("done", "failed") and key in self.pending and self.pending[key][0] == run and self.pending[key][1] != QUEUED:
            self.finish(key, (code or "INFERENCE_FAILED") if kind == "failed" else None, now, reported=True)
        self.fill()


class Requests(StatefulProcessor):
    def __init__(self, slots: int):
        self.slots = slots

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "client string, request string", "seq long, phase string, deadline long")
        self.settled = handle.getMapState("settled", "client string, request string", "cancelled boolean, expires long, place long")
        self.places = handle.getValueState("places", "places long, disposed boolean")

    def _load(self) -> Desk:
        places, disposed = self.places.get() if self.places.exists() else (0, False)
        self.before = {tuple(k): tuple(v) for k, v in self.pending.iterator()}, {tuple(k): tuple(v) for k, v in self.settled.iterator()}
        return Desk(dict(self.before[0]), dict(self.before[1]), places, disposed, self.slots)

    def _store(self, desk: Desk) -> None:
        """What changed; a timer for each new deadline and each new end of memory."""
        for state, old, new, ends in ((self.pending, self.before[0], desk.pending, 2), (self.settled, self.before[1], desk.settled, 1)):
            for key in old.keys() - new.keys():
                state.removeKey(key)
            for key, value in new.items():
                if old.get(key) != value:
                    state.updateValue(key, value)
                    if key not in old or old[key][ends] != value[ends]:
                        self.handle.registerTimer(value[ends])
        self.places.update((desk.places, desk.disposed))

    @staticmethod
    def _rows(owner: str, desk: Desk) -> Iterator[Row]:
        for client, request, seq, step, code in desk.steps:
            yield Row(owner=owner, client=client, request=request, seq=seq, step=step, code=code)

    def handleInputRows(self, key, rows, timerValues) -> Iterable[Row]:
        desk = self._load()
        for r in sorted(rows, key=lambda r: (r.ts, r.seq)):
            desk.take(r.kind, (r.client, r.request), r.seq, int(r.ts.timestamp() * 1000), r.wait_ms, r.run, r.code)
        self._store(desk)
        return self._rows(key[0], desk)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterable[Row]:
        desk, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        desk.time_out(now)
        desk.settled = {k: v for k, v in desk.settled.items() if v[1] > now}
        self._store(desk)
        return self._rows(key[0], desk)


def steps(messages: DataFrame, slots: int = 1, watermark: str = "10 seconds") -> DataFrame:
    """What to run, what to abort, and the answers (code null: done), of MESSAGES."""
    timed = messages.withWatermark("ts", watermark)
    return timed.groupBy("owner").transformWithState(Requests(slots), STEPS, "append", "EventTime")
