"""Document sessions over a stream of operations: begin, append, open, rebuild, read, close.

A host (an installation) holds a few sessions at a time, each under the owner that its sender gives and the name the
client chose. Bytes come in base64 pieces; open() reads them, rebuild() writes the masked file, read() gives it back in
pieces. An operation out of order, a piece that is too large, or whatever the reader refuses closes its session. A session
ends a fixed time after its begin, by event time, so a replay of the stream gives the same answers.

The reading and writing are the caller's: ``openers[kind](content)`` gives an object with ``segments`` (each with
segment_id and text) and ``masked({segment_id: [(start, stop)]})``. State needs the RocksDB provider.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from .. import schemas as S

OPERATIONS = "host string, owner string, session string, seq long, ts timestamp, kind string, op string, data string, offset long, masks array<struct<segment_id:string,spans:array<struct<start:int,stop:int>>>>"
ANSWERS = "host string, owner string, session string, seq long, op string, ok boolean, code string, segments array<struct<segment_id:string,text:string>>, size long, data string"
PHASE = "kind string, size long, pieces int, opened boolean, output long, ends long"
#: Where a session's whole input and its output are kept, beside the numbered pieces.
INPUT, OUTPUT = -1, -2


class Refusal(Exception):
    """What a client is told; the rules of error codes read the text."""


class Session:
    """One session's phase, with its bytes in map state."""

    def __init__(self, name: str, phase: tuple, bytes_of):
        self.name, self.bytes_of = name, bytes_of
        self.kind, self.size, self.pieces, self.opened, self.output, self.ends = phase

    @property
    def phase(self) -> tuple:
        return (self.kind, self.size, self.pieces, self.opened, self.output, self.ends)

    def put(self, part: int, content: bytes) -> None:
        self.bytes_of.updateValue((self.name, part), (content,))

    def get(self, part: int) -> bytes:
        return bytes(self.bytes_of.getValue((self.name, part))[0])

    def forget(self) -> None:
        for part in [*range(self.pieces), INPUT, OUTPUT]:
            if self.bytes_of.containsKey((self.name, part)):
                self.bytes_of.removeKey((self.name, part))

    def append(self, data: str | None, limits: dict) -> dict:
        if self.opened or data is None or len(data) > limits["piece"] * 1.4:
            raise Refusal("Invalid chunk")
        content = base64.b64decode(data, validate=True)
        self.size += len(content)
        if self.size > limits["input_bytes"]:
            raise Refusal("Document input size limit exceeded")
        self.put(self.pieces, content)
        self.pieces += 1
        return {}

    def open(self, opener: Callable[[bytes], Any]) -> dict:
        if self.opened or not self.size:
            raise Refusal("Invalid document open")
        content = b"".join(self.get(k) for k in range(self.pieces))
        found = opener(content)
        self.forget()
        self.put(INPUT, content)
        self.pieces, self.opened = 0, True
        return {"segments": [(p.segment_id, p.text) for p in found.segments]}

    def rebuild(self, opener: Callable[[bytes], Any], masks: list | None, limits: dict) -> dict:
        if not self.opened or self.output is not None:
            raise Refusal("Invalid document operation")
        wanted = {m["segment_id"]: [(s["start"], s["stop"]) for s in m["spans"]] for m in masks or []}
        content = opener(self.get(INPUT)).masked(wanted)
        if len(content) > limits["output_bytes"]:
            raise Refusal("Document output size limit exceeded")
        self.put(OUTPUT, content)
        self.output = len(content)
        return {"size": self.output}

    def read(self, offset: int | None, limits: dict) -> dict:
        if self.output is None or offset is None or not 0 <= offset < self.output:
            raise Refusal("Invalid document operation")
        return {"data": base64.b64encode(self.get(OUTPUT)[offset : offset + limits["piece"]]).decode()}


class Host(StatefulProcessor):
    def __init__(self, openers: dict[str, Callable[[bytes], Any]], most: int = 8, lasts_ms: int = 600_000, limits: dict | None = None):
        self.openers, self.most, self.lasts_ms = openers, most, lasts_ms
        self.limits = {"piece": S.TRANSPORT_BYTES, **S.PACKAGE_LIMITS, **(limits or {})}

    def init(self, handle) -> None:
        self.handle = handle
        self.phases = handle.getMapState("phases", "name string", PHASE)
        self.bytes_of = handle.getMapState("bytes", "name string, part int", "content binary")

    def _close(self, name: str) -> None:
        if self.phases.containsKey((name,)):
            Session(name, self.phases.getValue((name,)), self.bytes_of).forget()
            self.phases.removeKey((name,))

    def _end(self, now: int) -> None:
        for name in [k[0] for k, phase in self.phases.iterator() if phase[5] <= now]:
            self._close(name)

    def _do(self, row: Row, now: int) -> dict:
        if row.owner is None or row.session is None or row.kind not in self.openers:
            raise Refusal("Invalid document request")
        name = f"{row.owner}\0{row.session}"
        if row.op == "close":
            self._close(name)
            return {}
        if row.op == "begin":
            if self.phases.containsKey((name,)) or sum(1 for _ in self.phases.keys()) >= self.most:  # noqa: SIM118
                raise Refusal("Document session limit exceeded")
            self.phases.updateValue((name,), (row.kind, 0, 0, False, None, now + self.lasts_ms))
            self.handle.registerTimer(now + self.lasts_ms)
            return {}
        if not self.phases.containsKey((name,)):
            raise Refusal("Document session unavailable")
        session = Session(name, self.phases.getValue((name,)), self.bytes_of)
        try:
            if row.op == "append":
                out = session.append(row.data, self.limits)
            elif row.op == "open":
                out = session.open(self.openers[session.kind])
            elif row.op == "rebuild":
                out = session.rebuild(self.openers[session.kind], row.masks, self.limits)
            elif row.op == "read":
                out = session.read(row.offset, self.limits)
            else:
                raise Refusal("Invalid document operation")
        except Exception:
            self._close(name)
            raise
        self.phases.updateValue((name,), session.phase)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        from ..sources.office import code_of

        for row in sorted(rows, key=lambda r: (r.ts, r.seq)):
            now = int(row.ts.timestamp() * 1000)
            self._end(now)
            try:
                out, code = self._do(row, now), None
            except Exception as e:  # whatever a file does, it costs its own session
                out, code = {}, code_of(e)
            yield Row(host=row.host, owner=row.owner, session=row.session, seq=row.seq, op=row.op, ok=code is None, code=code, segments=out.get("segments"), size=out.get("size"), data=out.get("data"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._end(expiredTimerInfo.getExpiryTimeInMs())
        return iter(())


def answers(operations: DataFrame, openers: dict[str, Callable[[bytes], Any]], watermark: str = "10 seconds", **options) -> DataFrame:
    """An answer for each of OPERATIONS; a host's are taken in order of (ts, seq) within a batch."""
    timed = operations.withWatermark("ts", watermark)
    return timed.groupBy("host").transformWithState(Host(openers, **options), ANSWERS, "append", "EventTime")
