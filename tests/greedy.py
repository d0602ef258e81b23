"""The pass over ranked candidates one by one, which reconciliation in rows must equal."""

from __future__ import annotations

from collections.abc import Iterable

NEAR = 0.8


class Entity:
    """What the views of several chunks agree on so far."""

    def __init__(self, row: dict):
        self.type, self.confidence, self.start, self.stop = row["type"], row["confidence"], row["start"], row["stop"]
        self.open_start, self.open_stop = bool(row["truncated_start"]), bool(row["truncated_stop"])
        self.chunk, self.chunks = row["chunk"], {row["chunk"]}
        scores = row.get("tokens")
        self.tokens = None if scores is None else {int(t["token_index"]): float(t["confidence"]) for t in scores}

    @property
    def clipped(self) -> bool:
        return self.open_start or self.open_stop

    def inside(self, other: Entity) -> bool:
        """A clipped view of other: it lies in it and its clipped edges explain what is missing."""
        if self.start < other.start or self.stop > other.stop:
            return False
        missing_start, missing_stop = self.start > other.start, self.stop < other.stop
        return self.clipped and (self.open_start or not missing_start) and (self.open_stop or not missing_stop)

    def same_as(self, other: Entity) -> bool:
        shared = min(self.stop, other.stop) - max(self.start, other.start)
        if self.type != other.type or shared <= 0:
            return False
        extent = max(self.stop, other.stop) - min(self.start, other.start)
        return shared > NEAR * extent or self.inside(other) or other.inside(self)

    def continues(self, other: Entity) -> bool:
        """other runs out at its chunk's end and this one comes in at its chunk's start, with a common part."""
        return self.type == other.type and other.open_stop and self.open_start and other.start < self.start < other.stop < self.stop

    def absorb(self, other: Entity) -> None:
        if (self.start, self.stop) == (other.start, other.stop):
            self.confidence = max(self.confidence, other.confidence)
        if other.start < self.start:
            self.start, self.open_start = other.start, other.open_start
        if other.stop > self.stop:
            self.stop, self.open_stop = other.stop, other.open_stop
        self.chunks.add(other.chunk)

    def join(self, other: Entity) -> None:
        left, right = (self, other) if self.start < other.start else (other, self)
        start, stop, edges = left.start, right.stop, (left.open_start, right.open_stop)
        self.confidence = (self.confidence + other.confidence) / 2
        if self.tokens and other.tokens:
            self.tokens = {i: max(self.tokens.get(i, 0.0), other.tokens.get(i, 0.0)) for i in [*self.tokens, *other.tokens]}
            self.confidence = sum(self.tokens.values()) / len(self.tokens)
        self.start, self.stop, (self.open_start, self.open_stop) = start, stop, edges
        self.chunks.add(other.chunk)


def rank(e: Entity) -> tuple:
    length = e.stop - e.start
    return (e.clipped, -length if e.clipped else -e.confidence, -length, -e.confidence, e.chunk)


def merge_views(rows: Iterable[dict]) -> list[Entity]:
    """Candidates of one segment, in input order."""
    kept: list[Entity] = []
    for new in sorted(map(Entity, rows), key=rank):
        others = [e for e in kept if new.chunk not in e.chunks]
        if twin := next((e for e in others if e.same_as(new)), None):
            twin.absorb(new)
            continue
        for e in others:
            if not (new.continues(e) or e.continues(new)):
                continue
            lo, hi, chunks = min(e.start, new.start), max(e.stop, new.stop), e.chunks | {new.chunk}
            if not any(x is not e and x.chunks & chunks and x.start < hi and x.stop > lo for x in kept):
                e.join(new)
                break
        else:
            kept.append(new)
    return kept
