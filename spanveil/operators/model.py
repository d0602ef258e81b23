"""Detection by a token classifier: tokenise once, window, infer in Arrow batches, decode and reconcile in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import reconcile, tokens


class Tokenizer(Protocol):
    vocabulary: dict[str, int]
    first: str
    last: str

    def encode(self, text: str) -> list[tuple[int, int, int]]: ...


#: Token ids of one chunk to logits (tokens, classes).
Runtime = Callable[[list[int]], np.ndarray]


def widen_half(raw: bytes) -> np.ndarray:
    """IEEE binary16 to binary32, exactly."""
    return np.frombuffer(raw, "<f2").astype("<f4")


def check_labels(labels: list[str], size: int | None = None, ids: dict[str, int] | None = None) -> None:
    """O first, then B and I of each type side by side; as many as size, and with the numbers that ids gives back, where these are given."""
    if size is not None and len(labels) != size:
        raise ValueError(f"{size} labels expected")
    if ids is not None and ids != {x: i for i, x in enumerate(labels)}:
        raise ValueError("labels and their numbers differ")
    if labels[:1] != ["O"] or len(labels) % 2 == 0:
        raise ValueError("labels must be O and pairs")
    for b, i in zip(labels[1::2], labels[2::2], strict=True):
        if b[:2] != "B-" or i != "I-" + b[2:] or b[2:] not in S.PII_TYPES:
            raise ValueError(f"unsupported labels {b}, {i}")


@dataclass
class OnnxRuntime:
    """A session of its own in each Python worker, from bytes that travel with the task or a local path."""

    model: bytes | str

    def __call__(self, ids: list[int]) -> np.ndarray:
        if not hasattr(self, "session"):
            import onnxruntime

            self.session = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
            if {x.name for x in self.session.get_inputs()} != {"input_ids", "attention_mask"}:
                raise ValueError("the model must take input_ids and attention_mask")
        one = np.array([ids], np.int64)
        (logits,) = self.session.run(["logits"], {"input_ids": one, "attention_mask": np.ones_like(one)})
        return logits[0]


def infer(segments: DataFrame, keys: list[str], tokenizer: Tokenizer, runtime: Runtime, size: int = S.CHUNK_TOKENS, overlap: int = S.CHUNK_OVERLAP) -> DataFrame:
    """A row for each token of each chunk, with logits and offsets. Every tokenised text is windowed; substrings are never tokenised again.

    A segment that the tokenizer or the model fails on has one row with a code instead, and costs no other segment.
    """
    if size + 2 > S.MAX_TOKENS:
        raise ValueError("chunks exceed what the model takes")
    fields = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", chunk int, i int, start int, stop int, attn int, special int, logits array<float>, has_previous boolean, has_next boolean, token_start int, code string"
    names = [x.split()[0] for x in schema.split(", ")]

    def chunks(text: str, first: int, last: int) -> list[tuple]:
        found = tokenizer.encode(text)
        rows, at, chunk = [], 0, 0
        while found and (at == 0 or at + overlap < len(found)):
            part = found[at : at + size]
            logits = np.asarray(runtime([first, *[t[0] for t in part], last]), np.float32)
            if logits.shape[0] != len(part) + 2 or not np.isfinite(logits).all():
                raise ValueError("unusable logits")
            spans = [(0, 0), *[t[1:] for t in part], (0, 0)]
            rows += [(chunk, i, a, b, 1, int(i in (0, len(part) + 1)), scores.tolist(), at > 0, at + size < len(found), at, None) for i, ((a, b), scores) in enumerate(zip(spans, logits, strict=True))]
            at, chunk = at + size - overlap, chunk + 1
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last = tokenizer.vocabulary[tokenizer.first], tokenizer.vocabulary[tokenizer.last]
        for pdf in batches:
            for row in pdf.to_dict("records"):
                own = tuple(row[k] for k in keys)
                try:
                    rows = [(*own, *x) for x in chunks(row["text"], first, last)]
                except Exception as e:  # one segment's failure, whatever it is
                    code = "OUT_OF_MEMORY" if re.search(S.OUT_OF_MEMORY, str(e), re.I) else "INFERENCE_FAILED"
                    rows = [(*own, *[None] * 10, code)]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({c: "Int32" for c in ("chunk", "i", "start", "stop", "attn", "special", "token_start")} | {c: "boolean" for c in ("has_previous", "has_next")})

    return segments.filter(F.length("text") > 0).select(*keys, "text").mapInPandas(run, schema)


def detect(segments: DataFrame, keys: list[str], tokenizer: Tokenizer, runtime: Runtime, labels: list[str]) -> DataFrame:
    """Disjoint regions of every segment with findings; a segment that fails fails the query. See scan()."""
    return _regions(infer(segments, keys, tokenizer, runtime).withColumn("code", F.when(F.col("code").isNotNull(), F.raise_error(F.col("code")))), segments, keys, labels)


def scan(segments: DataFrame, keys: list[str], tokenizer: Tokenizer, runtime: Runtime, labels: list[str], whole: list[str]) -> tuple[DataFrame, DataFrame]:
    """(regions, rejects(whole, stage, code)): a document of which one segment fails has no regions at all.

    What the model says is read twice; where that costs more than a table, persist the segments' answers before.
    """
    answers = infer(segments, keys, tokenizer, runtime)
    failed = answers.filter(F.col("code").isNotNull()).groupBy(*whole).agg(F.lit("detecting").alias("stage"), F.min("code").alias("code"))
    return _regions(answers.filter(F.col("code").isNull()), segments, keys, labels).join(failed.select(*whole), whole, "left_anti"), failed


def _regions(answers: DataFrame, segments: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    check_labels(labels)
    found = tokens.decode_bio(answers.filter(F.col("code").isNull()).drop("code"), labels, keys, segments)
    return reconcile.reconcile(found.withColumn("ord", F.col("chunk") * S.MAX_TOKENS + F.col("entity").cast("int")).drop("entity"), keys)
