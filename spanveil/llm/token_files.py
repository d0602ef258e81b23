"""Token ids in binary files: ids by frequency rank in one to four bytes, lengths in control bytes of their own.

Texts are encoded by a tokenizer of the tokenizers library, each document is closed by an end id, and the documents
stand in ascending order of their ids in numbered files of about ``file_ids`` token ids. A file is, little-endian:

    8 bytes   SPVIDS1 and a line feed
    7 x u64   part, file within the part, ids before it within the part, documents, ids, data bytes, crc32 of what follows
    i64, u8   document id and whether it is null, of each document
    u64       ids of each document
    control   one byte for four ids: two bits each, the id's number of bytes less one
    data      ranks, as many low bytes of each as its control bits say

``ranks.u32`` holds the token id of every rank, the most frequent first; it covers the whole vocabulary. Parts are ranges
of document ids, so the ids before a file are those of earlier parts and those before it within its own. A task writes a
file under a name of its attempt and then renames it; a repeated task makes the same bytes, since its rows come sorted.
The folder must be one that the file systems of pyarrow open for writing; reading is Spark's.

A tokenizer that splits at white space and at the borders of letters before it merges, as word_bpe_49k does, gives a text
the ids of its words, which the library encodes once while they are kept. Other tokenizers take whole texts; so do texts
with one of the tokenizer's own marks. A null or empty text has the end id only. Null ids come first; repeated rows are documents of their own.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import before_parts, delete_at_end, discard, documents, lean, shared_dir, small_batches, staged

MAGIC = b"SPVIDS1\n"
HEAD = "<7Q"
#: Bytes of the four ids of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: ASCII punctuation around a word, but for apostrophes: patterns such as 's begin with one.
AROUND = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A fixed value: how tokenizers of this kind split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    v = ranks.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros((-(-len(v) // 4), 4), np.uint8)
    four.reshape(-1)[: len(v)] = code
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """n ranks: lengths by a table of the control bytes, then each byte of all ids at once."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at, held = np.cumsum(sizes) - sizes, np.frombuffer(data, np.uint8)
    out = held[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        out[more] |= held[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def splits_words(spelled: dict) -> bool:
    """Whether a tokenizer lower-cases, splits at PATTERN and then merges bytes: words between white space, runs of ASCII
    punctuation around them and lower-case letters then have ids of their own."""
    steps = (spelled.get("pre_tokenizer") or {}).get("pretokenizers") or []
    normal = [x["type"] for x in (spelled.get("normalizer") or {}).get("normalizers") or []]
    return (
        [x["type"] for x in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": PATTERN}
        and normal == ["NFC", "Replace", "Lowercase"]
        and not spelled.get("post_processor")
        and spelled["model"]["type"] == "BPE"
    )


class Encoder:
    """Texts to ids. Arrow cuts and numbers the words and finds those that are kept; only others become Python objects and are
    encoded. Of over ``most`` kept words, the half used last stays."""

    made: dict[int, Encoder] = {}

    def __init__(self, spelled: str, most: int = 800_000):
        from tokenizers import Tokenizer, pre_tokenizers

        read = json.loads(spelled)
        self.tokenizer, self.most, self.by_words = Tokenizer.from_str(spelled), most, splits_words(read)
        self.marks = [x["content"] for x in read.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.latin = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x250) if chr(c).isalpha()}
        self.merge = self.tokenizer.model.tokenize
        self.sides: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.words, self.used, self.calls = pa.array([], pa.string()), np.empty(0, np.int64), 0
        self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, self.dtype)

    @classmethod
    def of(cls, spelled: str) -> Encoder:
        """One for each worker, which Spark keeps for later tasks."""
        key = zlib.crc32(spelled.encode())
        if key not in cls.made:
            cls.made = {key: cls(spelled)}
        return cls.made[key]

    def whole(self, text: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def _side(self, marks: bytes) -> bytes:
        if marks not in self.sides:
            self.sides[marks] = self.whole(marks) if marks else b""
        return self.sides[marks]

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words not kept. Latin letters (single code points, which no normal form changes) with ASCII punctuation around
        them are merged at once, in lower case; all else takes the tokenizer's whole way."""
        if len(self.cores) > self.most // 4:
            self.cores = {}
        cores, rest, merge, code, out = self.cores, [], self.merge, self.code, []
        for i, word in enumerate(words):
            core = word.strip(AROUND)
            letters = core.decode()
            low = letters.lower()
            if not letters.isalpha() or not letters.isascii() and (max(letters) >= "\u0250" or max(low) >= "\u0250"):
                rest.append(i)
                out.append(b"")
                continue
            ids = cores.get(low)
            if ids is None:
                ids = cores[low] = array(code, [x.id for x in merge(low if low.isascii() else low.translate(self.latin))]).tobytes()
            if len(core) < len(word):
                at = len(word) - len(word.lstrip(AROUND))
                ids = self._side(word[:at]) + ids + self._side(word[at + len(core) :])
            out.append(ids)
        for lo in range(0, len(rest), 8192):
            some = rest[lo : lo + 8192]
            for i, coded in zip(some, self.tokenizer.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False), strict=True):
                out[i] = array(code, coded.ids).tobytes()
        return out

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where different words stand among those kept, once the others are learnt."""
        self.calls += 1
        if len(self.words) > self.most:
            self._keep(np.sort(np.argsort(self.used, kind="stable")[-(self.most // 2) :]))
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = np.arange(len(self.words), len(self.words) + len(new))
        if len(new):
            coded = self._learn(new.cast(pa.binary()).to_pylist())
            self.words = pa.concat_arrays([self.words, new])
            self.sizes = np.append(self.sizes, np.fromiter(map(len, coded), np.int64, len(coded)) // self.dtype.itemsize)
            self.flat = np.append(self.flat, np.frombuffer(b"".join(coded), self.dtype))
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[at] = self.calls
        return at

    def _keep(self, at: np.ndarray) -> None:
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]
        self.flat = self.flat[_runs(starts, sizes)]
        self.words, self.sizes, self.used = self.words.take(pa.array(at)), sizes, self.used[at]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and where each text's end; null is empty."""
        texts = texts.fill_null("")
        apart = np.full(len(texts), not self.by_words)
        for mark in self.marks:
            apart |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        whole = [self.whole(t) for t in texts.filter(pa.array(apart)).cast(pa.binary()).to_pylist()]
        cut = pc.ascii_split_whitespace(pc.if_else(pa.array(apart), "", texts) if whole else texts)
        words = cut.flatten().dictionary_encode()
        at = self._places(words.dictionary)
        sizes = np.append(self.sizes, np.array(list(map(len, whole)), np.int64) // self.dtype.itemsize)
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(whole), self.dtype)]) if whole else self.flat
        held = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64))
        which = np.insert(at[words.indices.to_numpy()], held[apart], np.arange(len(self.sizes), len(sizes)))
        starts, sizes = (np.cumsum(sizes) - sizes)[which], sizes[which]
        return flat[_runs(starts, sizes)], np.append(0, np.cumsum(sizes))[held + np.cumsum(apart)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, ends = self.encode_column(pa.array(texts, pa.binary()).cast(pa.string()))
        return [x.tobytes() for x in np.split(ids, ends)[: len(texts)]]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that start somewhere, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _encode(spelled, end: int, most_bytes: int = 1 << 22):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(spelled.value)
        for batch in batches:
            group = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // most_bytes
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                ids, ends = encoder.encode_column(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, ends, end)
                bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * encoder.dtype.itemsize
                if bounds[-1] >= 1 << 31:
                    raise OverflowError("ids of a text take 2 GB or more")
                own = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), own], ["id", "ids"])

    return run


def tokenised(docs: DataFrame, spelled: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as little-endian bytes, two or four each by the vocabulary's size, the end id last."""
    sent = docs.sparkSession.sparkContext.broadcast(spelled)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(_encode(sent, end)), "id long, ids binary")


def _count(size: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            column = batch.column(0)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            counts += np.bincount(np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(dtype), minlength=size)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["token", "n"])

    return run


def frequency_order(tokens: DataFrame, size: int, dtype: str) -> tuple[np.ndarray, int]:
    """The token id of each rank, and how many ids there are; a row for each vocabulary entry comes to the driver."""
    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(lean(_count(size, dtype)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r.token] = r.n
    return np.argsort(-counts, kind="stable").astype("<u4"), int(counts.sum())


@dataclass
class TokenFiles:
    """A folder of files, and the ids before each of its parts."""

    folder: str
    before: dict[int, int]


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, ranks, dtype: str, file_ids: int):
    """Rows of a part in order to its files; a row for the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, at = _file_system(folder)
        part, files, before, held, docs = TaskContext.get().partitionId(), 0, 0, 0, []

        def flush():
            nonlocal files, before, held, docs
            sizes = np.array([len(x) for _, x in docs], "<u8") // np.dtype(dtype).itemsize
            control, data = pack(ranks.value[np.frombuffer(b"".join(x for _, x in docs), dtype)])
            ids, nulls = np.array([i or 0 for i, _ in docs], "<i8"), np.array([i is None for i, _ in docs], np.uint8)
            body = ids.tobytes() + nulls.tobytes() + sizes.tobytes() + control + data
            head = struct.pack(HEAD, part, files, before, len(docs), held, len(data), zlib.crc32(body))
            name = f"{at}/{part:06d}-{files:06d}"
            own = f"{name}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(own) as out:
                out.write(MAGIC + head + body)
            system.move(own, f"{name}.ids")
            files, before, held, docs = files + 1, before + held, 0, []

        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append((i, ids))
                held += len(ids) // np.dtype(dtype).itemsize
                if held >= file_ids:
                    flush()
        if docs:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64())], ["part", "ids"])

    return run


def write_tokens(docs: DataFrame, spelled: str, folder: str, end: int = 1, file_ids: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Texts of docs to files in a folder that holds nothing yet."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_str(spelled).get_vocab_size(), end + 1)
    dtype = Encoder(spelled).dtype.str
    tokens = staged(tokenised(docs, spelled, end, id_col, text_col), "token-ids")
    order, total = frequency_order(tokens, size, dtype)
    ranks = np.empty(size, "<u4")
    ranks[order] = np.arange(size, dtype="<u4")
    system, at = _file_system(folder)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/ranks.u32") as out:
        out.write(order.tobytes())
    by = [F.col("id").asc_nulls_first(), F.xxhash64("ids")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * file_ids)))
    ranged = tokens.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    with small_batches(spark):
        written = ranged.mapInArrow(lean(_write(folder, spark.sparkContext.broadcast(ranks), dtype, file_ids)), "part int, ids long").collect()
    discard(tokens)
    return TokenFiles(folder, before_parts({r.part: r.ids for r in written}))


def decoded(content: bytes, order: np.ndarray) -> tuple[int, int, pa.Array, np.ndarray, np.ndarray]:
    """(part, ids before within it, document ids, ids of each document, all token ids) of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    part, _, before, n_docs, n_ids, n_data, crc = struct.unpack_from(HEAD, content, 8)
    body = memoryview(content)[8 + struct.calcsize(HEAD) :]
    if zlib.crc32(body) != crc:
        raise ValueError("a damaged token file")
    cuts = np.cumsum([0, 8 * n_docs, n_docs, 8 * n_docs, -(-n_ids // 4), n_data]).tolist()
    ids, nulls, sizes, control, data = (body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    keys = pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(nulls, np.uint8) > 0)
    return part, before, keys, np.frombuffer(sizes, "<u8").astype(np.int64), order[unpack(control, data, n_ids)]


def _read(order, before):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                part, ahead, keys, sizes, ids = decoded(content.as_py(), order.value)
                ends = np.cumsum(sizes)
                data = ids.astype("<u4").tobytes()
                own = pa.array([data[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(before.value[part] + ahead + ends - sizes), pa.array(sizes), own], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files: ids before the document, its own ids and, as unsigned 32-bit integers, what they are."""
    system, at = _file_system(files.folder)
    with system.open_input_stream(f"{at}/ranks.u32") as source:
        order = np.frombuffer(source.read(), "<u4")
    send = spark.sparkContext.broadcast
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(files.folder).select("content")
    return content.mapInArrow(lean(_read(send(order), send(files.before))), "doc_id long, start long, n_tokens long, ids binary")


def op12_token_files(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spelled = f.read()
    folder = f"{shared_dir(spark)}/spanveil/token-files-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    files = write_tokens(documents(spark, sf_dir).select("doc_id", "text"), spelled, folder)
    return read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
