"""Importance resampling, token files and phrase mining against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from spanveil.llm import collocations, importance, piece_sampling, token_files

VOCABULARY = Path("/opt/tokenizers/word_bpe_49k.json")
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary here")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def odd(spark):
    """Nulls, empties, repeats, a null id, long texts, and columns named like the operators' own."""
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t .", None), (5, "word one", "en"), (5, "word one", "en"), (5, "other", ""), (None, "no id here but text", "fr"), (6, "x" * 50_000, "en"), (7, "é " * 9000, "fr"), (8, "., " * 4000, "und"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS score", "'y' AS rank", "3 AS row_key", "4 AS n_words", "5 AS phrase", "6 AS a")


def sample(seed, n, words="the The of a. b, Cat déjà é x-y it's 42 , \n zz!zz".split(" ")):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 30, 200)))) for _ in range(n)]


# 11 importance resampling


def brute_resample(rows, target, n, buckets, percent, least, seed):
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").translate(ASCII_LOWER))
    features = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    own, other = Counter(), Counter()
    for _, t in rows:
        own.update(features(words(t)))
    for t in target:
        other.update(features(words(t)))
    s, t = own.total(), other.total()
    gain = [math.floor(1000 * math.log((other[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        w = words(text)
        f = features(w)
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(w), len(f), weight, score))
    open_ = sorted((-r[4], r[0]) for r in out if r[0] is not None and r[1] >= least)
    drawn = open_[: percent * len(open_) // 100]
    return out, [(i, -s, k) for k, (s, i) in enumerate(drawn, 1)]


@pytest.mark.parametrize(("n", "chunk"), [(1, 1 << 18), (1, 40), (3, 50), (2, 1)])
def test_resample(spark, n, chunk):
    rows = [(i, t) for i, t in enumerate(sample(n, 60))] + [(None, "a null id"), (3, "the cat of a"), (90, None), (91, "x" * 300)]
    target = ["the cat of déjà 42", None, "", *sample(9, 5)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, bench, n=n, buckets=50, percent=30, min_words=5, seed=7, chunk_bytes=chunk).collect()
    want, drawn = brute_resample(rows, target, n, 50, 30, 5, 7)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got], key=key) == sorted(want, key=key)
    assert sorted((r.rank, r.doc_id, r.score) for r in got if r["rank"]) == [(k, i, s) for i, s, k in drawn] and drawn


def test_resample_odd(spark):
    bench = spark.createDataFrame([("word",)], "text string")
    got = importance.resample(odd(spark), bench, n=2, min_words=1, percent=100, chunk_bytes=100).collect()
    assert len(got) == odd(spark).count() and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 6))
    assert {r.n_features for r in got if r.doc_id in (1, 2, 3, 8)} == {0} and {r.score is None for r in got if r.doc_id is None} == {True}
    assert importance.resample(odd(spark).limit(0), bench).count() == 0
    assert {r.weight <= 0 for r in importance.resample(odd(spark), bench.limit(0)).collect()} == {True}


def test_chunks_own_their_features():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab .é") for _ in range(rng.randrange(60))).encode()
        for n in (1, 2, 4):
            parts = [importance.buckets_of(importance.words_of(a), importance.words_of(b), n, 99) for a, b in importance.chunks_of(text, rng.randrange(1, 20), n)]
            whole = importance.buckets_of(importance.words_of(text), [], n, 99)
            assert sorted(np.concatenate([*parts, np.empty(0, np.uint32)]).tolist()) == sorted(whole.tolist())


# 12 token files


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rng.integers(0, 2 ** rng.choice([3, 8, 9, 16, 17, 24, 25, 32], n), dtype=np.uint64).astype("<u4")
        control, data = token_files.pack(ranks)
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
        assert (token_files.unpack(control, data, n) == ranks).all()


@needs_vocabulary
def test_words_encode_as_whole_texts():
    spelled = VOCABULARY.read_text()
    encoder, rng = token_files.Encoder(spelled, most=40), random.Random(5)
    assert encoder.by_words
    bits = ["don't", "'s", "'S", "x',", "(A)", "À", "é", ".́", "́", " ", " ", "\x1c", "\x85", "\t", "\r\n", "12", "3½", "ΣΣ", "İ", "ﬁ", "<|endoftext|>", "<|", "=≠", "你好", "\U0001f600", "..", "a-b", "Straße", "'ll", "we'll!", "Å"]
    bits += ["ª", "ß", "ĳ", "ŉ", "ǆ", "ǅ", "ſ", "ƻ", "ñandú", "ÉTÉ", "ʼn"]
    for _ in range(1500):
        texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "", "\n"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(4))]
        for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
            assert ids == encoder.whole(text.encode()), repr(text)
    assert encoder.encode([chr(c).encode() for c in range(0x250)]) == [encoder.whole(chr(c).encode()) for c in range(0x250)]


@needs_vocabulary
def test_a_word_is_met_in_python_once(monkeypatch):
    """Words of a column that occur again, in it or in a later one, never become Python objects."""
    encoder, learnt = token_files.Encoder(VOCABULARY.read_text()), []
    monkeypatch.setattr(encoder, "_learn", lambda words, f=encoder._learn: learnt.extend(words := list(words)) or f(words))
    texts = pa.array(["Ein Satz, ein Satz. " * 3, None, "", " x\u00c9 <|endoftext|> ein ", "Satz ein"])
    for _ in range(2):
        ids, ends = encoder.encode_column(texts)
        want = [encoder.whole((t or "").encode()) for t in texts.to_pylist()]
        assert ids.tobytes() == b"".join(want) and (ends == np.cumsum(list(map(len, want))) // ids.itemsize).all()
    assert sorted(learnt) == sorted({b"", b"Ein", b"Satz,", b"ein", b"Satz.", b"Satz"})


@needs_vocabulary
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_files(spark, tmp_path, name):
    from tokenizers import Tokenizer

    rows = [(i * 7 % 61, t) for i, t in enumerate(sample(4, 61))] + [(None, "a null id"), (None, None), (3, "again"), (3, "again"), (70, None), (-5, "word " * 3000), (71, "v" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = token_files.write_tokens(docs, (VOCABULARY.parent / name).read_text(), f"file://{tmp_path}/out", file_ids=500)
    got = token_files.read_tokens(spark, files).collect()
    coder, at, seen = Tokenizer.from_file(str(VOCABULARY.parent / name)), 0, []
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
        seen.append((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()))
    want = [(i, [*coder.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    keys = [-(2**63) if i is None else i for i, _ in seen]
    assert keys == sorted(keys) and sorted(map(repr, seen)) == sorted(map(repr, want))
    names = [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]
    assert len([n for n in names if n.endswith(".ids")]) > 4 and not [n for n in names if n.endswith(".tmp")]
    damaged = next(p for p in (tmp_path / "out").iterdir() if p.name.endswith(".ids"))
    with pytest.raises(ValueError, match="damaged"):
        token_files.decoded(damaged.read_bytes()[:-1] + b"?", np.arange(1 << 16))


@needs_vocabulary
def test_files_odd(spark, tmp_path):
    files = token_files.write_tokens(odd(spark), VOCABULARY.read_text(), f"file://{tmp_path}/a")
    assert token_files.read_tokens(spark, files).count() == odd(spark).count()
    none = token_files.write_tokens(odd(spark).limit(0), VOCABULARY.read_text(), f"file://{tmp_path}/b")
    assert token_files.read_tokens(spark, none).count() == 0


# 13 phrase mining


def brute_phrases(rows, least, most, share, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = [(g, p, a) for (g, p), a in f.items() if len(p) > 1 and a >= least]
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for g, p, a in candidates:
        if any(h == g and len(q) > len(p) and 100 * b >= share * a and inside(p, q) for h, q, b in candidates):
            continue
        score, _, l, r = min((1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        out.append((g, -score, -a, " ".join(p).encode(), l, r, n[g]))
    ranked, k = [], Counter()
    for g, score, a, p, l, r, total in sorted(out):  # noqa: E741
        k[g] += 1
        if k[g] <= first:
            ranked.append((g, k[g], p.decode(), -a, l, r, total, -score))
    return ranked


@pytest.mark.parametrize(("least", "most", "share", "first", "bits"), [(3, 5, 100, 2000, 28), (2, 3, 60, 5, 12), (4, 2, 100, 50, 12), (2, 5, 90, 2000, 12)])
def test_phrases(spark, least, most, share, first, bits):
    rng = random.Random(least)
    words = "New york The theé of\tof a. b, c;d É  x , \n".split(" ")
    rows = [(rng.choice(["en", "fr", None, "und", "EN", ""]), " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 3, 40))))) for _ in range(120)]
    rows += [("en", None), ("en", ""), ("en", "new york city " * 9)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = [tuple(r) for r in collocations.mine(docs, least, most, share, first, bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    want = brute_phrases(rows, least, most, share, first)
    assert sorted(got) == sorted(want) and want


def test_phrases_odd(spark):
    got = collocations.mine(odd(spark), min_count=2).collect()
    assert {(r.lang, r.phrase, r.a) for r in got} >= {("en", "word one", 2), ("fr", "é é é é é", 8996)}
    assert collocations.mine(odd(spark).limit(0)).count() == 0


def test_slices_hold_each_run_once():
    hasher, rng = collocations.Words(1).hasher, random.Random(6)
    for _ in range(100):
        text = "".join(rng.choice("ab ., ") for _ in range(rng.randrange(200))).encode()
        for k in (1, 2, 5):
            batch = pa.record_batch({"lang": ["x"], "text": [text.decode()]})
            found = Counter()
            for rows, data, bounds in collocations.blocks(batch, hasher, k, most=rng.randrange(1, 40)):
                numbers, follows, *_ = collocations.Words(1).of(rows, ["x"], data, bounds)
                found.update(tuple(numbers[i : i + k].tolist()) for i in range(len(numbers) - k + 1) if follows[i : i + k - 1].all())
            numbers, follows, *_ = collocations.Words(1).of(np.array([0]), ["x"], np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            assert found == Counter(tuple(numbers[i : i + k].tolist()) for i in range(len(numbers) - k + 1) if follows[i : i + k - 1].all())


@pytest.mark.skipif(not Path("/opt/tokenizers/piece_bpe_32k.model").exists(), reason="no vocabulary here")
def test_round_trip_is_encode_and_decode(spark):
    vocabulary = piece_sampling.Vocabulary.read(piece_sampling.MODEL)
    table = odd(spark).selectExpr("*", "1 AS pieces", "2 AS decoded")
    both = piece_sampling.decode(piece_sampling.encode(table, vocabulary), vocabulary)
    assert sorted(map(repr, piece_sampling.round_trip(table, vocabulary).collect())) == sorted(map(repr, both.collect()))
    assert piece_sampling.round_trip(table.limit(0), vocabulary).count() == 0
