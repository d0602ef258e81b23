"""Near-duplicates: bottom-k sketches from one hash function, inverted lists, and exact confirmation.

A document's values are the hashes of its distinct word shingles. One global order ranks all values: the
ones found frequent come last, and within both kinds the hash decides. A document retains its bottom k
values, k = floor((1 - t) n) + 1 of n: two sets with Jaccard similarity t or more have a retained value in
common, whatever the order, so the inverted lists of retained values lose no link. Frequent values last
keeps passages that thousands of documents share out of the lists, unless the documents hold little else.

1. Documents with equal sets form a class; its smallest id stands for it.
2. Frequent values: those counted in more documents than a short list has, cut to a bounded number of the
   most frequent ones. They only shape the order.
3. Inverted lists, counted and gathered in one shuffle; those of frequent values, which may have any length, are
   counted first and joined. A short list gives its pairs, by size and position whether they can still reach t.
   A long list is mostly a group of near copies. Members that by size and position can reach t with none of
   its sizes leave it at once: of the copies around the threshold, whose own changes come first in their
   order, that is nearly every one. Of the rest, each member is compared with the list's most central one,
   the one with the smallest share of infrequent values, and with at most four others.
4. The union of two plain bottom-64 sketches estimates the similarity and filters. Sketches that hold the whole
   union are exact; else a pair goes if the estimate lies eight standard deviations below t. By Chernoff's
   bound that happens to a pair at t or above with a chance of under 1e-9. Exact Jaccard on the full sets
   verifies.
5. Components of the links. Members of a long list in different components are still not compared: those
   outside the list's main component meet further members of it, as long as that links some, then the
   pairs across components that are left.

A document without words has an empty set and is linked with nothing; with fewer words than a shingle
takes, the whole sequence is its one value. Rows with a null id take no part (component null, kept). Rows
with one id are one document: the text of the smallest hash stands for it, and all get its component; they
are kept alike. Input columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TokenHasher, discard, documents, give_back, lean, mix64, relieve, staged
from .components import components

SKETCH = 64
SHORT_LIST = 32
MOST_FREQUENT = 1 << 20
MOST_IDS_SENT = 1 << 21
MOST_TURNS = 6
MOST_PAIRS = 1 << 20


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, words: int):
        self.words, self.hasher = words, TokenHasher()

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, hashes, sizes in self.hasher.chunks(column):
            # Shingles of all texts in one go; those that run over a text's end are never taken.
            by_length: dict[int, np.ndarray] = {}
            ends = np.cumsum(sizes)
            for at, size in zip((ends - sizes).tolist(), sizes.tolist(), strict=True):
                if not size:
                    yield np.empty(0, np.uint64)
                    continue
                n = min(self.words, size)
                if n not in by_length:
                    by_length[n] = self._shingles(hashes, n)
                out = np.sort(by_length[n][at : at + size - n + 1])
                yield out[np.concatenate([[True], out[1:] != out[:-1]])]

    @staticmethod
    def _shingles(h: np.ndarray, n: int) -> np.ndarray:
        out = h[: len(h) - n + 1] + np.uint64(n)
        for k in range(1, n):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (out >> np.uint64(32)) ^ h[k : len(h) - n + 1 + k]
        return mix64(out)


def _describe(words: int):
    """Each document's size, set hash, and bottom-64 sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = list(shingler.sets(batch.column(1)))
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(map(len, sets)), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([x[:SKETCH].tobytes() for x in sets], pa.binary())], ["id", "h", "n", "s1", "s2", "sketch"])

    return run


def _often(words: int, at_once: int = 1 << 22):
    """How many of a task's documents hold a value: of the low quarter of all hashes, where most retained
    values lie, every one; of the others those that it meets at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(words), [], 0

        def out() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            keep = (v < np.uint64(1 << 62)) | (c > 1)
            return pa.RecordBatch.from_arrays([pa.array(v[keep].view("i8")), pa.array(c[keep])], ["v", "c"])

        for batch in batches:
            for own in shingler.sets(batch.column(0)):
                held.append(own)
                size += len(held[-1])
                if size >= at_once:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _retain(words: int, num: int, den: int, frequent):
    """Each class's retained values with their places in the order and whether they are frequent, and its share of values that aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, often = Shingler(words), frequent.value
        for batch in batches:
            v, where, place, sizes, rare, last = [], [], [], [], [], []
            for i, own in enumerate(shingler.sets(batch.column(1))):
                if not len(own):
                    continue
                k = (den - num) * len(own) // den + 1
                late = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own if len(often) else np.zeros(len(own), bool)
                first = np.concatenate([own[~late], own[late]])[:k]
                v.append(first)
                place.append(np.arange(len(first)))
                where.append(np.full(len(first), i))
                sizes.append(np.full(len(first), len(own)))
                rare.append(np.full(len(first), (~late).sum() / len(own)))
                last.append(np.arange(len(first)) >= (~late).sum())
            if v:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view("i8")), batch.column(0).take(pa.array(np.concatenate(where))), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(rare).astype(np.float32)), pa.array(np.concatenate(last))], ["v", "rep", "n", "place", "rare", "late"])

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingler.sets(batch.column(1))], pa.binary())], ["rep", "values"])

    return run


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Similarity by the bottom-64 sketch of the union: how much of it both sketches hold; and its length."""
    union = np.union1d(a, b)[:SKETCH]
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / max(1, len(union)), len(union)


def _promising(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = num / den
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                guess, size = estimate(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))
                keep.append(guess >= t - (8 * (t * (1 - t) / size) ** 0.5 if size == SKETCH else 0))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def sent_if_few(ids: DataFrame) -> DataFrame:
    """A staged table of ids, with the hint to broadcast it only if its rows have been counted as few."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS_SENT else ids


class Confirmer:
    """Candidate pairs (a, b) of classes to links, each pair once."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, words: int, num: int, den: int):
        self.texts, self.sketches, self.words, self.num, self.den = texts, sketches, words, num, den

    def __call__(self, pairs: DataFrame, *sources: DataFrame) -> DataFrame:
        """sources: staged tables that only the pairs come from; they go, and what the pairs were shuffled by, before sets are made."""
        pairs = self._with(pairs.distinct(), self.sketches.select("rep", "sketch"))
        pairs = staged(pairs.mapInArrow(lean(_promising(self.num, self.den)), "a long, b long"), "promising")
        discard(*sources)
        if sources:
            relieve(self.texts.sparkSession, 0)
        ids = staged(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "ids")
        sets = self.texts.join(sent_if_few(ids), "rep", "left_semi").mapInArrow(lean(_full_sets(self.words)), "rep long, values binary")
        links = staged(self._with(pairs, sets).mapInArrow(lean(_verified(self.num, self.den)), "a long, b long").distinct(), "verified")
        discard(pairs, ids)
        return links

    @staticmethod
    def _with(pairs: DataFrame, values: DataFrame) -> DataFrame:
        name = values.columns[1]
        a, b = (values.select(F.col("rep").alias(x), F.col(name).alias(f"{name}_{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", f"{name}_a", f"{name}_b")


def overlap(n: Column, m: Column, num: int, den: int) -> Column:
    """The least number of values that sets of n and m must share: whole numbers throughout."""
    return F.floor((F.lit(num) * (n + m) + F.lit(num + den - 1)) / F.lit(num + den))


def can_reach(x: str, y: str, num: int, den: int):
    """Whether two members of a list, by sizes and places, can have a union den/num times their intersection."""
    least = overlap(F.col(f"{x}.n"), F.col(f"{y}.n"), num, den)
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place"))
    return (left >= least) & sizes_fit(x, y, num, den)


def sizes_fit(x: str, y: str, num: int, den: int):
    return F.lit(den) * F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) >= F.lit(num) * F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n"))


def gathered(members: DataFrame) -> DataFrame:
    """(v, size, m): a short list in one row, sorted by rep; a long one in a row for each member."""
    alone = F.when(F.col("size") > SHORT_LIST, F.col("rep"))
    return members.groupBy("v", "size", alone.alias("alone")).agg(F.array_sort(F.collect_list(F.struct("rep", "n", "place", "rare"))).alias("m")).drop("alone")


def pairs_of(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of gathered short lists that can reach the threshold."""
    both = lists.filter(F.col("size") <= SHORT_LIST).select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    return both.filter(can_reach("x", "y", num, den)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def links_of(texts: DataFrame, sketches: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, component) of the classes that are linked with others."""
    spark = texts.sparkSession
    counted = staged(texts.select("text").mapInArrow(lean(_often(words)), "v long, c long").groupBy("v").agg(F.sum("c").alias("c")).filter(F.col("c") > SHORT_LIST), "often")
    cut = counted.groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c"))  # a row for each count
    least, held = SHORT_LIST + 1, 0
    for row in cut.toLocalIterator():
        held += row.k
        if held > MOST_FREQUENT:
            least = row.c + 1
            break
    frequent = np.sort(counted.filter(F.col("c") >= least).select("v").toArrow()["v"].to_numpy().view("u8"))

    discard(counted)
    give_back()
    posts = staged(texts.select("rep", "text").mapInArrow(lean(_retain(words, num, den, spark.sparkContext.broadcast(frequent))), "v long, rep long, n int, place int, rare float, late boolean"), "posts")
    able = F.col("n") - F.col("place") >= overlap(F.col("n"), F.greatest(F.col("least"), F.ceil(F.lit(num) * F.col("n") / F.lit(den))), num, den)
    # Lists of values that aren't among the frequent ones are bounded: dealt out once, counted and gathered where they are.
    own = Window.partitionBy("v")
    members = posts.filter(~F.col("late")).drop("late").withColumns({"size": F.count(F.lit(1)).over(own), "least": F.min("n").over(own)})
    lists = staged(gathered(members.filter((F.col("size") > 1) & able)), "lists")
    long_ = lists.filter(F.col("size") > SHORT_LIST).select("v", F.inline("m"))
    short, sources = pairs_of(lists, num, den), [posts, lists]
    if len(frequent):  # those of frequent values may have any length, and are counted first
        late = posts.filter("late").drop("late")
        counts = late.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).filter(F.col("size") > 1)
        late = staged(late.join(counts, "v").filter(able).drop("least"), "late-members")
        long_ = long_.unionByName(late.filter(F.col("size") > SHORT_LIST).drop("size"))
        short = short.unionByName(pairs_of(gathered(late.filter(F.col("size") <= SHORT_LIST)), num, den))
        sources.append(late)
    long_ = staged(long_, "long-lists")
    relieve(spark, 0)  # what dealt the lists out goes before the pairs
    member = F.struct("rep", "n", "place", "rare")
    centres = long_.groupBy("v").agg(F.min_by(member, F.struct("rare", "rep")).alias("core"), F.min_by(member, F.struct(F.xxhash64("rep", F.pmod("v", F.lit(4))), "rep")).alias("centre"))
    confirm = Confirmer(texts, sketches, words, num, den)
    links = confirm(short.filter(F.col("a") < F.col("b")).unionByName(some_each(long_.join(centres, "v"), num, den)), *sources)

    before = None
    for turn in range(MOST_TURNS):
        found = components(links)
        open_ = long_.join(found, long_["rep"] == found["node"], "left").select("v", "rep", "n", "place", "rare", F.coalesce("component", "rep").alias("component"))
        parts = open_.groupBy("v", "component").agg(F.count(F.lit(1)).alias("k"), F.min_by(member, F.struct("rare", "rep")).alias("core"), F.min_by(member, F.xxhash64("rep", F.lit(turn))).alias("centre"))
        whole = parts.groupBy("v").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.max_by(F.struct("component", "core", "centre"), F.struct("k", "component")).alias("main"))
        whole = whole.filter(F.col("squares") < F.col("size") * F.col("size")).select("v", "size", "squares", F.col("main.component").alias("main"), F.col("main.core").alias("core"), F.col("main.centre").alias("centre"))
        whole = staged(whole, "open-lists")
        left, cross = whole.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum((F.col("size") * F.col("size") - F.col("squares")) / 2), F.lit(0))).first()
        if not left:
            discard(long_, whole)
            return found
        # What is outside its list's main component.
        apart = open_.join(whole, "v").filter(F.col("component") != F.col("main"))
        last = turn == MOST_TURNS - 1 or cross <= max(4 * left, MOST_PAIRS) or cross == before
        if last:  # every pair across components that can still reach the threshold
            x = apart.select("v", F.struct("rep", "n", "place").alias("x"), F.col("component").alias("cx"), "main")
            y = open_.select("v", F.struct("rep", "n", "place").alias("y"), F.col("component").alias("cy"))
            pairs = x.join(y, "v").filter((F.col("cx") != F.col("cy")) & can_reach("x", "y", num, den))
            pairs = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        else:  # with another member of the main component each time
            pairs = some_each(apart, num, den)
        links = links.unionByName(confirm(pairs))
        discard(found, whole)
        if last:
            found = components(links)
            discard(long_)
            return found
        before = cross
    raise AssertionError("not reached")


def some_each(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of every member with the most central of its lists' cores, and with those of its lists' centres that its
    size fits: at most five, whatever the number of lists."""
    fits = lambda y: sizes_fit("x", y, num, den) & (F.col(f"{y}.rep") != F.col("x.rep"))
    met = members.select(F.struct("rep", "n", "place").alias("x"), F.col("core").alias("y"), F.col("centre").alias("z"))
    marks = [F.when(fits("z"), F.struct(F.xxhash64("z.rep", F.lit(seed)), F.col("z.rep").alias("rep"))) for seed in (0, 1)]
    few = met.groupBy(F.col("x.rep").alias("rep")).agg(F.min(F.when(fits("y"), F.struct("y.rare", "y.rep"))).alias("y"), *[f(m).alias(f"c{i}{k}") for i, m in enumerate(marks) for k, f in enumerate((F.min, F.max))])
    few = few.select("rep", F.explode(F.array_distinct(F.array("y.rep", "c00.rep", "c01.rep", "c10.rep", "c11.rep"))).alias("y")).filter(F.col("y").isNotNull())
    return few.select(F.least("rep", "y").alias("a"), F.greatest("rep", "y").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row for each of docs: links at den * |A & B| >= num * |A or B|."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    sketched = staged(rows.mapInArrow(lean(_describe(words)), "id long, h long, n long, s1 long, s2 long, sketch binary"), "sketches")
    described = staged(sketched.drop("sketch"), "sizes")
    several = staged(described.groupBy("id").agg(F.min("h").alias("own"), F.max("h").alias("m")).filter("id IS NOT NULL AND own <> m").select("id", "own"), "several-texts")
    standing, one_each, with_sketch = described, rows, sketched
    if some := several.limit(1).count():  # ids of several texts: one of them stands for each
        standing, one_each, with_sketch = (x.join(several, "id", "left").filter(F.coalesce("own", "h") == F.col("h")).drop("own") for x in (described, rows, sketched))
    classes = standing.filter(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    classes = staged(classes, "classes")
    reps = sent_if_few(staged(classes.select(F.col("rep").alias("id")).distinct(), "class-ids"))
    sketches = with_sketch.drop("h").join(classes.withColumnRenamed("rep", "id"), ["s1", "s2", "id"], "left_semi").select(F.col("id").alias("rep"), "sketch").distinct()
    sketches = staged(sketches, "class-sketches")
    discard(sketched)
    texts = one_each.join(reps, "id", "left_semi").select(F.col("id").alias("rep"), "text")
    found = links_of(texts, sketches, words, num, den)
    discard(sketches)

    out = standing.select("id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left")
    out = out.join(found, out["rep"] == found["node"], "left")
    own = F.when(F.col("id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "rep"))
    out = out.select("id", "n", own.alias("component_id"))
    if some:
        out = described.select("id", "n").join(out.filter(F.col("id").isNotNull()).select("id", "component_id").distinct(), "id", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words=3, num=85, den=100)
