"""Secret scans: patterns, and a battery of randomness tests with false-discovery control. SQL functions only.

Patterns (base spans): ``assign``, ``access`` and ``hex``, each leftmost and non-overlapping.

Battery (``random`` spans): every maximal run of 20 or more characters of the base64 and URL alphabets is a
candidate, with the padding behind it; an ``=`` inside ends one and begins the next, so in ``KEY=value`` the value
is tested by itself. Its encoding is inferred (hex, base32, base62, base64), then three tests ask whether it could be a
uniform draw from that alphabet: chi-squared uniformity, Wald-Wolfowitz runs over the alphabet's halves, and
lag-one serial correlation. Simes' rule combines the three p-values into one, and the Benjamini-Hochberg rule at
``alpha``, within each class of lengths over all candidates of the corpus, decides which are not random.

What is not rejected need not be random: of a short text the battery can't say much. So a candidate must also be
told from ordinary text of its length: the chi-squared test's own statistic (how often characters coincide) and the
share of digits have p-values under the law of text, which depend on the length, and the same rule at ``fdr``,
within the same classes, picks those that are not text. Both rules work on counts in fixed bins of log p, a bin
counting as its largest p, which errs on the rule's safe side.

A null or empty text has no spans. Rows with null ids and repeated rows are scanned like all others, one
result for each row. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, staged

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Shorter matches of the plain patterns would be dropped; as these runs are maximal, asking for the length at once is the same.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A = is padding at a run's end and nothing else: before more of the alphabet it parts a name from its value.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?"
KINDS = ("assign", "access", "hex", "random")

#: Relative letter frequencies of European text give these sums of squares and cubes; digits are rare in it.
TEXT_SQUARES, TEXT_CUBES, TEXT_DIGITS = 0.066, 0.0056, 0.02

SPAN = "struct<kind:int,start:long,stop:long>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: str, pattern: str, kind: int, group: int = 0, least: int = 0, at_once: int = 256) -> Column:
    """Spans of all matches: between two matches lies a piece of the split text, and the lengths add up.

    Matches whose group is shorter than ``least`` are dropped afterwards, so they still take their place. The sums
    run over ``at_once`` matches at a time, which keeps texts with many matches from copying long arrays again and again.
    """
    t, p = F.col(text), F.lit(pattern)
    whole = F.regexp_extract_all(t, p, F.lit(0))
    gaps = F.slice(F.split(t, pattern, -1), F.lit(1), F.size(whole))
    parts = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("m"))), F.regexp_extract_all(t, p, F.lit(group)), lambda x, g: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), (F.length(g) >= least).alias("long")))
    none = F.expr(f"cast(array() AS array<{SPAN}>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["m"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["long"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def several(acc: Column, some: Column) -> Column:
        here = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("found")), step)
        return let(here, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["found"], x["found"]).alias("found")))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / at_once).cast("int")), lambda k: F.slice(all_, k * at_once + 1, F.lit(at_once)))
    folded = let(parts, lambda all_: F.aggregate(cut(all_), start, several, lambda acc: acc["found"]))
    return F.when(t.rlike(pattern), folded).otherwise(none)


def written(column: str) -> Column:
    """Spans as kind:start:end by start, then kind."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(array_sort(transform({column}, x -> named_struct('start', x.start, 'kind', x.kind, 'stop', x.stop))), x -> concat(element_at({names}, x.kind + 1), ':', x.start, ':', x.stop)), ',')")


def _tail(z: Column) -> Column:
    """Upper tail of the normal law, by a logistic curve of the third degree."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z)))


def battery(token: Column) -> Column:
    """A candidate's (n, encoding, p_chi, p_runs, p_serial, p_text): null if fewer than 20 characters are left without padding."""
    hexes, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    wide = upper + upper.lower() + "0123456789"
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    def inferred(body: Column) -> Column:
        encoding = F.when(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").when(body.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
        return F.struct(body.alias("body"), encoding.alias("encoding"))

    def coded(x: Column) -> Column:
        of = lambda name: x["encoding"] == name
        alphabet = F.when(of("hex"), hexes).when(of("base32"), upper + "234567").when(of("base62"), wide).otherwise(wide + "+/")
        chars = F.filter(F.split(F.when(of("hex"), F.lower(x["body"])).otherwise(F.translate(x["body"], "-_", "+/")), ""), lambda c: c != "")
        return let(F.struct(alphabet.alias("alphabet"), chars.alias("chars")), lambda y: F.struct(
            x["encoding"].alias("encoding"), F.length(x["body"]).cast("double").alias("n"), F.length(y["alphabet"]).cast("double").alias("size"), y["chars"].alias("chars"),
            F.transform(y["chars"], lambda c: (F.call_function("instr", y["alphabet"], c) - 1).cast("double")).alias("codes"),
            (F.length(F.regexp_replace(x["body"], "[^0-9]", "")) / F.length(x["body"])).alias("digits"),
        ))

    def summed(x: Column) -> Column:
        n, size, codes = x["n"], x["size"], x["codes"]
        last = F.size(codes) - 1
        before, after = F.slice(codes, F.lit(1), last), F.slice(codes, F.lit(2), last)
        high = lambda c: F.when(c >= size / 2, 1.0).otherwise(0.0)
        squares = F.aggregate(F.array_distinct(x["chars"]), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.size(F.array_remove(x["chars"], c)), F.lit(2)))
        turns = total(F.zip_with(before, after, lambda a, b: F.abs(high(a) - high(b)))) + 1
        return let(total(codes) / n, lambda mean: F.struct(
            x["encoding"].alias("encoding"), n.alias("n"), size.alias("size"), x["digits"].alias("digits"), squares.alias("squares"), total(F.transform(codes, high)).alias("high"), turns.alias("turns"),
            total(F.transform(codes, lambda c: (c - mean) * (c - mean))).alias("spread"), total(F.zip_with(before, after, lambda a, b: (a - mean) * (b - mean))).alias("lagged"),
        ))

    def tested(x: Column) -> Column:
        n, size = x["n"], x["size"]
        p_chi = _tail((size * x["squares"] / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n))
        both = 2 * x["high"] * (n - x["high"])
        variance = both * (both - n) / (n * n * (n - 1))
        p_runs = F.when((both == 0) | (variance <= 0), 0.0).otherwise(2 * _tail(F.abs(x["turns"] - both / n - 1) / F.sqrt(variance)))
        p_serial = F.when(x["spread"] <= 0, 0.0).otherwise(2 * _tail(F.abs(x["lagged"] / x["spread"] + 1 / (n - 1)) * F.sqrt(n)))
        pairs = n * (n - 1) / 2
        met = (pairs * TEXT_SQUARES - (x["squares"] - n) / 2) / F.sqrt(pairs * TEXT_SQUARES * (1 - TEXT_SQUARES) + n * (n - 1) * (n - 2) * (TEXT_CUBES - TEXT_SQUARES**2))
        apart = F.when(x["digits"] > TEXT_DIGITS, x["digits"] * F.log(x["digits"] / TEXT_DIGITS) + F.when(x["digits"] < 1, (1 - x["digits"]) * F.log((1 - x["digits"]) / (1 - TEXT_DIGITS))).otherwise(0.0)).otherwise(0.0)
        p_text = F.least(F.lit(1.0), 2 * F.least(_tail(met), F.exp(-n * apart)))
        return F.struct(x["encoding"].alias("encoding"), n.cast("long").alias("n"), p_chi.alias("p_chi"), p_runs.alias("p_runs"), p_serial.alias("p_serial"), p_text.alias("p_text"))

    body = F.regexp_replace(token, "[=_-]+$", "")
    whole = let(let(let(let(body, inferred), coded), summed), tested)
    return F.when(F.length(body) >= 20, whole)


def simes(*p: str) -> Callable[[Column], Column]:
    """The combined p-value of a struct's fields: the least of len(p) / k times the k-th smallest."""
    return lambda x: let(F.sort_array(F.array(*[x[f] for f in p])), lambda s: F.least(F.lit(1.0), *[s[k] * len(p) / (k + 1) for k in range(len(p))]))


def log_bin(p: Column) -> Column:
    """Quarters of -log10 p, 0 to 400."""
    return F.least(F.lit(400), F.floor(-F.log10(F.greatest(p, F.lit(1e-100))) * 4)).cast("int")


def length_class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def edges(counts: dict[int, dict[int, int]], level: float) -> dict[int, int]:
    """Benjamini and Hochberg's rule for each class of lengths, from its counts by bin: the least bin that is rejected (401: none)."""
    out = {}
    for lengths, bins in counts.items():
        m, rank, out[lengths] = sum(bins.values()), 0, 401
        for k in sorted(bins, reverse=True):
            rank += bins[k]
            if 10.0 ** (-k / 4) <= level * rank / m:
                out[lengths] = k
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.001, fdr: float = 0.01) -> DataFrame:
    """One row for each of docs: id_col, base (spans of the patterns) and found (the battery's)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    rows = rows.select("id", "t", F.concat(spans("t", ASSIGN, 0, group=2, least=8), spans("t", ACCESS, 1), spans("t", HEX, 2)).alias("base"), spans("t", RUN, 3).alias("runs"))
    # A candidate that a pattern has already found adds nothing.
    rows = rows.withColumn("runs", F.filter("runs", lambda r: ~F.exists(F.col("base"), lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"]))))
    token = lambda r: F.substring(F.col("t"), (r["start"] + 1).cast("int"), (r["stop"] - r["start"]).cast("int"))
    result = lambda r, x: F.struct(r["start"].alias("start"), r["stop"].alias("stop"), length_class(x["n"]).alias("lengths"), log_bin(simes("p_chi", "p_runs", "p_serial")(x)).alias("uniform_bin"), log_bin(x["p_text"]).alias("text_bin"))
    runs = F.transform("runs", lambda r: let(battery(token(r)), lambda x: F.when(x.isNotNull(), result(r, x))))
    # Offsets and bins only: what was found is never written to the shared folder.
    rows = staged(rows.select("id", "base", F.filter(runs, lambda r: r.isNotNull()).alias("runs")), "secret-spans")

    bins = rows.select(F.explode("runs").alias("r")).select("r.lengths", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"r.{k}_bin").alias("bin")) for k in ("uniform", "text")])).alias("x"))
    counts: dict[str, dict[int, dict[int, int]]] = {"uniform": {}, "text": {}}
    for r in bins.groupBy("lengths", "x.rule", "x.bin").agg(F.count(F.lit(1)).alias("c")).collect():  # at most 32 lengths, 2 rules, 401 bins
        counts[r.rule].setdefault(r.lengths, {})[r.bin] = r.c
    limit = {rule: edges(counts[rule], level) for rule, level in (("uniform", alpha), ("text", fdr))}
    passes = lambda r: F.lit(False)
    if limit["text"]:
        of = {rule: F.create_map(*[F.lit(v) for kv in sorted(by.items()) for v in kv]) for rule, by in limit.items()}
        passes = lambda r: (r["uniform_bin"] < of["uniform"][r["lengths"]]) & (r["text_bin"] >= of["text"][r["lengths"]])
    found = F.transform(F.filter("runs", passes), lambda r: F.struct(F.lit(3).alias("kind"), r["start"].alias("start"), r["stop"].alias("stop")))
    return rows.select(F.col("id").alias(id_col), "base", found.cast(f"array<{SPAN}>").alias("found"))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir).select("doc_id", "text")).withColumn("all", F.concat("base", "found"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("all").alias("spans"))
