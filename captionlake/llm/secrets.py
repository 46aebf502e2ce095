"""Secret scans by a randomness test battery (operator 3), in DataFrame functions only.

Three fixed patterns find assigned values, access keys and long hex strings. The method adds `random` spans: runs
of token characters whose encoding is inferred (hex, base 32, base 36, base 64) and that behave like uniform draws
from that alphabet. Three tests can reject that: chi-squared uniformity of the symbols (Wilson-Hilferty normal
form), the runs test over the alphabet's halves, and lag-1 serial correlation. Their p-values are combined by the
Cauchy rule, which holds for tests that hang together, and the Benjamini-Hochberg step over all candidates of the
corpus says which strings are not random. What is left is compared with ordinary text, in which the character class
seldom changes: the p-value of the number of class changes goes through a second such step, and only what it
rejects as ordinary is a `random` span. Both steps are aware of length: a string's weight is its length over the mean
length of all candidates, so weights have a mean of one and longer strings, which tell more, may spend more of the
error budget. The steps need only counts of p-values in fixed bins, so at most BINS * BINS rows reach the driver.

Nulls: a null text is empty. Spans are code points, end exclusive; a pattern's matches are leftmost and don't
overlap within a kind. Extra columns are carried; columns that are added replace ones of the same name. Repeated
rows are scanned alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, without

# The three patterns, in the order of their kinds, and the least length of what counts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"  # what is shorter fails anyway
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
BINS, STEP = 200, 0.2  # of -log10 of a weighted p-value
NOT_RANDOM, NOT_TEXT = 0.01, 0.001  # false-discovery rates of the two steps
CHANGE_RATE = 0.12  # of character classes in ordinary text

#: places where one class of characters ends
CHANGE = "(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])|(?<=[^a-zA-Z0-9])(?=[a-zA-Z0-9])"
MADE = ("assign", "value", "access", "hex", "loose", "verdict")  # helper columns

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding -> (pattern of the whole string, alphabet)
ENCODINGS = {
    "hex": (r"^[0-9a-f]+$", DIGIT + LOWER[:6]),
    "hex_upper": (r"^[0-9A-F]+$", DIGIT + UPPER[:6]),
    "base32": (r"^[A-Z2-7]+$", UPPER + "234567"),
    "base36": (r"^[a-z0-9]+$", DIGIT + LOWER),
    "base64": (r"^[A-Za-z0-9+/_-]+$", DIGIT + UPPER + LOWER + "+/"),
}


def _starts(text: Column, pattern: str, found: Column) -> Column:
    """Start of every match: the lengths of what lies between matches and of the matches, summed up."""
    between = F.split(text, pattern, -1)
    gaps = F.transform(F.slice(between, 1, F.size(found)), F.length)
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), F.length(m).alias("m")))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("done"), F.array().cast("array<int>").alias("part"))

    def step(acc, x):
        full = F.size(acc["part"]) >= 200  # two levels, so that appending stays cheap in texts with many matches
        part = F.when(full, F.array(acc["pos"] + x["g"])).otherwise(F.concat(acc["part"], F.array(acc["pos"] + x["g"])))
        done = F.when(full, F.concat(acc["done"], acc["part"])).otherwise(acc["done"])
        return F.struct((acc["pos"] + x["g"] + x["m"]).alias("pos"), done.alias("done"), part.alias("part"))

    return F.aggregate(steps, zero, step, lambda acc: F.concat(acc["done"], acc["part"]))


SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, found: Column, keep: Column | None = None) -> Column:
    """Spans of the found matches; keep: an array of booleans beside them."""
    judged = F.transform(found, lambda m: F.lit(True)) if keep is None else keep
    rows = F.zip_with(
        _starts(text, pattern, found), F.arrays_zip(found.alias("m"), judged.alias("k")),
        lambda s, x: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(x["m"])).alias("end"), x["k"].alias("k")),
    )
    kept = F.filter(rows, lambda r: r["k"])
    spans = F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal (Abramowitz and Stegun 26.2.17; for large z its leading term)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _inferred(s: Column) -> Column:
    """struct(core, alphabet, n): a candidate without its padding, and its encoding's alphabet or null."""
    core = F.regexp_replace(s, "=+$", "")
    mixed = core.rlike("[0-9]") & core.rlike("[A-Za-z]")
    cases = core.rlike("[A-Z]") & core.rlike("[a-z]")
    alphabet = F.lit(None).cast("string")
    for name, (pattern, letters) in reversed(ENCODINGS.items()):
        fits = core.rlike(pattern) & cases if name == "base64" else core.rlike(pattern)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
    return F.struct(core.alias("core"), F.when(mixed, alphabet).alias("alphabet"), F.length(core).cast("double").alias("n"))


def _symbols(x: Column) -> Column:
    """struct(core, n, k, codes, squares, halves): symbols as numbers, the sum of squared symbol counts, and
    which half of the alphabet each symbol is from."""
    plain, alphabet = F.translate(x["core"], "-_", "+/"), x["alphabet"]
    k = F.length(alphabet).cast("double")
    codes = F.transform(F.split(plain, ""), lambda c: F.instr(alphabet, c).cast("double") - 1)
    counts = F.transform(F.split(alphabet, ""), lambda c: (x["n"] - F.length(F.replace(plain, c, F.lit("")))).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    return F.struct(x["core"].alias("core"), x["n"].alias("n"), k.alias("k"), codes.alias("codes"), squares.alias("squares"))


def _sums(x: Column) -> Column:
    """struct of the figures that the tests need."""
    codes, size = x["codes"], F.size(x["codes"])
    halves = F.array_join(F.transform(codes, lambda c: F.when(c < x["k"] / 2, "0").otherwise("1")), "")
    lagged = F.zip_with(F.slice(codes, F.lit(1), size - 1), F.slice(codes, F.lit(2), size - 1), lambda a, b: a * b)
    add = lambda a, c: a + c
    changes = F.regexp_count(x["core"], F.lit(CHANGE)) - 1  # the end counts as a change
    return F.struct(
        x["n"].alias("n"), x["k"].alias("k"), (x["squares"] * x["k"] / x["n"] - x["n"]).alias("chi"), halves.alias("halves"),
        F.length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double").alias("ones"), changes.alias("changes"),
        F.aggregate(codes, F.lit(0.0), add).alias("total"), F.aggregate(lagged, F.lit(0.0), add).alias("cross"),
        F.aggregate(codes, F.lit(0.0), lambda a, c: a + c * c).alias("sumsq"),
    )


def _scores(x: Column) -> Column:
    """struct of the normal scores of the battery and of the class changes."""
    n, df = x["n"], x["k"] - 1
    chi = (F.pow(x["chi"] / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    mean = 2 * x["ones"] * (n - x["ones"]) / n  # expected runs, less one
    runs = F.regexp_count(x["halves"], F.lit("01")) + F.regexp_count(x["halves"], F.lit("10"))
    spread = x["sumsq"] - x["total"] * x["total"] / n
    usual = (n - 1) * CHANGE_RATE
    return F.struct(
        n.alias("n"), chi.alias("chi"),
        F.when(mean > 1, F.abs(runs - mean) / F.sqrt(mean * (mean - 1) / (n - 1))).otherwise(9.0).alias("runs"),
        F.when(spread > 0, F.abs(x["cross"] - x["total"] * x["total"] / n) / spread * F.sqrt(n)).otherwise(9.0).alias("serial"),
        ((x["changes"] - usual) / F.sqrt(usual * (1 - CHANGE_RATE))).alias("changes"),
    )


def _verdict(x: Column) -> Column:
    """struct(n, battery, text): the length, the battery's combined p-value and that of the class changes."""
    cauchy = lambda p: F.tan((0.5 - F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))) * math.pi)
    mean = (cauchy(_tail(x["chi"])) + cauchy(2 * _tail(x["runs"])) + cauchy(2 * _tail(x["serial"]))) / 3
    battery = F.when(mean > 1e4, 1 / (mean * math.pi)).otherwise(0.5 - F.atan(mean) / math.pi)
    return F.struct(x["n"].alias("n"), battery.alias("battery"), F.greatest(_tail(x["changes"]), F.lit(1e-45)).alias("text"))


def _bin(p: Column, n: Column, mean_length: float) -> Column:
    """The bin of a p-value over its weight."""
    return F.least(F.greatest(F.floor(-F.log10(p * mean_length / n) / STEP), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _judged(found: Column) -> Column:
    """A verdict for each candidate, null where no encoding is inferred. Each step reads the one before, so
    that no expression is written out twice."""
    known = F.transform(found, _inferred)
    steps = F.transform(known, lambda x: F.when(x["alphabet"].isNotNull(), _symbols(x)))
    for f in (_sums, _scores, _verdict):
        steps = F.transform(steps, _where_known(f))
    return steps


def _where_known(f):
    return lambda x: F.when(x.isNotNull(), f(x))


def _least_rejected(counts: dict[int, int], rate: float) -> int:
    """The least bin that the Benjamini-Hochberg step rejects, of counts of hypotheses by bin; BINS if none."""
    total, above, cut = sum(counts.values()), 0, BINS
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if 10 ** (-b * STEP) <= rate * above / total:
            cut = b
    return cut


def discovery(docs: DataFrame, text_col: str = "text") -> tuple[float, int, int]:
    """Mean length of the candidates, the battery's bin from which a string isn't random, and the bin of class changes
    from which it isn't text, over all of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("s")).where(F.size("s") > 0)
    known = found.select(F.explode(F.transform("s", _inferred)).alias("x")).where("x.alphabet is not null")
    mean = known.agg(F.avg("x.n")).first()[0] or 1.0
    judged = found.select(F.explode(_judged(F.col("s"))).alias("v")).where("v is not null")
    bins = judged.select(_bin(F.col("v.battery"), F.col("v.n"), mean).alias("battery"), _bin(F.col("v.text"), F.col("v.n"), mean).alias("text"))
    counts = bins.groupBy("battery", "text").count().collect()
    by = lambda name, rows: {b: sum(r["count"] for r in rows if r[name] == b) for b in {r[name] for r in rows}}
    not_random = _least_rejected(by("battery", counts), NOT_RANDOM)
    return mean, not_random, _least_rejected(by("text", [r for r in counts if r["battery"] < not_random]), NOT_TEXT)


def scan(docs: DataFrame, text_col: str = "text", cuts: tuple[float, int, int] | None = None, spans_col: str = "all_spans") -> DataFrame:
    """docs with spans_col, an array of (start, kind, end) in order; kind indexes KINDS."""
    mean, not_random, not_text = discovery(docs, text_col) if cuts is None else cuts
    rows = without(docs, spans_col)
    names = [fresh(f"secret_{m}", rows.columns) for m in MADE]
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = lambda pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    made = dict(zip(names, (every(ASSIGN), every(ASSIGN, 2), every(ACCESS), every(HEX), every(CANDIDATE))))
    rows = rows.withColumns(made).withColumn(names[5], _judged(F.col(names[4])))
    assign, value, access, hexes, loose, verdict = map(F.col, names)
    spans = F.concat(
        _spans(text, ASSIGN, 0, assign, F.transform(value, lambda v: F.length(v) >= LEAST_ASSIGN)),
        _spans(text, ACCESS, 1, access, F.transform(access, lambda v: F.length(v) >= LEAST_ACCESS)),
        _spans(text, HEX, 2, hexes),
        _spans(text, CANDIDATE, 3, loose, F.transform(verdict, lambda v: F.coalesce((_bin(v["battery"], v["n"], mean) < not_random) & (_bin(v["text"], v["n"], mean) >= not_text), F.lit(False)))),
    )
    return rows.withColumn(spans_col, F.array_sort(spans)).drop(*names)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", F.get(names, r["kind"]), r["start"].cast("string"), r["end"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of scan's rows."""
    spans = F.col("all_spans")
    n = lambda k: F.size(F.filter(spans, lambda r: r["kind"] == k)).cast("long")
    base = joined(F.filter(spans, lambda r: r["kind"] < 3))
    return scanned.select(
        id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "<secret>", spans_col: str = "all_spans") -> DataFrame:
    """Texts with every span (overlapping ones as one) replaced by a mark; spans_col is dropped."""
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<lo:int,hi:int>>").alias("kept"))

    def step(acc, x):
        gap = F.struct(acc["end"].alias("lo"), x["start"].alias("hi"))
        return F.struct(
            F.greatest(acc["end"], x["end"]).alias("end"),
            F.when((x["start"] >= acc["end"]) & ((x["start"] > acc["end"]) | (acc["end"] == 0)), F.concat(acc["kept"], F.array(gap)))
            .otherwise(acc["kept"]).alias("kept"),
        )

    text = F.col(text_col)
    last = lambda acc: F.concat(acc["kept"], F.array(F.struct(acc["end"].alias("lo"), F.length(text).alias("hi"))))
    parts = F.aggregate(F.col(spans_col), zero, step, last)
    clean = F.array_join(F.transform(parts, lambda p: F.substring(text, p["lo"] + 1, p["hi"] - p["lo"])), mark)
    return scanned.withColumn(text_col, F.when(F.size(spans_col) > 0, clean).otherwise(text)).drop(spans_col)
