"""Periodic runs of words, by internal pattern matching (operator 13).

A run is a stretch of words with smallest period q, at least 4 q and LEAST words long, that no neighbouring word extends.
The words of a block of documents are one sequence, in which words of different documents differ. Its suffixes are sorted
by doubling; after k rounds equal blocks of 2**k words stand next to one another, which is the interval of a block in the
suffix array. A wavelet matrix over the array finds, in an interval, the least position that isn't less than a given one.

A run of period q with 2**(k-1) < q <= 2**k holds a dyadic block of 2**k words, near its start, whose next occurrence is
still in the run. Occurrences of a block in a window of its own length are a progression, and their difference is the
smallest period of what they cover. So each block asks for its next occurrence in the window behind it; the difference
is a candidate period, which is extended both ways by the names of dyadic blocks, from the longest to the shortest.
Blocks that don't occur as often as a run's must aren't asked for.

There is no shuffle: a document is a row, and a task holds one block of documents of at most WORDS words, or a single
longer one. A document of n words takes some 150 bytes a word, and 4 more for each round of doubling in which anything
repeats.

Nulls, odd rows: a null text has no words and no runs; a document without a run keeps all its words; a null id is kept,
and its words aren't changed; repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .textops import values

LEAST, TIMES = 6, 4
WORDS = 100_000
RUNS = "array<struct<start:long,length:long,period:long>>"


class WaveletMatrix:
    """Values below 2**bits in their order; counts and order statistics of intervals, for arrays of queries at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, now = [], values
        for bit in range(bits - 1, -1, -1):
            ones = (now >> bit) & 1
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(now) - int(before[-1])
            self.levels.append((bit, before, zeros))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def less(self, lo: np.ndarray, hi: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are less."""
        out = np.zeros(len(lo), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            one = (than >> bit) & 1 == 1
            out += np.where(one, (hi - lo) - (b - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return out

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of [lo, hi) that n others are less than."""
        out = np.zeros(len(lo), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            low = (hi - lo) - (b - a)
            one = n >= low
            out |= one.astype(np.int64) << bit
            n = np.where(one, n - low, n)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return out


def sorted_suffixes(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(array, names): suffixes in order, and for each k, as far as any block of 2**k words repeats, the first place of
    the interval of the block that starts at a position. Blocks end at ends (one for each position); a block that would go
    on is in an interval of its own."""
    n = len(keys)
    array = np.argsort(keys, kind="stable").astype(np.int64)
    slots = np.arange(n)
    group, part = keys[array], np.zeros(n, np.int64)
    head = np.zeros(n, np.int64)
    names, size, at = [], 1, array
    while True:
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (part[1:] != part[:-1])
        first = slots[np.flatnonzero(new)]
        head[at] = first[np.cumsum(new) - 1] if len(at) else first
        again = ~new
        again[:-1] |= ~new[1:]
        slots, at = slots[again], at[again]
        if not len(at):
            return array, names
        names.append(head.astype(np.int32))
        group = head[at]
        inside = at + 2 * size <= ends[at]
        part = np.where(inside, head[np.minimum(at + size, n - 1)], -1 - at)
        order = np.lexsort((part, group))
        at, group, part = at[order], group[order], part[order]
        array[slots] = at
        size *= 2


def find_runs(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs. keys: a number for each word, different between documents; starts and ends:
    those of its document, for each word."""
    n = len(keys)
    nothing = (np.zeros(0, np.int64),) * 3
    if n < LEAST:
        return nothing
    array, names = sorted_suffixes(keys, ends)
    if not names:
        return nothing
    tree, found = None, []
    for k, head in enumerate(names):
        size = 1 << k
        # a block of 2**k words that starts in the first `step` words of a run of period q > 2**(k-1) ends, q words on, in it
        step = size if k < 4 else size // 2
        shortest = size // 2 + 1
        least = max(2, (max(LEAST, TIMES * shortest) - size - shortest + 1) // shortest + 1)  # occurrences in the shortest run
        at = np.arange(0, n, step)
        often = np.bincount(head, minlength=n)
        lo = head[at].astype(np.int64)
        asked = often[lo] >= least
        at, lo = at[asked], lo[asked]
        if not len(at):
            continue
        tree = tree or WaveletMatrix(array, n.bit_length())
        hi = lo + often[lo]
        rank = tree.less(lo, hi, at + 1)
        there = rank < hi - lo
        at = at[there]
        d = tree.nth(lo[there], hi[there], rank[there]) - at
        near = (d <= size) & (d >= shortest)
        found.append((at[near], d[near]))
    at, d = (np.concatenate(x) for x in zip(*found)) if found else nothing[:2]
    right, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(len(names) - 1, -1, -1):
        head, size = names[k], 1 << k
        i = np.minimum(at + right, n - 1)
        j = np.minimum(at + right + d, n - 1)
        right += np.where((at + right + d + size <= ends[at]) & (head[i] == head[j]), size, 0)
        i = at - left - size
        left += np.where((i >= starts[at]) & (head[np.maximum(i, 0)] == head[np.maximum(i, 0) + d]), size, 0)
    start, length = at - left, left + right + d
    keep = (length >= LEAST) & (length >= TIMES * d)
    runs = np.unique(np.stack([start[keep], d[keep], length[keep]], 1), axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def looped(words: list, doc_id: int | None) -> list:
    """The words of one document in ten, by the checksum of its id, go round in a loop from some word on."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def runs_of(docs: list[list[bytes]]) -> list[tuple[list[dict], list[bytes]]]:
    """(runs, words kept) of each list of words."""
    table = defaultdict(count().__next__)
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.array([table[w] for d in docs for w in d], np.int64)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(docs)), sizes)
    start, length, period = find_runs(doc * len(table) + ids, first[doc], (first + sizes)[doc])
    out = [([], d) for d in docs]
    of = doc[start]
    for k in np.unique(of):
        mine = slice(*np.searchsorted(of, [k, k + 1]))
        s, n, q = start[mine] - first[k], length[mine], period[mine]
        change = np.zeros(sizes[k] + 1, np.int64)
        np.add.at(change, s + q, 1)
        np.add.at(change, s + n, -1)
        kept = np.cumsum(change[:-1]) == 0
        runs = [dict(start=a, length=b, period=c) for a, b, c in zip(s.tolist(), n.tolist(), q.tolist())]
        out[k] = (runs, [w for w, keep in zip(docs[k], kept.tolist()) if keep])
    return out


def detect(docs: DataFrame, loops: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: the runs by start, then period, and the text, words joined by single
    spaces, without the words that repeat what a run's first period says. loops: words are changed by `looped` before."""
    small_batches(docs.sparkSession)

    @lean
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            ids, texts = b.column(0), values(b.column(1))
            split = (t.split() for t in texts)  # bytes are split at blanks and the characters 9 to 13
            block, size, at = [], 0, 0
            for i, words in enumerate(split):
                block.append(looped(words, ids[i].as_py()) if loops else words)
                size += len(words)
                if size > WORDS or i + 1 == len(texts):
                    got = runs_of(block)
                    cols = [pa.array([len(w) for w in block], pa.int64()), pa.array([r for r, _ in got], kind), pa.array([b" ".join(w) for _, w in got], pa.binary())]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(block)), *cols], names=[id_col, "n_words", "runs", "collapsed"])
                    block, size, at = [], 0, i + 1

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    found = rows.mapInArrow(run, f"{id_col} long, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, exactly; of several the first."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what detect returns."""
    best = strongest(F.col("runs"))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = found.withColumn("x", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("x.start").alias("start"), F.col("x.length").alias("length"), F.col("x.period").alias("period"),
        F.expr("1000 * x.length div x.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
