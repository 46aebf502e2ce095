"""Spelling variants of a corpus' words, by pivotal grams (operator 12).

Words one edit apart share a gram. Grams of a word are ordered by how few words have them; its prefix is the three
rarest, and all that rank as the third. Of three bigrams two are disjoint; the pair that the fewest words have is chosen
by dynamic programming over their places. One edit spoils at most one of two disjoint grams, so with two words one edit
apart a pivot of the one whose prefix ends first stands in the other's prefix, moved by at most the edit.

Pivots are looked up among prefixes by place and length: an edit behind a gram leaves what is before it alone, and its
place; one in front of it leaves what is behind it. So a probe carries the text on the side that the edit spared; where
that is less than half of the word, also one half of the rest, of which the edit spares one. A gram that very many words
have is dealt by these texts: a group is words that share half of their characters. Only hashes of the texts are joined;
matches are verified by their edit distance.

The vocabulary is counted with partial sums; after that all work is on distinct words. Counts of grams (at most
MOST_GRAMS, the square of the alphabet) are broadcast.

Nulls, ties, odd rows: a null text has no words; a null id counts as an empty one where words are changed; repeated rows
count again; an empty table has no words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
MOST_GRAMS = (len(LOWER) + 0xFF - 0xC0 + 1) ** 2
PREFIX = 3  # grams of two characters that one edit can spoil, and one more


def with_slips(word: Column, doc_id: Column, one_in: int) -> Column:
    """The word, without one character where `one_in` divides the checksum of `<id>:<word>`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, slips: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): distinct maximal runs of letters, A to Z in lower case, of at least least_length characters and
    least_count occurrences. slips: before they are counted, one run in so many loses a character."""
    long = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    low = F.when(F.col("w").rlike("[A-Z]"), F.translate("w", UPPER, LOWER)).otherwise(F.col("w"))
    found = docs.select(F.col(id_col).alias("d"), F.explode(long).alias("w")).select("d", low.alias("w"))
    word = with_slips(F.col("w"), F.col("d"), slips) if slips else F.col("w")
    counted = found.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def pivots(places: list[tuple[int, int]]) -> tuple[int, int]:
    """Two places at least two apart with the least sum of counts, of (place, count) in order of place. The best pair that
    ends at a place is the count there and the least one that ends two or more before it."""
    best, least, waiting = None, None, []
    for p, n in places:
        while waiting and waiting[0][1] <= p - 2:
            least = min(filter(None, (least, waiting.pop(0))))
        if least and (best is None or least[0] + n < best[0]):
            best = (least[0] + n, least[1], p)
        waiting.append((n, p))
    return best[1:]


def _spared(name: str, own: int, other: int, part: str, rest: str, least: int) -> list[str]:
    """Keys of words that share `part`, of which one edit parts what else they have. A part of less than half a word is
    shared by many, so the rest is cut in two as well: the edit spares its first `least // 2` characters or its last ones."""
    if 2 * len(part) >= own:
        return [f"{name}{own}{part}"]
    half = least // 2
    return [f"{name}{own},{other}<{part},{rest[:half]}", f"{name}{own},{other}>{part},{rest[len(rest) - least + half :]}"]


def signatures(word: str, counts: dict[str, int]) -> Iterator[tuple[bool, str]]:
    """(probe, key): where the word stands in the index, and where it looks others up. Side l shares the text up to the end
    of a gram, side r the text from its start on; a key names the length of the word that stands there."""
    n = len(word)
    grams = [(counts[word[p : p + 2]], word[p : p + 2], p) for p in range(n - 1)]
    third = sorted(grams)[PREFIX - 1][:2]
    prefix = [(p, k) for k, g, p in grams if (k, g) <= third]
    sides = lambda p: (("l", word[: p + 2], word[p + 2 :]), ("r", word[p:], word[:p]))
    for p, _ in prefix:
        for name, part, rest in sides(p):
            keys = [_spared(name, n, m, part, rest, min(n, m) - len(part)) for m in (n - 1, n, n + 1) if m >= len(part)]
            for key in dict.fromkeys(x for ks in keys for x in ks):
                yield False, key
    for p in pivots(prefix):
        for name, part, rest in sides(p):
            for m in (n - 1, n, n + 1):
                if m >= len(part):
                    for key in _spared(name, m, n, part, rest, min(n, m) - len(part)):
                        yield True, key


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, m): all pairs of words, in both orders, that one inserted, deleted or replaced character parts.
    words: (word, n), distinct, of at least four characters."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda p: F.substring("word", p, F.lit(2)))).alias("g")
    rows = words.select(gram).groupBy("g").agg(F.count("*").alias("k")).limit(MOST_GRAMS + 1).collect()
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} grams: words have other letters than {LETTERS}")
    counts = words.sparkSession.sparkContext.broadcast({r.g: r.k for r in rows})

    @lean
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [list(signatures(w, counts.value)) for w in b.column(0).to_pylist()]
            of = pa.array([i for i, ks in enumerate(out) for _ in ks], pa.int32())
            probe, key = pa.array([k[0] for ks in out for k in ks], pa.bool_()), pa.array([k[1] for ks in out for k in ks], pa.string())
            yield pa.RecordBatch.from_arrays([probe, key, b.column(0).take(of), b.column(1).take(of)], names=["probe", "key", "word", "n"])

    signed = words.select("word", "n").mapInArrow(run, "probe boolean, key string, word string, n long").withColumn("key", F.xxhash64("key"))
    asked = signed.where("probe").select("key", "word", "n")
    index = signed.where("not probe").select("key", F.col("word").alias("other"), F.col("n").alias("m"))
    near = asked.join(index, "key").where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    back = F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"))
    return near.select(F.explode(F.array(F.struct("word", "n", "other", "m"), back)).alias("x")).select("x.*").distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form, n, form_n), every form being at least five times as frequent as its word: forms are
    followed to the last, twice as far each round. The rounds that this takes follow from the largest count."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    seen = forms.agg(F.min("n"), F.max("form_n")).first()
    steps = int(math.log(seen[1] / seen[0], 5)) + 1 if seen[0] else 1
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return now


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words: (word, n). A word's form is the most frequent word one edit away
    (the first in order of characters, of several), if that has at least `times` (5 or more) the word's occurrences."""
    if times < 5:
        raise ValueError("forms must be at least five times as frequent")
    words = stored(words)
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("x")
    near = stored(near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best).select("word", "n", "n_near", F.col("x.form").alias("form"), (-F.col("x.m")).alias("form_n")))
    forms = near.where(F.col("form_n") >= F.col("n") * times)
    shown = near.select("word", "n_near").join(forms.select("word", "form", "form_n"), "word", "left").join(roots_of(forms), "word", "left")
    out = words.join(shown, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
