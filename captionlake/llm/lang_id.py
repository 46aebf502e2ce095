"""Language identification by segmentation-marginalised unigrams (operator 2).

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is the
sum, over all ways to cut it into pieces, of the product of the pieces' probabilities; a forward pass over the
word's characters gives that sum without listing the cuts. A text's score for a language is the sum of its
words' log probabilities and the language's log share of the training rows; the score of the answer is its
posterior.

Words of one length go through the forward pass together, as numpy arrays over words and languages: the
vocabulary is a trie whose steps are looked up for all of them at once. Each distinct word is scored once a task,
as long as the cache's bound allows, and a text gathers the figures of its words.

Fitting: at most `per_language` documents of each language, whole texts in the order of a hash, until they have
`max_bytes` of a language's text; piece probabilities are re-estimated from expected counts (forward and backward)
for a few rounds, over words of any length. This bounded sample is a documented parameter; scoring reads every row
whole. Each language is a column of the model: more than `most_languages` of them raise an error.

Nulls: a null text, or one without a letter, gives `und` and score 0. Rows with a null language or text don't
train. Without any training row every text is `und`. A word is a run of letters of any length. Repeated rows give
the same answer; of languages with equal scores the last in order is taken. Extra columns are carried by
`identify`; columns it adds replace ones of the same name.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, small_batches, without
from .textops import chunks, mix, points, values

MARK = "▁"
UNSEEN = 1e-7  # probability of a character outside the vocabulary
FLOOR = 2e-8  # and of a piece that a language was not seen with, besides its own
LONG = 64  # words over this length are passed alone, a block of their characters at a time
BLOCK = 100_000  # characters of such a word
TINY = 1e-120
CHUNK = 2_000_000  # bytes of text turned into arrays at once


def vocabulary(path: str) -> list[str]:
    """Piece strings of a sentencepiece model, without control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    return [m.id_to_piece(i) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


class Trie:
    """The vocabulary as a trie in an open hash table, so that steps are taken for whole arrays of words."""

    def __init__(self, pieces: list[str]):
        nodes: dict[str, int] = {"": 0}
        steps: dict[tuple[int, int], int] = {}
        piece = [-1]
        for i, p in enumerate(pieces):
            at = 0
            for k, c in enumerate(p):
                to = nodes.get(p[: k + 1])
                if to is None:
                    to = nodes[p[: k + 1]] = len(nodes)
                    piece.append(-1)
                    steps[at, ord(c)] = to
                at = to
            if p:
                piece[at] = i
        self.piece = np.array(piece, np.int32)
        self.longest = max(map(len, pieces), default=1)
        size = 1 << max(8, (4 * len(steps)).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        keys = np.array([(a << 21) | c for a, c in steps], np.int64)
        for key, to, h in zip(keys.tolist(), steps.values(), self._home(keys).tolist()):
            while self.keys[h] >= 0:
                h = (h + 1) & int(self.mask)
            self.keys[h], self.to[h] = key, to

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys.view(np.uint64)).view(np.int64) & self.mask

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node reached from each node by a character, or -1."""
        keys = (nodes.astype(np.int64) << np.int64(21)) | chars
        h = self._home(keys)
        got = self.keys[h]
        out = np.where(got == keys, self.to[h], -1)
        rest = np.flatnonzero((got != keys) & (got >= 0))
        while len(rest):
            h[rest] = (h[rest] + 1) & self.mask
            got = self.keys[h[rest]]
            hit = got == keys[rest]
            out[rest[hit]] = self.to[h[rest[hit]]]
            rest = rest[~hit & (got >= 0)]
        return out

    def edges(self, words: np.ndarray):
        """(from, to, rows, pieces) of every piece in words of one length, in the order of from; piece -1 is a
        character that is no piece."""
        n_words, n = words.shape
        every = np.arange(n_words)
        for i in range(n):
            rows, nodes = every, np.zeros(n_words, np.int64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                nodes = self.step(nodes, words[rows, j - 1])
                live = nodes >= 0
                if j == i + 1:
                    single = np.full(n_words, -1, np.int32)
                    single[live] = self.piece[nodes[live]]
                    yield i, j, every, single
                rows, nodes = rows[live], nodes[live]
                if not len(rows):
                    break
                if j > i + 1:
                    pieces = self.piece[nodes]
                    full = pieces >= 0
                    if full.any():
                        yield i, j, rows[full], pieces[full]

    def lattice(self, word: np.ndarray, lo: int, hi: int):
        """(from, to, pieces) of every piece in one word that starts at lo or after it and before hi, all starts at
        once, in the order of from."""
        at, nodes = np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        found = []
        for k in range(1, self.longest + 1):
            inside = at + k <= len(word)
            at = at[inside]
            nodes = self.step(nodes[inside], word[at + k - 1])
            live = nodes >= 0
            pieces = np.where(live, self.piece[nodes], -1)
            keep = np.ones(len(at), bool) if k == 1 else pieces >= 0
            found.append((at[keep], at[keep] + k, pieces[keep]))
            at, nodes = at[live], nodes[live]
            if not len(at):
                break
        first, to, pieces = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(first, kind="stable")
        return first[order], to[order], pieces[order]


def forward(edges, n: int, n_words: int, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums (place, word, language) and how often each of them (place, word) was divided by TINY. probs has a row
    for each piece, and a last one for characters that are none."""
    alpha = np.zeros((n + 1, n_words, probs.shape[1]))
    alpha[0] = 1
    turns = np.zeros((n + 1, n_words), np.int16)
    at = 0
    for i, j, rows, pieces in edges:
        if i != at and i % 8 == 0:  # keep long words inside the range of doubles
            top = alpha[i].max(axis=1)
            small = np.flatnonzero((top < TINY) & (top > 0))
            if len(small):
                alpha[i:, small] /= TINY
                turns[i:, small] += 1
        at = i
        if len(rows) == n_words:
            alpha[j] += alpha[i] * probs[pieces]
        else:
            alpha[j, rows] += alpha[i, rows] * probs[pieces]
    return alpha, turns


class Model:
    """Languages, pieces, their probabilities by language (a row a piece) and the languages' log shares."""

    MOST = 300_000  # words in the cache, some 60 MB

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray, priors: list[float]):
        self.langs, self.pieces, self.priors = langs, pieces, priors
        self.probs = np.vstack([probs, np.full((1, len(langs)), UNSEEN)])
        self.trie = Trie(pieces)
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.forget()

    def __getstate__(self):
        return self.langs, self.pieces, self.probs[:-1], self.priors

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.known = np.zeros((0, len(self.langs)))

    def words(self, words: np.ndarray) -> np.ndarray:
        """Log probability, by language, of words of one length (characters as numbers, a row a word)."""
        s = np.concatenate([np.full((len(words), 1), ord(MARK), words.dtype), words], axis=1)
        alpha, turns = forward(self.trie.edges(s), s.shape[1], len(s), self.probs)
        return np.log(np.maximum(alpha[-1], 1e-300)) + turns[-1][:, None] * math.log(TINY)

    def long_word(self, word: str) -> np.ndarray:
        """The same of one word, a block of its characters at a time, keeping only the sums that later ones need."""
        s, longest = points(MARK + word), self.trie.longest
        ahead = np.zeros((longest, len(self.langs)))
        ahead[0] = 1
        turns = 0
        for lo in range(0, len(s), BLOCK):
            hi = min(len(s), lo + BLOCK)
            first, to, pieces = self.trie.lattice(s, lo, hi)
            probs, cut = self.probs[pieces], np.searchsorted(first, np.arange(lo, hi + 1)).tolist()
            to -= lo
            alpha = np.concatenate([ahead, np.zeros((hi - lo, len(self.langs)))])
            for i in range(hi - lo):
                if i % 8 == 0 and 0 < alpha[i].max() < TINY:
                    alpha[i : i + longest] /= TINY
                    turns += 1
                alpha[to[cut[i] : cut[i + 1]]] += alpha[i] * probs[cut[i] : cut[i + 1]]
            ahead = alpha[hi - lo :]
        return np.log(np.maximum(ahead[0], 1e-300)) + turns * math.log(TINY)

    def learn(self, new: list[bytes]) -> None:
        """Score words that the cache lacks, those of one length together."""
        sizes = np.fromiter(map(len, new), np.int64, len(new)) // 4
        order = np.argsort(sizes, kind="stable")
        got = np.zeros((len(new), len(self.langs)))
        for size in np.unique(sizes).tolist():
            rows = order[np.searchsorted(sizes[order], size) : np.searchsorted(sizes[order], size, side="right")]
            if size > LONG:
                for r in rows:
                    got[r] = self.long_word(new[r].decode("utf-32-le", "surrogatepass"))
                continue
            flat = np.frombuffer(b"".join([new[r] for r in rows]), np.uint32).reshape(-1, size)
            for at in range(0, len(rows), 4000):
                got[rows[at : at + 4000]] = self.words(flat[at : at + 4000])
        self.slot.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.known = np.concatenate([self.known, got])

    def scores(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its posterior."""
        import pyarrow as pa

        if not self.langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        low = [t.lower() for t in texts]
        codes = points("\n".join(low) + "\n")
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
        inside = self.letter[codes]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum((last - first) * 4, out=offsets[1:])
        words = pa.Array.from_buffers(
            pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(codes[inside])]
        ).dictionary_encode()
        names = values(words.dictionary)
        new = [w for w in names if w not in self.slot]
        if len(self.slot) + len(new) > self.MOST:
            self.forget()
            new = names
        self.learn(new)
        rows = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        per = self.known[rows][words.indices.to_numpy()]
        cut = np.searchsorted(first, ends)
        total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(per, axis=0)])[np.concatenate([[0], cut])]
        z = np.diff(total, axis=0) + np.array(self.priors)
        best = len(self.langs) - 1 - np.argmax(z[:, ::-1], axis=1)
        share = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
        empty = np.diff(cut, prepend=0) == 0
        return [("und" if e else self.langs[b]) for e, b in zip(empty, best)], np.where(empty, 0.0, share)


def split(text: str) -> list[str]:
    """Words of a text as scoring finds them."""
    return "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")


def _expected(words: Counter, trie: Trie, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts of a language's words under probs (forward and backward passes). Backward sums are scaled as
    the forward sums of the same place, so that a product of both lacks only the turns between an edge's two ends."""
    out = np.zeros(len(probs))
    by_size: dict[int, list[str]] = {}
    for w in words:
        if w:
            by_size.setdefault(len(w), []).append(w)
    for size, group in sorted(by_size.items()):
        if size > LONG:
            for w in group:
                out += words[w] * _expected_alone(points(MARK + w), trie, probs)
            continue
        for at in range(0, len(group), 4000):
            part = group[at : at + 4000]
            s = np.concatenate([np.full((len(part), 1), ord(MARK), np.uint32), points("".join(part)).reshape(-1, size)], axis=1)
            count = np.array([words[w] for w in part], float)
            edges = list(trie.edges(s))
            alpha, turns = forward(edges, size + 1, len(s), probs[:, None])
            alpha = alpha[:, :, 0]
            up = TINY ** -np.arange(3.0)  # what an edge over that many turns lacks
            beta = np.zeros_like(alpha)
            beta[-1] = 1
            sure = alpha[-1] > 1e-280
            weight = np.where(sure, count / np.where(sure, alpha[-1], 1), 0)
            through = []
            for i, j, rows, pieces in reversed(edges):
                onward = probs[pieces] * beta[j, rows] * up[turns[j, rows] - turns[i, rows]]
                beta[i, rows] += onward
                through.append(onward)
            for (i, j, rows, pieces), onward in zip(edges, reversed(through)):
                out += np.bincount(pieces % len(probs), weight[rows] * alpha[i, rows] * onward, len(probs))
    return out


def _expected_alone(s: np.ndarray, trie: Trie, probs: np.ndarray) -> np.ndarray:
    """The same of one long word, told as plain numbers from place to place."""
    first, to, pieces = trie.lattice(s, 0, len(s))
    cut, ends, p = np.searchsorted(first, np.arange(len(s) + 1)).tolist(), to.tolist(), probs[pieces].tolist()
    alpha, turns, turn = [1.0] + [0.0] * len(s), [0] * (len(s) + 1), 0
    for i in range(len(s)):
        if i % 8 == 0 and 0 < alpha[i] < TINY:
            for j in range(i, min(len(s) + 1, i + trie.longest)):
                alpha[j] /= TINY
            turn += 1
        turns[i] = turn
        for e in range(cut[i], cut[i + 1]):
            alpha[ends[e]] += alpha[i] * p[e]
    turns[-1] = turn
    if not alpha[-1] > 1e-280:
        return np.zeros(len(probs))
    beta, onward = [0.0] * len(s) + [1.0], [0.0] * len(p)
    for i in range(len(s) - 1, -1, -1):
        for e in range(cut[i], cut[i + 1]):
            j = ends[e]
            onward[e] = p[e] * beta[j] * TINY ** (turns[i] - turns[j])
            beta[i] += onward[e]
    return np.bincount(pieces % len(probs), np.array(alpha)[first] / alpha[-1] * np.array(onward), len(probs))


def fit(
    docs: DataFrame, vocab: str, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 300, max_bytes: int = 3_000_000, rounds: int = 3, most_languages: int = 1000,
) -> Model:
    """Fit on rows where train holds. The driver gets at most per_language texts and max_bytes of text a language, and no
    more than most_languages, beyond which it raises ValueError."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("g"), F.col(text_col).alias("t"), F.col(id_col).cast("string").alias("i"))
    counts = {r[0]: r[1] for r in rows.groupBy("g").count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages in {lang_col}; name most_languages if they are meant")
    langs = sorted(counts)
    if not langs:
        return Model([], [], np.zeros((0, 0)), [])
    key = F.xxhash64(F.lit(11), F.coalesce("i", F.lit("")), "t")
    share = F.pmod(key, F.lit(1 << 20)) / F.lit(1 << 20)
    keep = F.lit(False)
    for g in langs:  # some more than wanted, so that only few rows are ranked
        keep = keep | ((F.col("g") == F.lit(g)) & (share < min(1.0, (3 * per_language + 100) / counts[g])))
    by_hash = Window.partitionBy("g").orderBy("h", "i", "n")
    sizes = rows.where(keep).select("g", key.alias("h"), "i", F.octet_length("t").alias("n"), "t")
    sizes = sizes.where(F.col("n") <= max_bytes).withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= per_language)
    sizes = sizes.withColumn("sum", F.sum("n").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    sample = sizes.where(F.col("sum") <= max_bytes).select("g", "t").collect()
    words: dict[str, Counter] = {g: Counter() for g in langs}
    for lang, text in sample:
        words[lang].update(split(text))
    pieces = vocabulary(vocab)
    trie = Trie(pieces)
    columns = []
    for g in langs:
        probs = np.array([*(1.0 / (1 + 4 ** len(p)) for p in pieces), UNSEEN])
        for _ in range(rounds):
            counted = _expected(words[g], trie, probs)
            total = counted.sum() or 1.0
            probs = np.append(np.where(counted[:-1] / total > 1e-9, counted[:-1] / total, 0), UNSEEN)
        columns.append(probs[:-1])
    table = np.stack(columns, axis=1) + FLOOR
    seen = [i for i, p in enumerate(pieces) if len(p) == 1 or table[i].max() > FLOOR]
    n = sum(counts.values())
    return Model(langs, [pieces[i] for i in seen], table[seen], [math.log((counts[g] + 1) / (n + len(langs))) for g in langs])


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with lang_col and score_col."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most the vocabulary's size
    rows = without(docs, lang_col, score_col)
    at = rows.columns.index(text_col)

    @lean
    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            texts = [t or "" for t in b.column(at).to_pylist()]
            langs, scores = [], [np.zeros(0)]
            for lo, hi in chunks(texts, CHUNK):
                names, got = m.scores(texts[lo:hi])
                langs += names
                scores.append(got)
            cols = [*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, lang_col, score_col])
        m.forget()

    schema = StructType(list(rows.schema.fields)).add(lang_col, "string").add(score_col, "double")
    return rows.mapInArrow(run, schema)
