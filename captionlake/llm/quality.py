"""Quality classifier on supervised subword embeddings (operator 9).

A document's features are its words and their character n-grams (3 to 5 characters, with the white space at a
word's edge as boundary), hashed into a fixed number of buckets. Each bucket has a learned vector; a document is the
average of its features' vectors, and a softmax layer over that average gives the class probabilities. Vectors
and layer are trained by stochastic gradient descent in numpy.

Averaging is linear, so for scoring the layer is folded into the buckets: each bucket becomes one number (the
difference of the two classes' logits) and a document's logit is the average of its features' numbers plus a
bias. That is the same function, read in one pass over the characters.

Fitting: at most `max_rows` labelled rows, whole texts in the order of a hash, until they have `max_bytes` of text: a
documented bound; scoring reads every row whole.

Nulls: a null text is empty; a text without features gets the bias alone. Labels or ids that are null don't
train; without both labels the score is the share of label 1, or 0.5. Extra columns are carried by `score`;
columns it adds replace ones of the same name. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, stored, without
from .textops import Rolling, chunks, points

GRAMS = (3, 4, 5)


def features(texts: list[str], log2: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of all features of the texts, and how many belong to each text, in order."""
    data = points(" " + " ".join(texts) + " ").copy()
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    data[blank] = 32
    roll = Rolling(data)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)  # index of the blank after each text
    shift = np.uint64(64 - log2)
    inner = np.concatenate([[0], np.cumsum(blank)])
    found, where = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        start = np.flatnonzero(inner[n - 1 : len(data)] [: len(data) - n + 1] - inner[1 : len(data) - n + 2] == 0)
        found.append((roll.grams(n)[start] >> shift).astype(np.int32))
        where.append(np.bincount(np.searchsorted(ends, start + 1, side="right"), minlength=len(texts))[: len(texts)])
    word = np.diff((~blank).astype(np.int8), prepend=0, append=0)
    s, e = np.flatnonzero(word == 1), np.flatnonzero(word == -1)
    found.append((roll.span(s, e) >> shift).astype(np.int32))
    where.append(np.bincount(np.searchsorted(ends, s, side="right"), minlength=len(texts))[: len(texts)])
    return found, where


class Classifier:
    def __init__(self, log2: int, values: np.ndarray, bias: float):
        self.log2, self.values, self.bias = log2, values, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lo, hi in chunks(texts):
            found, where = features(texts[lo:hi], self.log2)
            for buckets, per in zip(found, where):
                sums = np.concatenate([[0.0], np.cumsum(self.values[buckets], dtype=np.float64)])
                at = np.concatenate([[0], np.cumsum(per)])
                total[lo:hi] += sums[at[1:]] - sums[at[:-1]]
                n[lo:hi] += per
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(n, 1))))


def train(texts: list[str], labels: list[int], log2: int = 17, dim: int = 8, epochs: int = 5, rate: float = 1.0, seed: int = 5) -> Classifier:
    """Stochastic gradient descent, one document at a time, in a seeded order."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Classifier(log2, np.zeros(1 << log2, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    bags = []
    for t in texts:
        found, _ = features([t], log2)
        at, n = np.unique(np.concatenate(found), return_counts=True)
        bags.append((at, (n / max(1, n.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << log2, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 1 / np.sqrt(dim), (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = rate * (1 - done / steps)
            done += 1
            at, share = bags[i]
            hidden = share @ vectors[at] if len(at) else np.zeros(dim, np.float32)
            logit = layer @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            if len(at):
                # normalised by the shares' squares, so that long and short documents move their logits alike
                vectors[at] -= lr / (share @ share) * share[:, None] * (p @ layer)[None, :]
            layer -= lr * 0.1 * np.outer(p, hidden)
            bias -= lr * 0.1 * p
    w = layer[1] - layer[0]
    return Classifier(log2, vectors @ w, float(bias[1] - bias[0]))


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: Column, label_col: str, id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = 4000, max_bytes: int = 20_000_000,
) -> Classifier:
    """Fit on labelled rows where train_rows (over labels) holds: of at most max_rows of them, in the order of a hash, those
    whose whole texts fit into what is left of max_bytes; a longer one is passed over, and the next ones are tried. The
    driver gets the lengths of max_rows texts, and the texts that fit."""
    rows = labels.where(train_rows & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")
    )
    key = F.xxhash64(F.lit(29), F.col("__id"))
    n = rows.count()
    some = rows.where(F.pmod(key, F.lit(1 << 20)) / F.lit(1 << 20) < min(1.0, (1.2 * max_rows + 100) / max(n, 1)))  # more than wanted, so that few rows are ranked
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    by_hash = Window.orderBy("__h", "__id", "__label", "__n", F.xxhash64("__t"))
    got = texts.join(some.withColumn("__h", key), "__id").withColumn("__n", F.octet_length("__t"))
    got = got.withColumn("__r", F.row_number().over(by_hash)).where(F.col("__r") <= max_rows)
    got = stored(got.where(F.col("__n") <= max_bytes).select("__r", "__n", "__t", "__label"))
    fit_in, left = [], max_bytes
    for r in got.select("__r", "__n").orderBy("__r").collect():
        if r["__n"] <= left:
            fit_in.append(r["__r"])
            left -= r["__n"]
    got = got.where(F.col("__r").isin(fit_in)).orderBy("__r").collect()
    return train([r["__t"] for r in got], [r["__label"] for r in got])


def score(docs: DataFrame, model: Classifier, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with score (probability of label 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**log2 numbers
    rows = without(docs, "score", "predicted")
    at = rows.columns.index(text_col)

    @lean
    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            s = m.scores([t or "" for t in b.column(at).to_pylist()])
            cols = [*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("score", "double").add("predicted", "integer"))
