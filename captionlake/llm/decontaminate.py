"""Benchmark decontamination on a distributed positional inverted index (operator 6).

Documents are indexed where they lie, once for the whole benchmark: each task writes segments of a few MB of text, and
a segment stores, for every term that it and the benchmark may share, its sorted positions in the segment (documents
follow each other with a gap, so one number is document and position). Which terms those are is told by a bitmap of
the benchmark's terms; others can't be asked for. Document frequencies are summed over all segments. A phrase is then
looked up in each segment from its rarest terms: the list of the rarest one, shifted by the term's place in the
phrase, is intersected with the next ones' shifted lists until it is empty or all terms agree. `slop` > 0 asks for
proximity: each term within that many words of its place. No posting leaves its segment, so no key gathers rows.

The benchmark is read in blocks of at most `block_bytes` of text (checked), each broadcast as numbers of terms (about
seven times its text) and looked up in the one index; with more than one block, the blocks' hits are merged per
document row. Terms are 64-bit hashes of words; a phrase needs all of its terms in place.

Words: A-Z lower-cased, runs of 0-9, a-z and all characters from U+0080. A null or empty text has no words and no
hits; items that are null, without words, or without an id have no windows. Repeated documents and items count one
by one. An empty benchmark contaminates nothing. Extra columns are ignored. A long text is one segment of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, bitmap_of, bits_for, lean, small_batches, stored
from .textops import Rolling, chunks, word_spans

FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256)
)
GAP = 64  # positions between documents; slop must stay below
SEGMENT_BYTES = 2_000_000
LAST = np.int32(2**31 - 1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in order, and how many each text has."""
    data = np.frombuffer(b" ".join(t.translate(FOLD) for t in texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    s, e, doc = word_spans(data != 32, np.cumsum(sizes) - sizes)
    return Rolling(data).span(s, e), np.bincount(doc, minlength=len(texts))[: len(texts)]


class Phrases:
    """Windows of the items, by their length: rows of term numbers, and the items of each."""

    def __init__(self, items: list[tuple[int, bytes]], size: int):
        names = np.array([i for i, _ in items], np.int64)
        flat, n = word_hashes([t for _, t in items]) if items else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.terms, number = np.unique(flat, return_inverse=True)
        ends = np.cumsum(n)
        rows: dict[int, list] = {}
        for item, start, end in zip(names.tolist(), (ends - n).tolist(), ends.tolist()):
            long = min(size, end - start)
            if long:
                seen = np.lib.stride_tricks.sliding_window_view(number[start:end], long).astype(np.int32)
                rows.setdefault(long, []).append((seen, np.full(len(seen), item, np.int64)))
        self.groups = []
        for parts in rows.values():
            windows, of = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([of.ravel(), np.concatenate([i for _, i in parts])], axis=1), axis=0)
            self.groups.append((windows, np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1]))

    def order(self, frequency: np.ndarray) -> None:
        """Rank each window's terms from the rarest; windows with a term that no document has are never looked up."""
        self.plans = [np.argsort(frequency[w], axis=1, kind="stable").astype(np.int8) for w, _, _ in self.groups]
        self.known = frequency > 0


class Segment:
    """Postings of one segment for the terms of a block: positions of term t are at[lo[t]:hi[t]], ascending."""

    def __init__(self, terms: bytes, ends: bytes, at: bytes, wanted: np.ndarray):
        own, ends = np.frombuffer(terms, np.uint64), np.concatenate([[0], np.frombuffer(ends, np.int32)])
        i = np.searchsorted(own, wanted)
        self.has = np.append(own, np.uint64(0))[i] == wanted if len(own) else np.zeros(len(wanted), bool)
        self.has &= i < len(own)
        i = np.where(self.has, i, 0)
        self.lo, self.hi = ends[i], np.where(self.has, np.append(ends, ends[-1])[i + 1], ends[i])
        self.at = np.frombuffer(at, np.int32)

    def __getitem__(self, term: int) -> np.ndarray:
        return self.at[self.lo[term] : self.hi[term]]

    def find(self, window, plan, slop: int = 0) -> np.ndarray:
        """Starts where the window occurs, from the rarest term on."""
        starts = self[window[plan[0]]] - np.int32(plan[0])
        for k in plan[1:].tolist():
            if not len(starts):
                break
            other = self[window[k]]
            i = np.searchsorted(other, starts + (k - slop))
            near = np.append(other, LAST)[i]
            starts = starts[near <= starts + (k + slop)]
        return starts


SEGMENT_SCHEMA = "ids array<long>, hashes array<long>, bases binary, terms binary, ends binary, at binary, docs binary"


def build_index(docs: DataFrame, terms: Bitmap, id_col: str, text_col: str) -> DataFrame:
    """Segments of the index of docs over the terms in a bitmap, one row each."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    @lean
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, hashes = b.column(0), b.column(1)
            texts = [t or b"" for t in b.column(2).to_pylist()]
            for lo, hi in chunks(texts, SEGMENT_BYTES):
                term, sizes = word_hashes(texts[lo:hi])
                bases = np.concatenate([[0], np.cumsum(sizes + GAP)])
                use = np.flatnonzero(shared.value.test(term.view(np.int64)))
                doc = np.repeat(np.arange(hi - lo), sizes)[use]
                term, place = term[use], (use + GAP * doc).astype(np.int32)
                o = np.argsort(term, kind="stable")
                term, place, doc = term[o], place[o], doc[o]
                new = np.ones(len(term), bool)
                new[1:] = term[1:] != term[:-1]
                own = np.flatnonzero(new)
                first = new.copy()
                first[1:] |= doc[1:] != doc[:-1]
                per_doc = np.add.reduceat(first.astype(np.int32), own) if len(own) else np.zeros(0, np.int32)
                ends = np.append(own[1:], len(term)).astype(np.int32)[: len(own)]
                row = [
                    pa.array([ids.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                    pa.array([hashes.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (bases.astype(np.int64), term[own], ends, place, per_doc.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(row, names=["ids", "hashes", "bases", "terms", "ends", "at", "docs"])

    rows = docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t"))
    return stored(rows.mapInArrow(run, SEGMENT_SCHEMA))


def benchmark_terms(items: DataFrame) -> Bitmap:
    """A bitmap of the hashes of all words of the items' texts."""

    @lean
    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in chunks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(word_hashes(texts[lo:hi])[0]).view(np.int64))], names=["w"])

    known = stored(items.select(F.col("t").cast("binary")).mapInArrow(run, "w long").distinct())
    return bitmap_of(known, "w", bits_for(known.count()))


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents by term of a block, over all segments; each partition sums its own first."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    @lean
    def add(batches):
        import pyarrow as pa

        wanted = shared.value
        total = np.zeros(len(wanted) + 1, np.int64)
        for b in batches:
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(t, np.uint64)
                i = np.searchsorted(wanted, own)
                good = np.append(wanted, np.uint64(0))[i] == own if len(own) else np.zeros(0, bool)
                good &= i < len(wanted)
                np.add.at(total, i[good], np.frombuffer(n, np.int32)[good])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["t", "n"])

    out = np.zeros(len(terms), np.int64)
    for t, n in index.select("terms", "docs").mapInArrow(add, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[t] = n
    return out


def _search(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    """(id, h, n_words, items, spans) for every document row; spans are merged word ranges."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    @lean
    def run(batches):
        import pyarrow as pa

        p = shared.value
        for b in (whole.slice(at, 1) for whole in batches for at in range(whole.num_rows)):
            (r,) = b.to_pylist()
            seg, bases = Segment(r["terms"], r["ends"], r["at"], p.terms), np.frombuffer(r["bases"], np.int64)
            n = len(r["ids"])
            cover = np.zeros(bases[-1] + 1, np.int32)
            items: list[set] = [set() for _ in range(n)]
            here = seg.has & p.known
            for (windows, of, names), plans in zip(p.groups, p.plans):
                for w in np.flatnonzero(here[windows].all(axis=1)):
                    starts = seg.find(windows[w], plans[w], slop)
                    if len(starts):
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + windows.shape[1], -1)
                        for d in np.unique(np.searchsorted(bases, starts, side="right") - 1):
                            items[d].update(names[of[w] : of[w + 1]].tolist())
            hit = np.cumsum(cover) > 0
            edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            of = np.searchsorted(bases, lo, side="right") - 1
            spans: list[list] = [[] for _ in range(n)]
            for s, e, d in zip(lo.tolist(), hi.tolist(), of.tolist()):
                spans[d].append({"start": s - int(bases[d]), "end": e - int(bases[d])})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r["ids"], pa.int64()), pa.array(r["hashes"], pa.int64()), pa.array(np.diff(bases) - GAP, pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["id", "h", "n_words", "items", "spans"],
            )

    return index.select("ids", "hashes", "bases", "terms", "ends", "at").mapInArrow(
        run, "id long, h long, n_words long, items array<long>, spans array<struct<start:long,end:long>>"
    )


def _merged(spans) -> "F.Column":
    """Union of word ranges, in order."""
    zero = F.array().cast("array<struct<start:long,end:long>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        touches = (F.size(acc) > 0) & (x["start"] <= F.when(F.size(acc) > 0, last["end"]))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), zero, step)


def matches(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block_bytes: int = 8_000_000,
) -> DataFrame:
    """(id, h, n_words, items, spans) of each document row; h hashes its text."""
    small_batches(docs.sparkSession)
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total * 2 // block_bytes))
    index = build_index(docs, benchmark_terms(items), id_col, text_col)
    found = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()  # about half of block_bytes
        phrases = Phrases([(r.i, r.t.encode()) for r in part], size)
        phrases.order(_frequencies(index, phrases.terms))
        hits = _search(index, phrases, slop)
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        # repeated rows come once for each block and copy: copies are put back by their count
        one = found.groupBy("id", "h", "n_words").agg(
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"),
            (F.count("*") / blocks).cast("int").alias("copies"),
        )
        found = one.select("id", "h", "n_words", "items", _merged(F.col("spans")).alias("spans"), F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    return found


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
