"""Exact removal of repeated substrings by sampled suffixes (operator 8).

This stands in for external induced sorting, which would move every suffix with its rank and common prefix through
each level of its recursion: 16 bytes or more for each byte of text, at every level, against a disk bound of 4 times
the compressed input. As in induced sorting, only a sample of the suffixes is sorted and the rest is derived from it,
but there is no recursion over names, no queue of tuples and no array of common prefixes; Spark's shuffle sorts.

1. Sampled suffixes. A position is sampled if its k-byte gram is the least (by hash) of all grams in some window
   of `length` bytes: local minima, as in induced sorting, but under a random order, so that about one position
   in 17 is taken. Whether a position is sampled depends on the bytes around it alone, so equal windows have equal
   sampled positions. Tasks write runs of tuples (gram, name of the surroundings, place), sorted within buckets.
2. A bucket merges its runs in tuple order. Equal names (128 bits with the gram, over the bytes around it) mean that the common prefix and suffix around the sampled
   positions reach over every window with that position; the later documents' bytes are removed. Where grams are
   equal but names differ, the common part is shorter and must be looked at.
3. What is left: those positions, with the bytes around them, are sorted once more by gram, and the windows of
   `length` bytes at each offset are derived from them, matched by hash and compared byte by byte.
4. The byte ranges of each document are gathered and cut out. Only texts with ranges are shuffled.

A row's identity is its doc_id with a hash of its text. Nulls: a null text is empty; a null doc_id counts as the
largest number, and rows with it don't repeat each other. Rows that repeat a doc_id don't repeat each other. Extra columns are ignored. Matches are of bytes and
never cross documents; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, bits_for, lean, small_batches, stored
from .textops import ODD, Rolling, mix

GRAM = 18
RUN = 250_000  # sampled suffixes in a run
PART = 700_000  # bytes of text looked at together
MARGIN = 160
BUCKET_BYTES = 8_000_000
LAST = (1 << 63) - 1  # stands for a null doc_id


def _pack(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def _unpack(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<u8")


def _parts(texts: list[bytes]):
    """Groups of (row, shift, bytes, reaches the end) of about PART bytes; long texts overlap by MARGIN."""
    group, total = [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t)), PART):
            piece = t[max(0, s - MARGIN) : s + PART + MARGIN]
            if total and total + len(piece) > PART:
                yield group
                group, total = [], 0
            group.append((i, max(0, s - MARGIN), piece, s + PART + MARGIN >= len(t)))
            total += len(piece)
    if group:
        yield group


def _slices(batches, rows: int = 2000):
    """Smaller batches, to bound the Python copies of texts."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sampled(group, length: int):
    """Sampled positions of a group of parts: gram hash, name, row, position in the text, index in the joined
    bytes, bytes at hand before and after (at most length - GRAM and length), and the joined bytes."""
    data = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
    sizes = np.fromiter((len(p[2]) for p in group), np.int64, len(group))
    ends = np.cumsum(sizes)
    w, n = length - GRAM + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none, none, data
    roll = Rolling(data)
    gram = roll.grams(GRAM)
    high = (gram >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low, span = high, 1
    while span < w:
        step = min(span, w - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    part = np.repeat(np.arange(len(group)), sizes)
    low = np.where(part[: n - length + 1] == part[length - 1 :], low, 0)  # windows inside one part
    top, span = np.concatenate([np.zeros(w - 1, np.uint32), low, np.zeros(w - 1, np.uint32)]), 1
    while span < w:
        step = min(span, w - span)
        top = np.maximum(top[:-step], top[step:])
        span += step
    at = np.flatnonzero(top == high)
    p = part[at]
    first, last = (ends - sizes)[p], ends[p]
    shift = np.fromiter((x[1] for x in group), np.int64, len(group))[p]
    final = np.fromiter((x[3] for x in group), bool, len(group))[p]
    before, after = np.minimum(at - first, w - 1), np.minimum(last - at, length)
    # in a long text's parts, positions whose surroundings are cut by the part belong to the next one
    keep = ((before == w - 1) | (shift == 0)) & ((after == length) | final)
    at, p, first, shift, before, after = (x[keep] for x in (at, p, first, shift, before, after))
    name = mix(roll.span(at - before, at + after) + (before * 64 + after).astype(np.uint64) * ODD)
    row = np.fromiter((x[0] for x in group), np.int64, len(group))[p]
    return gram[at], name, row, at - first + shift, at, before, after, data


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    known = F.col(id_col).cast("long")
    return docs.select(F.coalesce(known, F.lit(LAST)).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"), known.isNull().alias("nameless"))


def _runs(buckets: int, length: int):
    """Rows (id, h, text) to runs of sampled suffixes by bucket."""

    @lean
    def run(batches):
        import pyarrow as pa

        def out(ids, hs, bases, grams, names, places):
            gram, name, place = (np.concatenate(x) for x in (grams, names, places))
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            o = np.lexsort((gram, bucket))
            gram, name, place, bucket = gram[o], name[o], place[o], bucket[o]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows: list[list] = [[] for _ in range(7)]
            bases = np.array([*bases], np.int64)
            ids, hs = np.array(ids, np.int64), np.array(hs, np.int64)
            for k in np.flatnonzero(np.diff(cut)):
                s = slice(cut[k], cut[k + 1])
                used, where = np.unique(np.searchsorted(bases, place[s], side="right") - 1, return_inverse=True)
                sure = place[s] - bases[used][where]
                for r, v in zip(rows, (int(k), ids[used].tobytes(), hs[used].tobytes(), where.astype(np.uint16).tobytes(), _pack(gram[s]), _pack(name[s]), sure.astype(np.int32).tobytes())):
                    r.append(v)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=list(RUN_COLUMNS))

        for b in _slices(batches):
            all_ids, all_hs = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = b.column(2).to_pylist()
            start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
            grams, names, places, n = [], [], [], 0
            for group in _parts(texts):
                gram, name, row, pos, *_ = sampled(group, length)
                if len(gram):
                    grams.append(gram)
                    names.append(name)
                    places.append(start[row] + pos)
                    n += len(gram)
                if n >= RUN:
                    yield out(all_ids, all_hs, start[:-1], grams, names, places)
                    grams, names, places, n = [], [], [], 0
            if n:
                yield out(all_ids, all_hs, start[:-1], grams, names, places)

    return run


RUN_COLUMNS = ("bucket", "ids", "hs", "rows", "grams", "names", "places")
RUN_SCHEMA = "bucket int, ids binary, hs binary, rows binary, grams binary, names binary, places binary"
FOUND = "id long, h long, lo int, hi int, grams binary"


def _rows(ids, hs, lo, hi, grams: list):
    """A table of merged ranges in order of document and place, one a row, and after them one row for each of grams."""
    import pyarrow as pa

    o = np.lexsort((lo, hs, ids))
    ids, hs, lo, hi = ids[o], hs[o], lo[o], hi[o]
    doc = np.cumsum(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hs[1:] != hs[:-1])])) if len(ids) else np.zeros(0, int)
    reach = np.maximum.accumulate(hi + (doc << 32)) - (doc << 32) if len(ids) else hi  # furthest end so far in the document
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])])) if len(ids) else doc
    last = np.concatenate([new[1:], [len(ids)]])[: len(new)] - 1
    cols = [pa.array(ids[new], pa.int64()), pa.array(hs[new], pa.int64()), pa.array(lo[new].astype(np.int32)), pa.array(reach[last].astype(np.int32)), pa.nulls(len(new), pa.binary())]
    more = [pa.nulls(len(grams), c.type) for c in cols[:4]] + [pa.array(grams, pa.binary())]
    return pa.table({n: pa.concat_arrays([c, m]) for n, c, m in zip(("id", "h", "lo", "hi", "grams"), cols, more)})


def _merge(length: int):
    """Merge a bucket's runs: ranges of positions whose name an earlier document has, and the grams whose
    positions must be looked at."""

    @lean
    def run(table):
        ids, hs = [], []
        for i, h, r in zip(*(table.column(c).to_pylist() for c in ("ids", "hs", "rows"))):
            row = np.frombuffer(r, np.uint16)
            ids.append(np.frombuffer(i, np.int64)[row])
            hs.append(np.frombuffer(h, np.int64)[row])
        ids, hs = np.concatenate(ids), np.concatenate(hs)
        gram, name = (_unpack(table.column(c).to_pylist()) for c in ("grams", "names"))
        place = np.frombuffer(b"".join(table.column("places").to_pylist()), np.int32)
        o = np.lexsort((ids, name, gram))
        ids, hs, gram, name, place = (x[o] for x in (ids, hs, gram, name, place))
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])])
        start = np.flatnonzero(new)
        least = ids[start]  # the first of each name
        later = ids > least[np.cumsum(new) - 1]
        # grams whose names begin in different documents
        of = gram[start]
        g = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        differ = np.minimum.reduceat(least, g) != np.maximum.reduceat(least, g)
        lo, hi = np.maximum(place[later].astype(np.int64) - (length - GRAM), 0), place[later].astype(np.int64) + length
        return _rows(ids[later], hs[later], lo, hi, [of[g][differ].tobytes()])

    return run


LOOK = "bucket int, id long, h long, grams binary, places binary, before binary, after binary, around binary"


def _look(buckets: int, length: int, bits):
    """The sampled positions whose gram is asked for, with the bytes around them."""
    left, width = length - GRAM, 2 * length - GRAM

    @lean
    def run(batches):
        import pyarrow as pa

        for b in _slices(batches):
            ids, hs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for group in _parts(b.column(2).to_pylist()):
                gram, _, row, pos, at, before, after, data = sampled(group, length)
                use = np.flatnonzero(bits.value.test(mix(gram).view(np.int64)))
                if not len(use):
                    continue
                gram, row, pos, at, before, after = (x[use] for x in (gram, row, pos, at, before, after))
                bucket = (gram % np.uint64(buckets)).astype(np.int64)
                o = np.lexsort((bucket, row))
                gram, row, pos, at, before, after, bucket = (x[o] for x in (gram, row, pos, at, before, after, bucket))
                padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(length, np.uint8)])
                around = padded[at[:, None] + np.arange(width)[None, :]]
                cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]), [True]]))
                spans = list(zip(cut[:-1], cut[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cut[:-1]], pa.int32()), pa.array([ids[r] for r in row[cut[:-1]]], pa.int64()), pa.array([hs[r] for r in row[cut[:-1]]], pa.int64()),
                        pa.array([gram[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([pos[s:e].astype(np.int32).tobytes() for s, e in spans], pa.binary()),
                        pa.array([before[s:e].astype(np.uint8).tobytes() for s, e in spans], pa.binary()),
                        pa.array([after[s:e].astype(np.uint8).tobytes() for s, e in spans], pa.binary()),
                        pa.array([around[s:e].tobytes() for s, e in spans], pa.binary()),
                    ],
                    names=[c.split()[0] for c in LOOK.split(", ")],
                )

    return run


def _induce(length: int):
    """Windows of the given length around positions with equal grams: ranges that an earlier document has."""
    left, width = length - GRAM, 2 * length - GRAM

    @lean
    def run(table):
        join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        gram, place = join("grams", np.uint64), join("places", np.int32).astype(np.int64)
        before, after = join("before", np.uint8).astype(np.int64), join("after", np.uint8).astype(np.int64)
        around = join("around", np.uint8).reshape(-1, width)
        per = np.fromiter((len(x) // 8 for x in table.column("grams").to_pylist()), np.int64, table.num_rows)
        ids, hs = (np.repeat(np.asarray(table.column(c).combine_chunks()), per) for c in ("id", "h"))
        o = np.argsort(gram, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], gram[o][1:] != gram[o][:-1], [True]]))
        found = []
        s = 0
        top = np.uint64(pow(int(ODD), length - 1, 1 << 64))
        while s < len(cuts) - 1:  # whole gram groups, some tens of thousands of positions at once
            e = max(s + 1, int(np.searchsorted(cuts, cuts[s] + 20_000)))
            e = min(e, len(cuts) - 1)
            rows = o[cuts[s] : cuts[e]]
            s = e
            at = np.ascontiguousarray(around[rows].T)  # byte by byte, so that one hash a row rolls over the offsets
            salt, hit = mix(gram[rows]), np.zeros((len(rows), left + 3), np.int8)
            value = np.zeros(len(rows), np.uint64)
            for c in at[:length]:
                value = value * ODD + c + np.uint64(1)
            for off in range(left + 1):
                if off:
                    value = (value - (at[off - 1].astype(np.uint64) + np.uint64(1)) * top) * ODD + at[off + length - 1] + np.uint64(1)
                use = np.flatnonzero((off >= left - before[rows]) & (off - left + length <= after[rows]))
                if len(use) < 2:
                    continue
                key, doc = mix(value[use] ^ salt[use]), ids[rows[use]]
                order = np.lexsort((doc, key))
                k, d = key[order], doc[order]
                new = np.concatenate([[True], k[1:] != k[:-1]])
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = np.flatnonzero(d > d[lead])
                one, two = rows[use[order[later]]], rows[use[order[lead[later]]]]
                same = (around[one, off : off + length] == around[two, off : off + length]).all(axis=1)  # the bytes themselves
                hit[use[order[later[same]]], off + 1] = 1
            turn = np.diff(hit, axis=1)
            who, first = np.nonzero(turn == 1)
            last = np.nonzero(turn == -1)[1]
            who = rows[who]
            found.append(np.stack([who, place[who] - left + first, place[who] - left + last - 1 + length], axis=1))
        got = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        return _rows(ids[got[:, 0]], hs[got[:, 0]], got[:, 1], got[:, 2], [])

    return run


def repeated_ranges(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, lo, hi): byte ranges that an earlier document has; a document has one row or many."""
    rows = _keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = max(8, -(-total // (BUCKET_BYTES)))
    runs = rows.mapInArrow(_runs(buckets, length), RUN_SCHEMA)
    first = stored(runs.groupBy("bucket").applyInArrow(_merge(length), FOUND))

    @lean
    def each(batches):
        import pyarrow as pa

        for b in batches:
            g = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in b.column(0).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(mix(g).view(np.int64))], names=["g"])

    asked = first.where("grams is not null").select("grams").mapInArrow(each, "g long")
    asked = stored(asked.distinct())
    bits = spark.sparkContext.broadcast(bitmap_of(asked, "g", bits_for(asked.count())))
    looked = rows.mapInArrow(_look(buckets, length, bits), LOOK)
    second = stored(looked.groupBy("bucket").applyInArrow(_induce(length), FOUND))
    return first.where("id is not null").unionByName(second).select("id", "h", "lo", "hi")


def cut_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row."""
    small_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    ranges = repeated_ranges(docs, length, id_col, text_col)
    key = F.xxhash64("id", "h")
    touched_rows = stored(ranges.select(key.alias("key")).distinct())
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(touched_rows, "key", bits_for(touched_rows.count())))
    names = ["id", "nameless", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    schema = "id long, nameless boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut(text: bytes, packed: np.ndarray):
        """Union of the ranges (lo * 2**32 + hi), and what is left."""
        r = np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1)
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, r[:, 0], 1)
        np.add.at(edge, np.minimum(r[:, 1], len(text)), -1)
        gone = np.cumsum(edge[:-1]) > 0
        n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept

    @lean
    def finish(batches):
        import pyarrow as pa

        for b in batches:
            out = [cut(t.as_py(), np.asarray(r.values if r.is_valid else [], np.int64)) for t, r in zip(b.column(2), b.column(3))]
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols[: 4 + with_text]], names=names)

    @lean
    def whole(batches):
        import pyarrow as pa

        for b in batches:
            b = b.filter(pa.array(~bits.value.test(b.column(4).to_numpy(zero_copy_only=False))))
            texts = b.column(2).to_pylist()
            n = pa.array(map(len, texts), pa.int64())
            zero = pa.array(np.zeros(len(texts), np.int64))
            sha = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), n, zero, zero, sha, *[b.column(2)] * with_text], names=names)

    @lean
    def flagged(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array(bits.value.test(b.column(4).to_numpy(zero_copy_only=False))))

    keyed = rows.withColumn("key", key)
    gathered = ranges.groupBy("id", "h").agg(F.collect_list(F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")).alias("ranges"))
    touched = keyed.mapInArrow(flagged, keyed.schema).join(gathered, ["id", "h"], "left").select("id", "nameless", "t", "ranges")
    out = keyed.mapInArrow(whole, schema).unionByName(touched.mapInArrow(finish, schema))
    return out.select(F.when(~F.col("nameless"), F.col("id")).alias(id_col), *names[2:])
