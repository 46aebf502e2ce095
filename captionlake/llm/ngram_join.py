"""Exact Jaccard join on word n-gram sets with a token-group matrix (operator 7).

1. Each text becomes its set of distinct word shingles (hashed). Equal sets become one set, named by its least id.
2. Similar sets are partitioned into groups: for several seeds, sets that share a pair of minimum hashes are put
   together (large ones split by a hash that differs from seed to seed) and compared with leaders; what links
   becomes one group. Thousands of near copies so become one group without their pairs, since the parts of one
   seed mix those of another. Where sets are compared, counts of tokens by cell (about 5 tokens each) bound the
   overlap first: two sets share at most the sum of the smaller counts. Only sets that pass send their tokens.
3. The token-group matrix: a group is stored by the tokens of its members that can matter. With tokens ordered
   from rare to common, two sets of the wanted similarity share a token among the first few of each (the prefix),
   so only prefix tokens are stored, dealt by token. A set that meets a group of another component there, and
   whose sizes and places allow enough overlap, becomes a query of that group (in blocks of 32 members).
4. A query opens a group only if the cells allow a link with some member and its overlap with the union of all
   the group's tokens is large enough; it is then compared exactly with the members. All links together give the
   components.

The order of tokens uses counts in a sketch of fixed size; a wrong count changes the order, never the result.
Texts aren't shuffled; sets that must meet are recomputed from the text where a bitmap of ids asks for them.

Nulls and empty texts have no shingles and are linked with nothing; a null id gets a null component. Texts with
fewer words than a shingle have one shingle, all words. Rows that share an id are one node. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, bitmap_of, lean, small_batches, stored
from .components import components
from .textops import ODD, Rolling, chunks, mix, word_spans

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOW = np.uint64((1 << 52) - 1)
SKETCH = 19  # log2 of the sketch's counters
SLICE = 15
ROUNDS, GROUP, BLOCK = 3, 64, 32
TOKENS_PER_BUCKET = 400_000
ROWS_PER_BUCKET, CELLS_PER_BUCKET = 20_000, 8_000_000  # sets compared by their cells in one task, and bytes of their cells
POSTINGS = 2_000  # sets of one token that are compared in one piece
TOKENS_PER_BLOCK = 1_000_000  # of a block's members, and of the queries that are held against them at once


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, each text's in ascending order, and where each text's begin (one more at
    the end). Tokens have 52 bits."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bases = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    s, e, doc = word_spans(~SPACE[data], bases[:-1])
    word = Rolling(data).span(s, e)
    count = np.bincount(doc, minlength=len(texts))
    parts = []
    if len(word) >= n:
        h = word[: len(word) - n + 1].copy()
        for k in range(1, n):
            h = mix(h + ODD) + word[k : len(word) - n + 1 + k]
        own = doc[: len(word) - n + 1]
        whole = own == doc[n - 1 :]
        parts.append((own[whole].astype(np.uint64) << np.uint64(52)) | (mix(h[whole]) & LOW))
    first = np.concatenate([[0], np.cumsum(count)])
    for d in np.flatnonzero((count > 0) & (count < n)):
        h = np.array([count[d]], np.uint64)
        for w in word[first[d] : first[d + 1]]:
            h = mix(h + ODD) + w
        parts.append((np.uint64(d) << np.uint64(52)) | (mix(h) & LOW))
    flat = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    at = np.searchsorted(flat, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(52))
    return flat & LOW, at


def least_overlap(size: int, num: int, den: int) -> int:
    """Fewest tokens a set of this size shares with any set it links to."""
    return -(-num * size // den)


def _per_chunk(batches, n: int, wanted: Bitmap | None = None):
    """(ids, tokens, starts) for chunks of rows (id, key, text) with an id; wanted: only rows whose key is in it."""
    import pyarrow as pa

    for whole in batches:
        for at in range(0, whole.num_rows, 500):  # bounds the Python copies of texts
            b = whole.slice(at, 500)
            if wanted is not None:
                b = b.filter(pa.array(wanted.test(b.column(1).to_numpy(zero_copy_only=False))))
            ids = b.column(0).to_pylist()
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts):
                yield ids[lo:hi], *shingle_sets(texts[lo:hi], n)


def _cells(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each set's tokens counted by their low bits, in a power of two of cells: 4 to 8 tokens a cell, so a byte
    holds any count that distinct hashes can give."""
    size = np.diff(at)
    n = 1 << np.floor(np.log2(np.maximum(size, 64) / 4)).astype(np.int64)
    end = np.cumsum(n)
    doc = np.repeat(np.arange(len(size)), size)
    where = (end - n)[doc] + (tokens.astype(np.int64) & (n[doc] - 1))
    counts = np.bincount(where, minlength=int(end[-1]) if len(end) else 0).astype(np.uint8).tobytes()
    return [counts[e - k : e] for k, e in zip(n.tolist(), end.tolist())]


def _may_link(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Could sets with these cells link? The larger table of cells is folded to the smaller one's size."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = b.reshape(-1, len(a)).sum(axis=0)
    x, y = int(a.sum()), int(b.sum())
    most = int(np.minimum(a, b).sum())
    return min(x, y) * den >= num * max(x, y) and den * most >= num * (x + y - most)


def _profiles(rows: DataFrame, n: int) -> DataFrame:
    """(id, n, s1, s2, k0.., cells): set size, a 128-bit name of the set, its grouping keys and its counts by
    cell; and, in rows with a slice number, each partition's share of the token sketch."""

    @lean
    def run(batches):
        import pyarrow as pa

        sketch = np.zeros(1 << SKETCH, np.uint32)
        names = ["id", "n", "s1", "s2", *(f"k{r}" for r in range(ROUNDS)), "cells", "slice", "counts"]
        for ids, tokens, at in _per_chunk(batches, n):
            size = np.diff(at)
            full = np.flatnonzero(size)
            cols = [np.zeros(len(ids), np.uint64) for _ in range(2 + ROUNDS)]
            if len(full):
                start = at[:-1][full]
                cols[0][full] = np.add.reduceat(mix(tokens), start)
                cols[1][full] = np.add.reduceat(mix(tokens ^ ODD), start)
                for r in range(ROUNDS):
                    two = [np.minimum.reduceat(mix(tokens + np.uint64(1000 + 2 * r + x)), start) for x in (0, 1)]
                    cols[2 + r][full] = mix(two[0] * ODD + two[1])
                np.add.at(sketch, (tokens >> np.uint64(52 - SKETCH)).astype(np.int64), 1)
            data = [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), *(pa.array(c.view(np.int64)) for c in cols)]
            data += [pa.array(_cells(tokens, at), pa.binary()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names=names)
        m = (1 << SKETCH) >> SLICE
        data = [pa.nulls(m, pa.int64())] * (4 + ROUNDS) + [pa.nulls(m, pa.binary())]
        data += [pa.array(range(m), pa.int32()), pa.array([sketch[i << SLICE : (i + 1) << SLICE].tobytes() for i in range(m)], pa.binary())]
        yield pa.RecordBatch.from_arrays(data, names=names)

    keys = ", ".join(f"k{r} long" for r in range(ROUNDS))
    return stored(rows.mapInArrow(run, f"id long, n long, s1 long, s2 long, {keys}, cells binary, slice int, counts binary"))


def _sketch(profiles: DataFrame) -> np.ndarray:
    @lean
    def add(table):
        import pyarrow as pa

        total = np.zeros(1 << SLICE, np.uint32)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.uint32)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(1 << SKETCH, np.uint32)
    parts = profiles.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    for r in parts.collect():  # 2 MB in all
        out[r.slice << SLICE : (r.slice + 1) << SLICE] = np.frombuffer(r.counts, np.uint32)
    return out


def _token_sets(rows: DataFrame, n: int, ids: DataFrame) -> DataFrame:
    """(id, tokens) of the rows whose id is in ids, and of few others (a bitmap decides): join it with ids."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap_of(ids, F.xxhash64("id"), 23))

    @lean
    def run(batches):
        import pyarrow as pa

        for own, tokens, at in _per_chunk(batches, n, bits.value):
            sets = [tokens[at[i] : at[i + 1]].tobytes() for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(sets, pa.binary())], names=["id", "tokens"])

    return rows.mapInArrow(run, "id long, tokens binary")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = _shared(a, b)
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def _groups(table, keys: list[str]):
    """Row numbers of each group of a table, by its key columns."""
    cols = [table.column(k).to_numpy() for k in keys]
    o = np.lexsort(cols[::-1])
    new = np.zeros(len(o), bool)
    for c in cols:
        new[1:] |= c[o][1:] != c[o][:-1]
    yield from np.split(o, np.flatnonzero(new))


def _likely(keys: list[str], num: int, den: int):
    """Of a bucket of groups, the rows whose cells allow a link with a leader of their group, and those leaders."""

    @lean
    def run(table):
        cells = [np.frombuffer(x, np.uint8).astype(np.int32) for x in table.column("cells").to_pylist()]
        ids = table.column("id").to_numpy()
        keep = np.zeros(table.num_rows, bool)
        for group in _groups(table, keys):
            leaders: list[int] = []
            for i in group[np.argsort(ids[group], kind="stable")]:
                met = [j for j in leaders if _may_link(cells[i], cells[j], num, den)]
                keep[[i, *met]] |= bool(met)
                if not met:
                    leaders.append(i)
        return table.take(np.flatnonzero(keep)).select(["id", *keys])

    return run


def _qualify(block: list[str], num: int, den: int):
    """Of a bucket of blocks, the queries whose cells allow a link with a member, and those members."""

    @lean
    def run(table):
        cells = [np.frombuffer(x, np.uint8).astype(np.int32) for x in table.column("cells").to_pylist()]
        role = table.column("role").to_numpy()
        keep = np.zeros(table.num_rows, bool)
        for group in _groups(table, block):
            members = [j for j in group if role[j] == 0]
            for i in (i for i in group if role[i] == 1):
                met = [j for j in members if _may_link(cells[i], cells[j], num, den)]
                keep[[i, *met]] |= bool(met)
        return table.take(np.flatnonzero(keep)).select(["id", *block, "role"])

    return run


def _by_bucket(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """Apply run to buckets of whole groups."""
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("cells")), F.lit(0)).alias("bytes")).first()
    buckets = max(8, -(-size.n // ROWS_PER_BUCKET), -(-size.bytes // CELLS_PER_BUCKET))
    return rows.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets))).groupBy("bucket").applyInArrow(run, schema)


def _merge(num: int, den: int):
    """Compare a group's sets with its leaders; edges from a set to every leader it links to."""

    @lean
    def run(table):
        import pyarrow as pa

        ids = table.column("id").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        leaders, a, b = [], [], []
        for i in sorted(range(len(ids)), key=lambda i: (ids[i], len(sets[i]))):
            met = [j for j in leaders if _linked(sets[i], sets[j], num, den)]
            a += [ids[i]] * len(met)
            b += [ids[j] for j in met]
            if met:
                leaders = [j for j in leaders if j not in met[1:]]
            else:
                leaders.append(i)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _dealt(n: str, part: int, tokens: str | None = None):
    """Into how many parts a group of n rows, with so many tokens, is split."""
    by_tokens = F.ceil(F.col(tokens) / TOKENS_PER_BLOCK) if tokens else F.lit(1)
    return F.greatest(F.lit(1), F.ceil(F.col(n) / part), by_tokens).cast("int")


def _prefixes(rows: DataFrame, n: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """(id, prefix) of every row: the first tokens from rare to common, as far as a linked set must share one."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    @lean
    def run(batches):
        import pyarrow as pa

        counts = shared.value
        for ids, tokens, at in _per_chunk(batches, n):
            size = np.diff(at)
            doc = np.repeat(np.arange(len(ids)), size)
            common = counts[(tokens >> np.uint64(52 - SKETCH)).astype(np.int64)].astype(np.uint64)
            # within a text tokens ascend already, so a stable sort by (text, count) orders ties by token
            o = np.argsort((doc.astype(np.uint64) << np.uint64(32)) | common, kind="stable")
            tokens = tokens[o]
            out = []
            for i in range(len(ids)):
                m = int(size[i])
                out.append(tokens[at[i] : at[i] + (m - least_overlap(m, num, den) + 1 if m else 0)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.binary())], names=["id", "n", "prefix"])

    return rows.mapInArrow(run, "id long, n long, prefix binary")


COLUMNS = {"docs": np.int64, "apart": np.int64, "subs": np.int32, "sizes": np.int32, "places": np.int32}


def _deal(buckets: int):
    """Rows (id, component, sub, n, prefix) to packed columns of the matrix by token bucket."""

    @lean
    def run(batches):
        import pyarrow as pa

        for b in (whole.slice(at, 4000) for whole in batches for at in range(0, whole.num_rows, 4000)):
            ids, comps, subs, ns = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sets = [np.frombuffer(x, np.uint64) for x in b.column(4).to_pylist()]
            if not sets:
                continue
            lens = np.fromiter(map(len, sets), np.int64, len(sets))
            token, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), lens)
            place = np.arange(len(token)) - np.repeat(np.cumsum(lens) - lens, lens)
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            o = np.lexsort((token, bucket))
            token, row, place, bucket = token[o], row[o], place[o], bucket[o]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            data = {"docs": ids[row], "apart": comps[row] - ids[row], "subs": subs[row], "sizes": ns[row], "places": place}
            use = [k for k in range(buckets) if cut[k + 1] > cut[k]]
            cols = [pa.array(use, pa.int32())]
            cols.append(pa.array([token[cut[k] : cut[k + 1]].view(np.uint8).reshape(-1, 8)[:, :7].tobytes() for k in use], pa.binary()))
            cols += [pa.array([v[cut[k] : cut[k + 1]].astype(COLUMNS[c]).tobytes() for k in use], pa.binary()) for c, v in data.items()]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "tokens", *data])

    return run


ASKED = "query long, component long, sub int"
PARTS = ASKED + ", token long, k int, first int, last int, " + ", ".join(f"{c} binary" for c in COLUMNS)


def _asks(p: list[np.ndarray], stop: int, first: int, num: int, den: int) -> np.ndarray:
    """Queries (id, component, sub) among one token's postings p, the columns of the matrix in order of size: each of
    the first `stop` sets against those behind it, from `first` on, of other components and fitting sizes and places."""
    ids, comp, sub, n, place = p
    last = np.searchsorted(n, n[:stop] * den // num, side="right")  # sets behind these are too large
    found: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    held = 0
    for i in range(stop):
        j = np.arange(max(i + 1, first), last[i])
        most = np.minimum(n[i] - place[i], n[j] - place[j])
        j = j[(comp[j] != comp[i]) & (most * (num + den) >= num * (n[i] + n[j]))]
        if len(j):
            swap = comp[j] > comp[i]
            q, g = np.where(swap, j, i), np.where(swap, i, j)
            found.append(np.stack([ids[q], comp[g], sub[g]], axis=1))
            held += len(j)
        if held > 500_000:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = len(found[0]) // 2
    return np.unique(np.concatenate(found), axis=0)


def _meet(num: int, den: int, part: int):
    """Queries of groups from one token bucket: sets of different components that share a prefix token there. A token
    with more than `part` postings isn't compared here: its postings are handed on in parts, in order of size, each
    with the first and the last part that it has to be compared with."""

    @lean
    def run(table):
        import pyarrow as pa

        raw = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint8).reshape(-1, 7)
        token = np.zeros((len(raw), 8), np.uint8)
        token[:, :7] = raw
        token = token.view(np.uint64).ravel()
        col = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in COLUMNS.items()}
        o = np.lexsort((col["sizes"], token))  # by size within a token, so that sets of a fitting size stand together
        token = token[o]
        packed = {c: col[c][o] for c in COLUMNS}
        ids, comp, sub, n, place = (packed[c].astype(np.int64) for c in COLUMNS)
        comp = comp + ids
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, int)
        found: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        held, parts = 0, []
        for s, e in zip(edge[:-1][np.diff(edge) > 1], edge[1:][np.diff(edge) > 1]):
            if (comp[s:e] == comp[s]).all():
                continue
            if e - s > part:
                at = np.append(np.arange(s, e, part), e)
                largest = n[at[1:] - 1]
                last = (np.searchsorted(n[s:e], largest * den // num, side="right") - 1) // part
                first = np.searchsorted(last, np.arange(len(last)))
                for k, (x, y) in enumerate(zip(at[:-1], at[1:])):
                    parts.append((int(token[s]), k, int(first[k]), int(last[k]), *(packed[c][x:y].tobytes() for c in COLUMNS)))
                continue
            found.append(_asks([v[s:e] for v in (ids, comp, sub, n, place)], e - s, 0, num, den))
            held += len(found[-1])
            if held > 500_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = len(found[0]) // 2
        out = np.unique(np.concatenate(found), axis=0)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * len(COLUMNS)]
        names = ["query", "component", "sub", "token", "k", "first", "last", *COLUMNS]
        asked = [out[:, 0], out[:, 1], out[:, 2].astype(np.int32)]
        made = list(zip(*parts)) or [()] * 9
        cols = [pa.concat_arrays([pa.array(v, t), pa.nulls(len(parts), t)]) for v, t in zip(asked, types)]
        cols += [pa.concat_arrays([pa.nulls(len(out), t), pa.array(v, t)]) for v, t in zip(made, types[3:])]
        return pa.Table.from_arrays(cols, names=names)

    return run


def _meet_parts(num: int, den: int):
    """Queries from two parts of one token's postings, or from one part on its own."""

    @lean
    def run(table):
        import pyarrow as pa

        table = table.sort_by("k")
        sizes = [len(x) // 4 for x in table.column("sizes").to_pylist()]
        p = [np.frombuffer(b"".join(table.column(c).to_pylist()), t).astype(np.int64) for c, t in COLUMNS.items()]
        p[1] = p[1] + p[0]
        out = _asks(p, sizes[0], sizes[0] if len(sizes) > 1 else 0, num, den)
        return pa.table({"query": pa.array(out[:, 0]), "component": pa.array(out[:, 1]), "sub": pa.array(out[:, 2].astype(np.int32))})

    return run


def _asked(packed: DataFrame, num: int, den: int) -> DataFrame:
    """(query, component, sub) of all token buckets. The parts of a common token are paired and each pair is a group of
    its own, so the work on one token is spread over the cluster."""
    met = stored(packed.groupBy("bucket").applyInArrow(_meet(num, den, POSTINGS), PARTS))
    parts = met.where("token is not null").drop("query", "component", "sub")
    ahead = parts.select("*", F.col("k").alias("i"), F.explode(F.sequence("k", "last")).alias("j"))
    behind = parts.where("first < k").select("*", F.explode(F.sequence(F.col("first"), F.col("k") - 1)).alias("i"), F.col("k").alias("j"))
    pairs = ahead.unionByName(behind).drop("first", "last").groupBy("token", "i", "j").applyInArrow(_meet_parts(num, den), ASKED)
    return met.where("token is null").select("query", "component", "sub").unionByName(pairs).distinct()


def _open(num: int, den: int):
    """Bound each query's overlap with the group's union; compare with the members where it is large enough."""

    @lean
    def run(table):
        import pyarrow as pa

        ids, role = table.column("id").to_pylist(), table.column("role").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        members = [i for i, r in enumerate(role) if r == 0]
        union = np.unique(np.concatenate([sets[i] for i in members])) if members else np.zeros(0, np.uint64)
        a, b = [], []
        for q in (i for i, r in enumerate(role) if r == 1):
            if _shared(sets[q], union) < least_overlap(len(sets[q]), num, den):
                continue
            met = [i for i in members if _linked(sets[q], sets[i], num, den)]
            a += [ids[q]] * len(met)
            b += [ids[i] for i in met]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: texts link when den * shared >= num * union."""
    small_batches(docs.sparkSession)
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long")).alias("key"), F.col(text_col).alias("t"))
    rows = raw.where("id is not null")
    every = _profiles(raw, words)
    known = every.where("slice is null")
    keys = [f"k{r}" for r in range(ROUNDS)]
    first = [F.first(c).alias(c) for c in (*keys, "cells")]  # the same in all rows of a set
    named_cells = stored(known.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), *first))
    sets, cells = named_cells.select("id", "n", "s1", "s2"), named_cells.select("id", "cells")

    # groups of similar sets; a set is named once, so (id, round) names a row
    pairs = [F.struct(F.lit(r).alias("round"), F.col(k).alias("k")) for r, k in enumerate(keys)]
    alike = named_cells.select("id", F.explode(F.array(*pairs)).alias("x")).select("id", "x.round", "x.k")
    sizes = alike.groupBy("round", "k").agg(F.count("*").alias("m")).where("m > 1")
    alike = alike.join(sizes, ["round", "k"]).withColumn("part", F.pmod(F.hash("id", "round"), _dealt("m", GROUP))).drop("m")
    part = ["round", "k", "part"]
    alike = stored(alike)
    likely = _by_bucket(alike.join(cells, "id"), part, _likely(part, num, den), "id long, round int, k long, part int")
    likely = stored(likely)
    met = likely.join(_token_sets(rows, words, likely.select("id").distinct()), "id")
    merged = stored(met.groupBy(*part).applyInArrow(_merge(num, den), "a long, b long"))
    groups = components(merged)
    labels = sets.select("id", "n").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = labels.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    labels = stored(labels.join(sizes, "component").select("id", "n", "component", F.pmod(F.hash("id"), _dealt("m", BLOCK, "tokens")).alias("sub")))
    sized, labels = labels, labels.drop("n")

    # the matrix: prefix tokens by group, dealt by token
    total = sets.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    buckets = max(8, -(-total // TOKENS_PER_BUCKET))
    prefixes = _prefixes(rows, words, num, den, _sketch(every)).join(labels, "id").select("id", "component", "sub", "n", "prefix")
    schema = "bucket int, tokens binary, " + ", ".join(f"{c} binary" for c in COLUMNS)
    packed = prefixes.mapInArrow(_deal(buckets), schema)
    asked = stored(_asked(packed, num, den))

    # open the groups that qualify
    block = ["component", "sub"]
    weight = asked.join(sized.select(F.col("id").alias("query"), "n"), "query")
    salts = weight.groupBy(block).agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).withColumn("parts", _dealt("m", 500, "tokens")).select(*block, "parts")
    members = labels.join(salts, block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", *block, "part", F.lit(0).alias("role"))
    queries = asked.join(salts, block).select(F.col("query").alias("id"), *block, F.pmod(F.hash("query"), F.col("parts")).alias("part"), F.lit(1).alias("role"))
    both = stored(members.unionByName(queries))
    block.append("part")
    schema = "id long, component long, sub int, part int, role int"
    both = stored(_by_bucket(both.join(cells, "id"), block, _qualify(block, num, den), schema))
    opened = both.join(_token_sets(rows, words, both.select("id").distinct()), "id")
    links = stored(opened.groupBy(*block).applyInArrow(_open(num, den), "a long, b long"))

    # rows that share an id tie their sets together
    named = known.where("n > 0 and id is not null").select("id", "n", "s1", "s2").join(sets.select("n", "s1", "s2", F.col("id").alias("set")), ["n", "s1", "s2"])
    several = named.groupBy("id").agg(F.min("set").alias("b"), F.max("set").alias("top")).where("b < top")
    ties = named.join(several.select("id", "b"), "id").select(F.col("set").alias("a"), "b").where("a <> b")
    final = components(merged.unionByName(links).unionByName(ties))
    named_sets = sets.join(final.withColumnRenamed("node", "id"), "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component"))
    out = known.select("id", "n", "s1", "s2").join(named_sets, ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
