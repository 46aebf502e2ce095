"""Packing of token sequences into fixed windows by best-fit decreasing (operator 1).

Documents are tokenised where they lie, a few MB at a time: numpy finds the words of all texts at once, Arrow's
dictionary encoding leaves the distinct ones, the tokenizer's model merges only those not seen before, and ids are
gathered back by number. A document longer than a window is first cut into full windows and a
rest. Best-fit decreasing only looks at lengths, and there are at most `window` of them, so the plan is made
from the count of pieces by length: lengths are taken in decreasing order, and a segment tree indexed by
remaining capacity finds the tightest open windows. Equal lengths are placed as runs, so the plan's size and
time depend on the window, not on the number of documents. A distributed rank of each piece within its length
then reads its window and offset off the plan.

Nulls: a null text is an empty one; it still has its end token, so every row gives at least one piece. A null
doc_id is carried. Repeated rows are packed as separate documents. An empty table gives no pieces. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, stored
from .textops import chunks, values

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Segment tree over remaining capacities 0..top: which of them have open windows."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = [0] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = self.size + capacity
        self.any[i] = int(is_open)
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, need: int) -> int:
        """The smallest open capacity of need or more, or -1."""
        i = self.size + need
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return -1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of pieces by length. Returns the runs (length, rank from, rank to,
    first sequence, pieces per sequence, first offset) and the number of sequences. Ranks are from 0."""
    tree, groups, runs, opened = CapacityTree(window), {}, [], 0

    def leave(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            groups.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        done, todo = 0, counts[length]
        while todo:
            capacity = tree.tightest(length)
            if capacity < 0:
                capacity, first = window, opened
                have = -(-todo // (window // length))
                opened += have
            else:
                first, have = groups[capacity].pop()
                if not groups[capacity]:
                    tree.set(capacity, False)
            per = capacity // length  # a window that took one piece of this length is the tightest for the next
            whole, rest = min(have, todo // per), 0
            if whole:
                runs.append((length, done, done + whole * per, first, per, window - capacity))
                leave(capacity - per * length, first, whole)
            done, todo = done + whole * per, todo - whole * per
            if whole < have and 0 < todo < per:
                rest = todo
                runs.append((length, done, done + rest, first + whole, rest, window - capacity))
                leave(capacity - rest * length, first + whole, 1)
                done, todo = done + rest, 0
                whole += 1
            leave(capacity, first + whole, have - whole)
    return runs, opened


#: The splitting rule of the vocabulary whose words are found here. Tokenizers with another rule are asked
#: for whole texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CHUNK = 2_000_000  # bytes of text turned into arrays at once
PIECES_PER_RANK = 50_000  # pieces of one length that are ranked in one task

BLANK, LETTER, DIGIT, SIGN, HARD = range(5)
KIND = np.full(256, HARD, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
KIND[[9, 10, 11, 12, 13, 32]] = BLANK
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x41:0x5B] += 32


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell letters from U+00C0 to U+00FF: printable bytes as themselves, the others as
    the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def split_words(data: bytes, special: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a buffer that ends in four blanks: their starts, which are hard, and their lower-case bytes with the
    offsets. Words are what the splitting rule gives between blanks. Where a run between blanks has a character outside ASCII and Latin
    letters, a control character or a special token, the whole run is one hard word, left as it is."""
    raw = np.frombuffer(data, np.uint8)
    kind, low = KIND[raw], SMALL[raw]
    lead = np.flatnonzero(raw == 0xC3)
    after = raw[lead + 1]
    latin = lead[(after != 0x97) & (after != 0xB7)]
    kind[latin] = kind[latin + 1] = LETTER
    low[lead[(after < 0x9F) & (after != 0x97)] + 1] += 32
    if special is not None:
        kind[[m.start() for m in special.finditer(data)]] = HARD
    hard = np.flatnonzero(kind == HARD)
    if len(hard):
        turn = np.diff((kind != BLANK).astype(np.int8), prepend=0)
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        own = np.unique(np.searchsorted(first, hard, side="right") - 1)
        edge = np.zeros(len(raw), np.int8)
        edge[first[own]], edge[last[own]] = 1, -1
        whole = np.cumsum(edge, dtype=np.int8).view(bool)
        kind[whole] = HARD
        low[whole] = raw[whole]
    cut = kind == DIGIT
    cut[0] = True
    cut[1:] |= kind[1:] != kind[:-1]
    mark = np.flatnonzero((raw[:-4] == 0x27) & (kind[:-4] == SIGN))
    mark = mark[(mark == 0) | (kind[mark - 1] != SIGN)]
    if len(mark):  # 's 't 'm 'd 're 've 'll
        one, two = low[mark + 1], low[mark + 2]
        short = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
        long = (((one == 0x72) | (one == 0x76)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        cut[mark[short | long] + 1] = False
        cut[mark[short] + 2] = True
        cut[mark[long] + 3] = True
    at = np.flatnonzero(cut)
    size = np.diff(at, append=len(raw))
    word = kind[at] != BLANK
    offsets = np.zeros(int(word.sum()) + 1, np.int32)
    np.cumsum(size[word], out=offsets[1:])
    return at[word], kind[at[word]] == HARD, low[kind != BLANK], offsets


class Encoder:
    """Token ids of texts, through a cache of the words' ids. Words can be encoded alone, since the tokenizer's own
    splitting joins nothing across their ends."""

    MOST = 350_000  # words in the cache, some 60 MB

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        with open(path) as f:
            rule = json.load(f)
        steps = rule.get("normalizer") or {}
        first = (rule.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.splits = (
            [x.get("type") for x in steps.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and steps["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
            and [x.get("type") for x in first] == ["Split", "ByteLevel"]
            and first[0].get("pattern") == {"Regex": SPLIT} and first[0].get("behavior") == "Removed" and first[0].get("invert")
            and not first[1].get("add_prefix_space") and not first[1].get("use_regex")
            and rule["model"].get("type") == "BPE" and not rule.get("post_processor")
            and all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) and not re.search(r"\s", t.content) for t in added)
        )
        names = sorted((re.escape(t.content.encode()) for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(names)) if names else None
        self.spell = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.first, self.size, self.flat = array("q"), array("q"), array("I")

    def whole(self, texts: list[str]):
        for i in range(0, len(texts), 2000):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False):
                yield e.ids

    def learn(self, easy: list[bytes], hard: list[bytes]) -> None:
        merge, spell, first = self.tokenizer.model.tokenize, self.spell, len(self.flat)
        names = [w.decode() if w.isascii() else w.decode().translate(spell) for w in easy]
        ids = [[t.id for t in merge(n)] for n in names]
        ids += self.whole([w.decode() for w in hard])
        sizes = list(map(len, ids))
        self.slot.update(zip(chain(easy, hard), range(len(self.size), len(self.size) + len(ids))))
        self.first.extend(accumulate(sizes[:-1], initial=first) if ids else ())
        self.size.extend(sizes)
        self.flat.extend(chain.from_iterable(ids))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        import pyarrow as pa

        if not self.splits:
            ids = [np.array(i, np.uint32) for i in self.whole([t.decode() for t in texts])]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([len(i) for i in ids], dtype=np.int64)
        data = b" ".join(texts) + b"    "
        starts, hard, low, offsets = split_words(data, self.special)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        known, number = values(words.dictionary), words.indices.to_numpy()
        if len(self.slot) + len(known) > self.MOST:
            self.forget()
        if len(known) > len(self.slot) or not all(map(self.slot.__contains__, known)):
            odd = {known[i] for i in np.unique(number[hard])}
            new = [w for w in known if w not in self.slot]
            self.learn([w for w in new if w not in odd], [w for w in new if w in odd])
        slots = np.fromiter(map(self.slot.__getitem__, known), np.int64, len(known))
        size = np.frombuffer(self.size, np.int64)[slots][number] if len(slots) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        shift = np.frombuffer(self.first, np.int64)[slots][number] - (ends - size) if len(slots) else size
        at = np.repeat(shift, size)
        at += np.arange(len(at))
        ids = np.frombuffer(self.flat, np.uint32)[at] if len(at) else at.astype(np.uint32)
        last = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, last)]


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece of at most window tokens; each document's tokens end with end_id."""
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "ids"]

    @lean
    def cut(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = Encoder(tokenizer)
        for b in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts, CHUNK):
                ids, ends = enc.encode(texts[lo:hi])
                flat = np.insert(ids.astype("<u4"), ends, end_id)
                ends = ends + np.arange(1, hi - lo + 1)
                tokens = np.diff(ends, prepend=0)
                number = -(-tokens // window)
                row = np.repeat(np.arange(hi - lo), number)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)) * window
                length = np.minimum(window, tokens[row] - start)
                at = (ends - tokens)[row] + start
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(at.tolist(), (at + length).tolist())]
                cols = [b.column(0).slice(lo, hi - lo).take(pa.array(row))]
                cols += [pa.array(x, pa.int64()) for x in (start, length, crc, tokens[row])]
                if with_ids:
                    edges = np.append(at * 4, len(flat) * 4).astype(np.int32)
                    cols.append(pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(flat)]))
                yield pa.RecordBatch.from_arrays(cols, names=names[: len(cols)])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {PIECES}" + ", ids binary" * with_ids
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return texts.mapInArrow(cut, schema)


def pack(
    docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece: every token in exactly
    one piece, sequences gapless from offset 0 and at most window long."""
    spark = docs.sparkSession
    small_batches(spark)
    cut = stored(pieces(docs, tokenizer, window, end_id, id_col, text_col, with_ids))
    by_length = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    runs, _ = plan(by_length, window)

    # pieces of one length are dealt into parts, so that no task ranks more than some PIECES_PER_RANK of them
    parts = spark.createDataFrame([(k, -(-n // PIECES_PER_RANK)) for k, n in by_length.items()], "length long, parts long")
    salt = F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.col("parts")).alias("salt")
    salted = cut.join(F.broadcast(parts), "length").select(*cut.columns, salt)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # a row for every PIECES_PER_RANK pieces
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    runs = spark.createDataFrame(runs, "run_length long, lo long, hi long, first long, per long, at long")  # their number hangs on window
    inside = Window.partitionBy("length", "salt").orderBy(id_col, "start", "ids_crc32")
    ranked = salted.withColumn("i", F.row_number().over(inside)).join(bases, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("i") - 1)
    found = ranked.join(
        F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    )
    sequence = F.expr("first + (rank - lo) div per").alias("sequence_id")
    offset = F.expr("at + ((rank - lo) % per) * length").alias("offset")
    return found.select(id_col, "start", "length", "ids_crc32", "doc_tokens", sequence, offset, *["ids"] * with_ids)
