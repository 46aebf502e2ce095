"""Operators 1, 4 and 5 against the libraries and their own laws."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from captionlake.llm import packing, shards, token_counts

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb c", "the  of\t x", "▁a ▁", "<s> </s> <unk>", "<|endoftext|>x <|startoftext|>",
    "It's DON'T 123 4a5", "naïve café ß İ", "日本語 テキスト", "🙂👨‍👩‍👧 x", "\x1cq\x1c r s t", "word " * 3000, "x" * 5000, "a\x00b",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Length long, salt int, slot string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 1, 9, 9, "x") for i, t in enumerate(ODD * 2)]
    rows += [rows[9], rows[9], (None, "null id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_packing_holds_every_token_once(spark, docs):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack(docs, path, window=64, with_ids=True).toPandas()
    want = [np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()]
    assert Counter((len(w), zlib.crc32(w[:64].tobytes())) for w in want) == Counter(
        (t, c) for t, c, s in zip(got.doc_tokens, got.ids_crc32, got.start) if s == 0
    )
    assert got.length.sum() == sum(map(len, want))
    assert all(zlib.crc32(i) == c and len(i) == 4 * n for i, c, n in zip(got.ids, got.ids_crc32, got.length))
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        ends = (seq.offset + seq.length).tolist()
        assert seq.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 64


@pytest.mark.parametrize("name,splits", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_the_library(name, splits):
    enc, rng = packing.Encoder(P.path(name)), random.Random(1)
    assert enc.splits == splits
    odd = ["it's don't we're they've i'm i'll he'd 'twas 's's x''s .'s 1's '", "x×y ×÷ ÀÉÎ", "<|endoftext|>'s <|ENDOFTEXT|>", "''re", "'R'E'LL 'Ll", "é É ́", "² ½ ª"]
    odd += [t or "" for t in ODD] + ["".join(rng.choices("'srtvelmd A1,.É é×’́<|\u00a0", k=rng.randint(0, 30))) for _ in range(2000)]
    for _ in range(2):
        ids, ends = enc.encode([t.encode() for t in odd])
        for t, s, e in zip(odd, [0, *ends[:-1]], ends):
            assert ids[s:e].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert [len(x) for x in enc.encode([])] == [0, 0] and enc.encode([b"", b""])[1].tolist() == [0, 0]


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(60):
        window = int(rng.integers(4, 40))
        lengths = rng.integers(1, window + 1, int(rng.integers(0, 80))).tolist()
        room = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in room if r >= x]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - x)
            else:
                room.append(window - x)
        runs, n = packing.plan(Counter(lengths), window)
        used = Counter()
        for length, lo, hi, first, per, at in runs:
            for i in range(hi - lo):
                assert used[first + i // per] == at + i % per * length
                used[first + i // per] += length
        assert n == len(room) and sorted(window - u for u in used.values()) == sorted(room)


def test_interleaving_is_even_and_proportional(spark, docs):
    got = shards.interleave(docs, shards=7).toPandas()
    assert len(got) == docs.count()
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1 and len(n) == 7
    for s, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    for s, x in got.groupby(got.stratum.fillna("none")):
        per = x.groupby("shard").size().reindex(range(7), fill_value=0)
        assert per.max() - per.min() <= 2
    sizes = {r.doc_id: len((r.text or "").encode()) + 8 for r in docs.collect()}
    assert all(sizes[None if i != i else int(i)] == z for i, z in zip(got.doc_id, got["size"]))


def test_ranges_do_not_change_the_order(spark, docs, monkeypatch):
    one = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in shards.interleave(docs, 5).collect()}
    monkeypatch.setattr(shards, "ROWS_PER_RANGE", 3)
    assert one == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in shards.interleave(docs, 5).collect()}


def test_counts_equal_the_library(spark, docs):
    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or ""))) for r in docs.collect())
    got = token_counts.count_tokens(docs, path, limit=100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
    assert shards.interleave(none, 24).count() == 0
    assert token_counts.count_tokens(none, P.path("piece_bpe_32k.model")).count() == 0


def test_token_cache_keeps_short_units_only():
    c = token_counts.PieceCounter(P.path("piece_bpe_32k.model"))
    texts = ["文字がつづく" * 40, "short words stay", "x" * 65, "x" * 64]
    assert c.count(texts) == [len(ids) for ids in c.model.encode(texts)] == c.count(texts)
    assert max(map(len, c.known)) <= c.LONGEST and "x" * 64 in c.known
    c.MOST = len(c.whole) + 3
    assert c.count(["a bb ccc qqqq zzzzz wwwwww"] * 2) == [len(c.model.encode("a bb ccc qqqq zzzzz wwwwww"))] * 2
    c.forget()
    assert c.known == c.whole
