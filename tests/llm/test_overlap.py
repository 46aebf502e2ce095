"""Operators 6, 7 and 8 and the pipeline against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from captionlake.llm import components, decontaminate, ngram_join, substring_dedup
from captionlake.llm.common import bitmap_of, drop_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = ["the", "of", "and", *("".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(300))]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 160))) for _ in range(60)]
    out = list(base)
    for t in base[:30]:
        w = t.split()
        for _ in range(3):
            x = w[:]
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            out.append(" ".join(x))
    passage = " ".join(rng.choices(vocab, k=30))
    out += [b + " " + passage for b in base[30:45]] + [base[0]] * 6
    return out + [None, "", "  ", "one", "One", "a b", "x" * 400, "x" * 300, "ab" * 100, "Ünï " * 60]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 1, 5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[3], (None, texts[0], None, None, None, None, None)], SCHEMA).repartition(5)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("n,num,postings", [(4, 85, 2_000), (5, 80, 2_000), (1, 50, 3)])
def test_join_equals_all_pairs(docs, texts, n, num, postings, monkeypatch):
    monkeypatch.setattr(ngram_join, "POSTINGS", postings)  # few, so that common tokens are compared by parts
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= num * len(a | sets[j]):
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    got = ngram_join.near_duplicates(docs, n, num, 100).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), up[r.doc_id])


def test_cut_equals_all_windows(docs, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART", 300)
    for _ in range(2):
        got = {r.doc_id: r for r in substring_dedup.cut_repeats(docs, 50).collect()}
        seen = set()
        for i, t in enumerate(texts):
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            own = {b[p : p + 50] for p in range(len(b) - 49)}
            for p in range(len(b) - 49):
                if b[p : p + 50] in seen:
                    gone[p : p + 50] = True
            seen |= own
            spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
            kept = bytes(x for x, g in zip(b, gone) if not g)
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        monkeypatch.undo()


@pytest.mark.parametrize("block_bytes", [16_000_000, 1500])
def test_contamination_equals_plain_search(spark, docs, texts, block_bytes):
    items = [(1, " ".join(texts[2].split()[5:40])), (2, "one"), (10, texts[40]), (11, None), (12, "..."), (None, texts[1]), (3, texts[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(low(t))
        if i is not None and w:
            for s in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[s : s + 10]), set()).add(i)
    got = decontaminate.digest(decontaminate.matches(docs, bench, 10, block_bytes=block_bytes)).collect()
    assert len(got) == len(texts) + 2
    for r in (r for r in got if r.doc_id is not None):
        w = word.findall(low(texts[r.doc_id]))
        hit, found = set(), set()
        for x, i in windows.items():
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit.update(range(s, s + len(x)))
                    found |= i
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a b c"), (3, "c b a")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    hits = lambda slop: {r.id for r in decontaminate.matches(docs, bench, 10, slop).collect() if r.spans}
    assert hits(0) == {2} and hits(2) == {1, 2} and hits(4) == {1, 2, 3}


def test_components_and_drops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[150] == got[200] == got[100] == 100
    assert components.components(edges.limit(0)).count() == 0
    assert bitmap_of(spark.range(0, 50), "id", 16).test(np.arange(60)).sum() == 50
    rows = spark.createDataFrame([(i % 7 or None, f"t{i}", i, 0, 0) for i in range(28)], "doc_id long, text string, `__key` long, KEY_id long, key_hash long")
    gone = spark.createDataFrame([(None, "t7"), (3, "t3"), (4, None), (5, "t6")], "id long, text string")
    left = drop_rows(rows, gone, {"id": F.col("doc_id"), "text": F.col("text")})
    assert left.columns == rows.columns and sorted(r[2] for r in left.collect()) == [i for i in range(28) if i not in (3, 7)]
    assert drop_rows(rows, gone.limit(0), {"id": F.col("doc_id")}).count() == 28


def test_empty_tables(spark, docs):
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    assert substring_dedup.cut_repeats(docs.limit(0)).count() == 0
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    got = decontaminate.digest(decontaminate.matches(docs, bench.limit(0))).collect()
    assert len(got) == docs.count() and not any(r.contaminated or r.n_items for r in got)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Odd documents under names that the stages use themselves, and a benchmark."""
    words = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' and length(text) > 400").limit(12).collect()]
    item = " ".join(f"quux{i} zorb{i}" for i in range(8))
    rows = [(i, w) for i, w in enumerate(words)] + [
        (20, words[0]), (21, words[1] + " end"), (None, words[2] + " " + item), (None, words[3].upper() + " own words here"), (22, words[4][:200] + " " + item + " " + words[5][:200]),
        (23, None), (24, ""), (25, "12 34 !"), (26, "the secret: abcdefGHIJKL012345 of " + words[6][100:300]), (26, "the other text with that id, " + words[7][50:250]),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars int, score double, all_spans string, `__key` string, lang_pred string, h long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.25, "mine", "k", "zz", 7) for i, t in rows], columns)
    path = tmp_path_factory.mktemp("planted")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs.write.parquet(f"{path}/documents.parquet")
    return docs, str(path), words


def test_pipeline_stages_do_what_they_say(spark, planted):
    docs, path, words = planted
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())
    now = stages["language"](spark, docs, path)
    assert now.columns == docs.columns and texts(now) == texts(docs.where("doc_id is null or doc_id not in (23, 24, 25)"))
    assert {(r.score, r.lang_pred) for r in now.collect()} == {(0.25, "zz")}
    after = stages["near_duplicates"](spark, now, path)
    assert after.columns == docs.columns and texts(after) == texts(now.where("doc_id is null or doc_id not in (20, 21)"))
    last = stages["decontamination"](spark, after, path)
    assert last.columns == docs.columns and texts(last) == texts(after.where("not text like '%quux3 zorb3%'"))
    clean = stages["secret_scan"](spark, last, path)
    assert clean.columns == docs.columns and clean.count() == last.count()
    assert not clean.where("text like '%GHIJKL%'").count() and all(r.n_chars == len(r.text) and r.all_spans == "mine" for r in clean.collect())
    pieces = stages["packing"](spark, clean, path).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and sum(r.start == 0 for r in pieces) == clean.count()
    assert [r.length for r in pieces] and len(corpus_pipeline.run(spark, path).collect()) == len(pieces)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, now, sf)
        assert after.columns == docs.columns and 0 < after.count() <= now.count(), name
        now = after
    assert corpus_pipeline.STAGES[4][1](spark, now, sf).count() >= now.count()
