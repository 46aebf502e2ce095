"""Operators 11, 12 and 13 against brute force and round trips, with odd rows and damaged archives."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionlake.llm import periodic, queries, variants, warc
from captionlake.llm.common import scratch_dir

DATA = "/root/testdata/sf0.001"


# ---- 11


def archived(spark, rows, schema="page_id long, url string, html string", **options):
    path = scratch_dir(spark)
    warc.write_archives(spark.createDataFrame(rows, schema).repartition(3), path, **options)
    return path


def test_archives_come_back_whole(spark):
    long = "é<p>" * 3000
    rows = [(5, "http://a/ü\r\nX: y", long), (3, "http://b", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\n\r\n" * 20), (6, "u", "x" * 100), (10, "u", "x" * 100)]
    rows += [(5, "http://a", long), (3, "http://b", long), (None, "u", long), (None, "u", "n" * 150), (-1, "u", "y" * 99), (-2, "u", "y" * 99)]
    for segment, hot in ((64, 4096), (1000, 0), (10**6, 4096)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(warc, "MOST_HOT", hot)
            path = archived(spark, rows, segment=segment)
        whole = warc.reassembled(warc.read_records(spark, path))
        want = Counter()
        for i, _, t in rows:
            body = (t or "").encode()
            others = [j for j, _, u in rows if u == t and j is not None]
            least = min(others) if len(body) >= 100 and others else i
            want[i, len(body), hashlib.sha256(body).hexdigest(), "response" if i == least else "revisit", None if i == least else least, None] += 1
        got = warc.resolved(whole).withColumns({"id": warc.page_number(F.col("record_id")), "first": warc.page_number(F.col("refers_to"))})
        assert Counter(tuple(r) for r in got.select("id", "payload_bytes", "payload_digest", "record_type", "first", "problem").collect()) == want
        bodies = Counter(r.payload.decode() for r in whole.where("record_type = 'response'").select("payload").collect())
        assert bodies[long] == 2 and bodies[""] == 2 and bodies["short"] == 2 and all(b in [t or "" for _, _, t in rows] for b in bodies)


def raw(spark, *files):
    """Files of given bytes, where Spark can read them."""
    path = scratch_dir(spark)
    import os

    os.makedirs(path)
    for i, f in enumerate(files):
        with open(f"{path}/f{i}.warc", "wb") as out:
            out.write(f)
    return path


def test_damaged_archives(spark):
    seg = lambda n, block, total=None, origin="o": warc.record([("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", f"<{origin}>" if n == 1 else f"<{origin}:{n}>"), ("WARC-Segment-Origin-ID", "" if n == 1 else f"<{origin}>"), ("WARC-Segment-Number", str(n)), ("WARC-Segment-Total-Length", str(total or ""))], block) + b"\r\n"
    one = lambda name, block, kind="application/http", digest="": warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), ("Content-Type", kind), ("WARC-Payload-Digest", digest)], block) + b"\r\n"
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    good = [seg(2, b"cd"), seg(3, b"e", 5), seg(1, b"ab")]
    files = [
        good[0] + good[2], good[1], seg(1, b"ab", origin="gap") + seg(3, b"e", 5, origin="gap"), seg(1, b"ab", origin="open") + seg(2, b"cd", origin="open"), seg(2, b"x", 3, origin="headless"),
        seg(1, b"ab", origin="long") + seg(2, b"c", 9, origin="long"), seg(1, b"ab", origin="two") + seg(2, b"c", 3, origin="two") + seg(2, b"d", 3, origin="two"),
        one("chunks", head + b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n") + one("plain", b"xyz", "text/plain"), one("badchunk", head + b"5\r\nabc\r\n0\r\n\r\n"), one("nochunk", head + b"zz\r\n"),
        one("nohttp", b"HTTP/1.1 200 OK\r\n"), one("short", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc"), one("digest", b"abc", "text/plain", "sha256:00"),
        gzip.compress(one("m1", b"1", "t")) + gzip.compress(one("m2", b"2", "t")), gzip.compress(one("cut", b"a" * 50_000, "t"), 0)[:20_000], b"nonsense\r\nmore\r\n\r\n", b"WARC/1.1\r\nContent-Length: 5", b"", b"\r\n",
    ]
    got = Counter((r.record_id, bytes(r.payload) if r.payload is not None else None, r.problem) for r in warc.reassembled(warc.read_records(spark, raw(spark, *files))).collect())
    assert got == Counter({
        ("o", b"abcde", None): 1, ("gap", None, "missingSegment"): 1, ("open", None, "missingSegment"): 1, ("headless", None, "missingSegment"): 1, ("long", None, "lengthMismatch"): 1, ("two", None, "conflictingSegments"): 1,
        ("chunks", b"abcde", None): 1, ("plain", b"xyz", None): 1, ("badchunk", None, "badChunk"): 1, ("nochunk", None, "badChunk"): 1, ("nohttp", None, "badHttp"): 1, ("short", None, "lengthMismatch"): 1,
        ("digest", None, "digestMismatch"): 1, ("m1", b"1", None): 1, ("m2", b"2", None): 1, ("cut", None, "truncated"): 1, (None, None, "badHeader"): 2,
    })
    lost = warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<r>"), ("WARC-Refers-To", "<gone>"), ("WARC-Payload-Digest", "sha256:ab")], b"") + b"\r\n"
    assert [(r.payload_bytes, r.problem) for r in warc.resolved(warc.reassembled(warc.read_records(spark, raw(spark, lost)))).collect()] == [(None, "unresolvedRevisit")]


def test_archives_of_no_pages_and_of_clashing_columns(spark):
    assert warc.reassembled(warc.read_records(spark, archived(spark, []))).count() == 0
    odd = [(1, "u", "abc", "x", 2, "y", True)]
    path = archived(spark, odd, "page_id int, url string, html string, digest string, id long, payload string, long boolean")
    assert [bytes(r.payload) for r in warc.reassembled(warc.read_records(spark, path)).collect()] == [b"abc"]


def test_chunked_framing_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 100):
        body = rng.randbytes(n)
        assert warc.unchunked(warc.chunked(body, 8)) == body
        assert n == 0 or warc.unchunked(warc.chunked(body, 8)[:-6]) is None


# ---- 12


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, o, m) for o, m in counts.items() if one_edit(w, o)]
        best = min(near, default=None)
        form = best if best and best[2] >= 5 * n else None
        out[w] = (n, len(near), form[1] if form else None, form[2] if form else None)
    root = lambda w: root(out[w][2]) if out[w][2] else w
    return {(w, *x, root(w)) for w, x in out.items()}


def test_variants_equal_all_pairs(spark):
    rng = random.Random(2)
    words = set()
    for _ in range(60):
        base = "".join(rng.choices("abcé", k=rng.randint(6, 9)))
        words.add(base)
        for _ in range(6):
            i = rng.randrange(len(base) + 1)
            words.add(rng.choice([base[:i] + base[i + 1 :], base[:i] + rng.choice("abÿ") + base[i:], base[:i] + rng.choice("abc") + base[i + 1 :]]))
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab", "baaaaa", "ababab", "bababa", "abababa"}
    counts = {w: rng.choice([5, 5, 6, 25, 125, 700, 4000]) for w in words if len(w) >= 4}
    got = variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == grouped(counts)
    assert any(r[3] and r[5] != r[3] for r in grouped(counts))  # some chains are longer than one step


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(3)
    for _ in range(300):
        places = [(p, rng.randint(1, 9)) for p in sorted(rng.sample(range(12), rng.randint(3, 7)))]
        p, q = variants.pivots(places)
        n = dict(places)
        assert q - p >= 2 and n[p] + n[q] == min(a + b for x, a in places for y, b in places if y - x >= 2)


def spelled(rows):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def test_vocabulary_equals_loops(spark):
    rng = random.Random(4)
    stems = ["straße", "ÉTUDES", "Wonderful", "naïveté", "abcdef", "×÷×÷×÷", "ab", "seveneleven"]
    rows = [(i % 90, " ".join(rng.choice(stems) for _ in range(12)) + "-x1Wonderful") for i in range(120)] + [(None, "wonderful " * 6), (3, None), (4, ""), (5, "z" * 50_000)]
    got = variants.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), slips=199)
    assert {r.word: r.n for r in got.collect()} == spelled(rows)
    assert variants.group_variants(variants.vocabulary(spark.createDataFrame([], "doc_id long, text string"), slips=199)).count() == 0


def test_variants_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_spelling_variants(spark, DATA).collect()
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == grouped(spelled([tuple(r) for r in docs])) and len(got) > 500


# ---- 13


def plain_runs(words):
    """Each period from the smallest on, each stretch of equal words that far apart."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and not any(s <= i and j + q <= s + m and q % p == 0 for s, m, p in out):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(words, i):
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def expected(i, text, loops):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    words = looped(words, i) if loops else words
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


def texts_with_runs():
    rng = random.Random(6)
    out = [None, "", " \t", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "\x0ba b c " * 9, "x " * 2000, "a b a b a b a b a b c c c c c c d " * 8]
    for _ in range(150):
        words = []
        while len(words) < rng.randint(1, 120):
            unit = rng.choices("abcd", k=rng.randint(1, 14))
            words += (unit * rng.randint(1, 7))[: rng.randint(1, 60)]
        out.append(" ".join(words))
    return out + [" ".join(rng.choices("ab", k=n)) for n in (40, 200, 400)] + [" ".join(map(str, range(q))) * 1 + (" " + " ".join(map(str, range(q)))) * 5 for q in (15, 16, 17, 33, 63, 64, 65)]


@pytest.mark.parametrize("most", [100_000, 50])
def test_runs_equal_every_period_tried(spark, most, monkeypatch):
    monkeypatch.setattr(periodic, "WORDS", most)
    rows = list(enumerate(texts_with_runs())) + [(3, "a b c d"), (None, "q r " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for loops in (False, True):
        got = periodic.digest(periodic.detect(docs, loops)).collect()
        assert Counter(tuple(r) for r in got) == Counter(expected(i, t, loops) for i, t in rows)


def test_runs_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {expected(r.doc_id, r.text, True) for r in docs}
    assert {tuple(r) for r in queries.op13_periodic_runs(spark, DATA).collect()} == want and sum(w[1] > 0 for w in want) > 10


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    v = rng.permutation(37)
    tree = periodic.WaveletMatrix(v, 6)
    lo = rng.integers(0, 36, 200)
    hi = lo + 1 + rng.integers(0, 37 - lo)
    x = rng.integers(0, 38, 200)
    less = tree.less(lo, hi, x)
    assert less.tolist() == [int((v[a:b] < c).sum()) for a, b, c in zip(lo, hi, x)]
    n = rng.integers(0, hi - lo)
    assert tree.nth(lo, hi, n).tolist() == [sorted(v[a:b])[c] for a, b, c in zip(lo, hi, n)]
