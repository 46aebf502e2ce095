"""Folds with a value for each element, and the cleaning that is made of one, against plain loops."""

import random

from pyspark.sql import functions as F

from captionlake.functions.folds import scan
from captionlake.operators import grouping


def test_scan_equals_a_loop(spark):
    rng = random.Random(3)
    lists = [None, [], [5], *([rng.randint(-9, 9) for _ in range(n)] for n in (2, 3, 4, 9, 10, 99, 1000))]
    step = lambda s, x: F.struct((s + x).alias("s"), (s * 2 + x).cast("string").alias("o"))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<bigint>")
    got = {r.i: r.o for r in rows.select("i", scan(F.col("x"), F.lit(0).cast("bigint"), step, "string").alias("o")).collect()}
    for i, xs in enumerate(lists):
        want, s = [], 0
        for x in xs or []:
            want.append(str(s * 2 + x))
            s += x
        assert got[i] == (want if xs is not None else None)


def cleaned(rows):
    last, reach, out = None, 0, {}
    for seg, text, start, end in rows:
        if not text:
            out[seg] = (start, "empty_or_decoder_loop")
        elif text == last and start < reach:
            out[seg] = (start, "duplicate")
        elif end <= max(start, reach):
            out[seg] = (max(start, reach), "fully_overlapped")
        else:
            out[seg] = (max(start, reach), None)
            last, reach = text, end
    return out


def test_sanitize_equals_a_loop(spark):
    rng = random.Random(9)
    rows = {}
    for m in range(60):
        wide = rng.choice([2, 10, 40])  # few or many overlaps
        rows[m] = [(i, rng.choice(["a", "b", "c", "", None]), s := max(0, i * 5 + rng.randint(-wide, wide)), s + rng.randint(0, wide)) for i in range(rng.randint(1, 40))]
    rows[99] = [(i, "ab"[i // 3 % 2], i, 5000) for i in range(2000)]  # one island, of a whole media
    for kind in ("long", "double"):
        data = [(m, i, t, s if kind == "long" else float(s), e if kind == "long" else float(e), None) for m, xs in rows.items() for i, t, s, e in xs]
        judged = spark.createDataFrame(data, f"media_id long, seg_idx long, text string, start_ms {kind}, end_ms {kind}, reason string")
        got = {(r.media_id, r.seg_idx): (r.start_ms, r.reason) for r in grouping.sanitize(judged).collect()}
        assert got == {(m, i): v for m, xs in rows.items() for i, v in cleaned(xs).items()}
        assert grouping.sanitize(judged.limit(0)).count() == 0
