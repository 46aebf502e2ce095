"""The whole cleaning, one segment after another."""

import random
import unicodedata
from collections import Counter

from captionlake.operators import grouping
from captionlake.sources import fixtures as fx
from tests.test_rules import key, trimmed

SEGMENTS = "media_id long, seg_idx long, text string, start_ms double, end_ms double, avg_logprob double, compression_ratio double, no_speech_prob double"


def low_key(text):
    """As for loops, but in lower case."""
    words = [key(w) if "\u00df" not in w else w.lower() for w in unicodedata.normalize("NFC", text).split()]
    return " ".join(w for w in words if w)


def cleaned(rows):
    """rows of one media in order; (text, start, end, trimmed, adjusted, reason, output_index) of each."""
    out, last, reach, n = [], None, 0.0, 0
    for text, start, end, log, ratio, silent in rows:
        start, end = max(start, 0.0), max(end, 0.0)
        if end <= start:
            out.append((text, start, end, False, False, "invalid_timestamp", None))
            continue
        reason = "no_speech" if silent > 0.6 and log < -1 else "low_confidence_repetition" if ratio > 2.4 and log < -1 else None
        if reason:
            out.append((text, start, end, False, False, reason, None))
            continue
        text, cut = trimmed(text, log)
        k = low_key(text)
        if not k:
            out.append((text, start, end, cut, False, "empty_or_decoder_loop", None))
        elif k == last and start < reach:
            out.append((text, start, end, cut, False, "duplicate", None))
        elif end <= max(start, reach):
            out.append((text, max(start, reach), end, cut, True, "fully_overlapped", None))
        else:
            out.append((text, max(start, reach), end, cut, start < reach, None, n))
            last, reach, n = k, end, n + 1
    return out


def test_cleaning_equals_the_rules(spark):
    rng = random.Random(9)
    rows = []
    for m in range(30):
        at = 0.0
        for i in range(rng.randint(1, 25)):
            text = rng.choice(["yes yes", "Yes, yes!", "no", "-- !", "ha " * rng.randint(3, 12), "so " + "no, No " * 6 + "done", "Maße", "Masse"])
            start = at - rng.choice([0, 0, 300, 900])
            rows.append((m, i, text, start, start + rng.choice([0, 200, 800, 1500]), rng.choice([-0.5, -1.5]), rng.choice([1.0, 2.6]) if rng.random() < 0.3 else 1.0, rng.choice([0.1, 0.9]) if rng.random() < 0.3 else 0.1))
            at += 600
    trace = grouping.sanitize_segments(spark.createDataFrame(rows, SEGMENTS)).cache()
    got, report = {}, {r.media_id: r for r in grouping.trace_report(trace).collect()}
    for r in trace.orderBy("seg_idx").collect():
        got.setdefault(r.media_id, []).append((r.text, r.start_ms, r.end_ms, r.trimmed, r.adjusted, r.reason, r.output_index))
    reasons = Counter()
    for m in range(30):
        want = cleaned([r[2:] for r in rows if r[0] == m])
        assert got[m] == want, m
        gone, told = Counter(x[5] for x in want if x[5]), report[m]
        reasons += gone
        assert told.by_reason == dict(gone) and (told.n_input, told.n_output, told.n_removed) == (len(want), len(want) - sum(gone.values()), sum(gone.values()))
        assert (told.overlaps_adjusted, told.loops_trimmed) == (sum(x[4] for x in want), sum(x[3] for x in want)) and told.quality_warning == (sum(gone.values()) >= max(5, -(-len(want) * 5 // 100)))
    assert set(reasons) == {"invalid_timestamp", "no_speech", "low_confidence_repetition", "empty_or_decoder_loop", "duplicate", "fully_overlapped"}
    trace.unpersist()


def test_every_segment_of_the_tables_has_a_trace(spark):
    s = fx.segments(spark, "/root/testdata/sf0.001")
    trace = grouping.sanitize_segments(s)
    assert trace.count() == s.count() and trace.where("reason is null and end_ms <= start_ms").count() == 0
