"""Rules over texts, layout and timing: loops over each rule as it is told, and scripts and values that the tables lack."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from captionlake.functions import scalars as X
from captionlake.functions import texts as T
from captionlake.operators import cleaning, grouping, layout, policy, quality, results, speech, status, timeline
from captionlake.sources import timelines


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_keys_of_words(spark):
    texts = ["Don\u2019t  STOP -- '' 42!", "Ma\u00dfe", "cafe\u0301 \u0130", "\u65e5\u672c\u8a9e \u3000\u201b\u0928\u093f", None, ""]
    got = values(spark, [(t,) for t in texts], "t string", T.compare_key(F.col("t")), T.duplicate_key(F.col("t")))
    assert got[0] == ("don't stop 42",) * 2 and got[1] == ("masse", "ma\u00dfe") and got[2][1] == unicodedata.normalize("NFC", "caf\u00e9 i\u0307")
    assert got[3] == ("\u65e5\u672c\u8a9e '\u0928\u093f",) * 2 and got[4] == (None, None) and got[5] == ("", "")


def test_widths(spark):
    rows = [("a\uff76\u65e5\n", "ja"), ("a.\ud55c\u3001", "ko"), ("\U0001f468\u200d\U0001f469 e\u0301", "en"), ("", "ja")]
    assert [r[0] for r in values(spark, rows, "t string, l string", T.char_units(F.col("t"), F.col("l")))] == [2.0, 2.5, 3.0, 0.0]


def test_words_are_joined(spark):
    rows = [([" Hello", " there", ",", " you", "\uff09", "", None, "x"], "en"), (["\u65e5", "\u672c", "\u3002"], "ja"), ([], "en")]
    assert [r[0] for r in values(spark, rows, "w array<string>, l string", T.join_words(F.col("w"), F.col("l")))] == ["Hello there, you\uff09 x", "\u65e5\u672c\u3002", ""]


def test_sentences_end_behind_closers(spark):
    rows = ["\u7d42\u3002\u300d", "ok.\u201d)", "\uff01\uff09\u3011 ", "no\u300d", "\u0964"]
    assert [r[0] for r in values(spark, [(t,) for t in rows], "t string", X.ends_sentence(F.col("t")))] == [True, True, True, False, True]


def test_blank_in_any_script(spark):
    rows = [("\u00a0\u3000\u2028",), ("a\u00a0\u00a0b ",), (None,)]
    assert values(spark, rows, "t string", T.damage(F.col("t")), T.caption(F.col("t"))) == [("empty", ""), (None, "a b"), ("empty", None)]


def test_times_and_metrics_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(nan, 5.0, -2.0, 0.1, 3.0), (0.0, inf, 0.0, 0.1, 1.0), (-inf, 5.0, 0.0, 0.1, 1.0), (inf, inf, 0.0, 0.0, 0.0), (0.0, 5.0, -2.0, nan, nan), (0.0, 5.0, nan, 0.9, 9.0), (None, 5.0, 0.0, 0.0, 0.0), (0.0, 5.0, -2.0, 0.9, None), (0.0, nan, 0.0, 0.0, 0.0)]
    got = cleaning.judge_segments(spark.createDataFrame(rows, "start_ms double, end_ms double, avg_logprob double, no_speech_prob double, compression_ratio double")).collect()
    bad = "invalid_timestamp"
    assert [r.reason for r in got] == ["low_confidence_repetition", bad, None, bad, None, None, bad, "no_speech", bad] and got[0].start_ms == 0


def test_string_ids_and_odd_lines(spark):
    rows = [(1, '{"unit_id": "u-7", "text": "x"}'), (1, '{"unitID": 3}'), (1, "nonsense"), (1, '{"id": null, "text": "y"}')]
    got = timelines.read_translations(spark.createDataFrame(rows, "media_id long, line string")).collect()
    assert [(r.unit_id, r.text) for r in got] == [("u-7", "x"), ("3", ""), (None, ""), (None, "y")]
    got = policy.scan_files(spark.createDataFrame([("a/ID_RSA", "x"), ("b/c", None)], "path string, text string")).collect()
    assert [tuple(r) for r in got] == [("a/ID_RSA", "forbiddenName")]
    rows = [(1, 0, "[1]"), (1, 1, '{"start": "1.5", "end": "NaN", "words": [{"word": "a", "start": true}, null]}'), (1, 2, "{broken"), (1, 3, None)]
    got = speech.read_segments(spark.createDataFrame(rows, "media_id long, seg_idx long, line string")).orderBy("seg_idx").collect()
    assert [(r.is_object, r.start, r.end) for r in got] == [(False, None, None), (True, 1.5, None), (False, None, None), (False, None, None)] and len(got[1].words) == 1


def test_usable_words(spark):
    word = lambda t, s, e: (t, s, e, 0.5)
    good = [word(" a", 1.0, 2.0), word(" b", 2.0, 3.0)]
    cases = [("a b", good), ("a c", good), ("a b", [good[1], good[0]]), ("a b", [word(" a", 0.5, 2.0), good[1]]), ("a b", [good[0], word(" b", 2.0, 3.5)]), ("a b", [good[0], word(" b", 1.5, 3.0)]), ("a b", [word(" a", None, 2.0), good[1]]), ("a b", []), ("a b", None)]
    got = values(spark, cases, "t string, w array<struct<text:string,start:double,end:double,probability:double>>", speech.usable_words(F.col("t"), F.lit(1.0), F.lit(3.0), F.col("w")).alias("x"))
    assert [len(r[0]) for r in got] == [2] + [1] * 8 and tuple(got[1][0][0]) == ("a c", 1.0, 3.0, None)


def key(w):
    w = unicodedata.normalize("NFC", unicodedata.normalize("NFC", w).casefold())
    kept = "".join(c for c in w.translate(str.maketrans({c: "'" for c in T.APOSTROPHES})) if unicodedata.category(c)[0] in "LMN" or c == "'")
    return kept if any(unicodedata.category(c)[0] in "LN" for c in kept) else ""


def told_by(stamps, text):
    """Where each stamped word stands in the text, without white space around it; None unless they are its units."""
    if not stamps or None in stamps or "".join(stamps).strip() != text:
        return None
    spans, at = [], -(len("".join(stamps)) - len("".join(stamps).lstrip()))
    for w in stamps:
        if w.strip():
            lead = len(w) - len(w.lstrip())
            spans.append((at + lead, at + lead + len(w.strip())))
        at += len(w)
    return spans if len(spans) >= 4 else None


def trimmed(text, logprob, stamps=None):
    """Every start and phrase length is tried."""
    text = text.strip()
    tokens = [m.span() for m in re.finditer(r"\S+", text)]
    spans = [(i, i + 1) for i in range(len(text))] if len(tokens) < 4 and re.search("[\u3040-\u30ff\u4e00-\u9fff]", text) else tokens
    spans = told_by(stamps, text) or spans
    keys, best = [key(text[a:b]) for a, b in spans], None
    for s in range(len(keys)):
        for p in range(1, (16 if len(tokens) < 4 else 8) + 1):
            n = 1
            while keys[s + n * p : s + (n + 1) * p] == keys[s : s + p] and len(keys[s : s + p]) == p:
                n += 1
            if n >= 4 and n * p >= 8 and any(keys[s : s + p]) and (best is None or (n, n * p) > best[:2]):
                best = (n, n * p, spans[s][0], spans[s + n * p - 1][1])
    if best is None or logprob is None or not logprob < -1:
        return text, False
    head, tail = text[: best[2]], text[best[3] :]
    left = (head + (tail.lstrip() if head[-1:].isspace() and tail[:1].isspace() else tail)).strip()
    return (left if key(left) else ""), True


def test_decoder_loops_equal_every_phrase_tried(spark):
    rng = random.Random(5)
    texts = ["so " + "no, No " * 6 + "that is it", "ha " * 9, "a b c d " * 2, "\u3042\u3044" * 6 + "\u7d42", "- - - - - - - - - x", "uh " * 7, "", "x " * 8 + "y " * 8 + "z", "\u3042" * 8]
    texts += [" ".join(rng.choice(["a", "b", "A,", "--"]) for _ in range(rng.randint(4, 30))) for _ in range(150)]
    rows = [(1, i, t, p) for i, t in enumerate(texts) for p in (-1.5,)] + [(2, 0, texts[0], -0.5), (2, 1, texts[0], None), (2, 2, texts[0], float("nan"))]
    got = speech.trim_decoder_loops(spark.createDataFrame(rows, "media_id long, seg_idx long, text string, avg_logprob double")).collect()
    assert len(got) == len(rows)
    found = {(r.media_id, r.seg_idx): (r.text, r.trimmed) for r in got}
    for m, i, t, p in rows:
        assert found[m, i] == trimmed(t, p), t


def test_decoder_loops_by_stamped_words(spark):
    """Stamped words as units: those of texts without blanks, of several words each, with blanks of their own on either
    side, blank and empty ones; and what doesn't tell the text, which is passed over."""
    rng = random.Random(8)
    cases = [
        ("\u4f60\u597d" * 12, ["\u4f60\u597d"] * 12), ("\u4f60\u597d" * 12, ["\u4f60\u597d"] * 11), ("go on " * 9 + "end", ["go on "] * 9 + ["end"]), ("go on " * 9 + "end", None),
        (" Context" + " glitch" * 20, [" Context"] + [" glitch"] * 20), ("la " * 12, ["la ", None] * 6), ("la la la " * 4, ["la la la "] * 4), ("la la " * 4, ["la la"] * 4), ("la la " * 3, []),
        ("a\u00a0b" * 8, ["a\u00a0b"] * 8), ("ab" * 9, ["", "ab", "ab"] + ["ab"] * 7), ("x\u0000" * 9, ["x\u0000"] * 9), ("no  no  " * 6 + " so", ["no", " ", " no", "  "] * 6 + [" ", "so"]),
        ("$1 \\1 " * 9, ["$1", " \\1", " "] * 9),
    ]
    for _ in range(200):
        stamps = [rng.choice(["a", " a", "b ", " A b", "", " ", "\u3042", "--", "Stra\u00dfe"]) for _ in range(rng.randint(3, 8))] * rng.choice([1, 4, 5]) + rng.choice([[], ["end"], [" end", " "]])
        cases.append(("".join(stamps) + rng.choice(["", "", "", "."]), stamps))
    rows = [(1, i, t, -1.5, w and [(x, float(k)) for k, x in enumerate(w)]) for i, (t, w) in enumerate(cases)]
    schema = "media_id long, seg_idx long, text string, avg_logprob double, words array<struct<text:string,start:double>>"
    segments = spark.createDataFrame(rows, schema)
    found = {r.seg_idx: (r.text, r.trimmed) for r in speech.trim_decoder_loops(segments).collect()}
    assert len(found) == len(cases)
    for i, (t, w) in enumerate(cases):
        held = None if "\u0000" in t else w  # a text with that sign keeps the other units
        assert found[i] == trimmed(t.strip(), -1.5, held), (t, w)
    assert found[0] == ("", True) and found[4] == ("Context", True) and speech.trim_decoder_loops(segments.limit(0)).count() == 0
    # the whole cleaning takes them as well
    timed = segments.where("seg_idx in (0, 4)").selectExpr("*", "seg_idx * 1000 as start_ms", "seg_idx * 1000 + 900 as end_ms", "1.0 as compression_ratio", "0.1 as no_speech_prob")
    assert {r.seg_idx: (r.text, r.trimmed) for r in grouping.sanitize_segments(timed).collect()}[4] == ("Context", True)


def allocated(total, weights, least, most):
    n = len(weights)
    if not n * least - 1e-6 <= total <= n * most + 1e-6:
        return [total * w / sum(weights) for w in weights]
    out, left = {}, total
    while True:
        open_ = [i for i in range(n) if i not in out]
        weight = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight for i in open_}
        bad = next((i for i in open_ if not least <= share[i] <= most), None)
        if bad is None:
            return [out.get(i, share.get(i)) for i in range(n)]
        out[bad] = least if share[bad] < least else most
        left -= out[bad]


def test_durations(spark):
    rng = random.Random(6)
    cases = [(float(rng.randint(1, 30)), [float(rng.choice([0.5, 1, 3, 9, 20])) for _ in range(rng.randint(1, 7))]) for _ in range(200)]
    got = values(spark, cases, "t double, w array<double>", layout.allocate_durations(F.col("t"), F.col("w"), F.lit(1.0), F.lit(7.0)))
    for (t, w), (have,) in zip(cases, got):
        assert have == pytest.approx(allocated(t, w, 1.0, 7.0))


CAPTION = "media_id long, unit_id long, lang string, text string, chars_per_line int, start_ms long, end_ms long"


def test_breaks_in_scripts_without_spaces(spark):
    rows = [(1, 0, "zh", "\u4f60\u597d\uff0c\u4e16\u754c\u300a\u4e66", 16, 0, 1), (1, 1, "ja", "\u65e5\u672c\u3001\u304b\u306a", 13, 0, 1), (1, 2, "en", "don't 12 a-b", 42, 0, 1), (1, 3, "ko", "\uac00\ub098 \ub2e4", 16, 0, 1), (1, 4, "en", "", 42, 0, 1), (1, 5, "en", None, 42, 0, 1)]
    got = layout.break_table(spark.createDataFrame(rows, CAPTION)).collect()
    safe = {u: sorted((r.end, r.rating) for r in got if r.unit_id == u and r.safe) for u in range(6)}
    assert safe[0] == [(1, 1), (3, 2), (4, 1), (5, 1)] and safe[1] == [(3, 2)] and safe[3] == [(2, 4), (3, 4)] and safe[4] == safe[5] == []
    assert safe[2] == [(5, 4), (6, 4), (8, 4), (9, 4), (10, 0), (11, 2)]


def test_lines_and_counts(spark):
    rows = [(1, 0, "en", "one two three four", 10, 0, 20_000), (1, 1, "en", "short", 10, 0, 1000), (1, 2, "en", "x" * 25, 10, 0, 1000), (1, 3, "en", None, 10, 0, 1000), (1, 4, "zh", "\u4f60" * 14, 8, 0, 1000), (1, 5, "ko", "\uac00" * 6 + " a " + "\uac00" * 6, 7, 0, 1000)]
    c = spark.createDataFrame(rows, CAPTION)
    lines = {r.unit_id: r.lines for r in layout.layout_lines(c).collect()}
    assert lines[0] == ["one two", "three four"] and lines[1] == ["short"] and lines[2] == ["x" * 25] and lines[4] == ["\u4f60" * 7] * 2
    assert lines[5] == ["\uac00" * 6 + " a", "\uac00" * 6]  # the blank that goes with the break is half a unit wide
    counts = {r.unit_id: (r.n_cues, r.capped) for r in layout.cue_counts(layout.measure(c)).collect()}
    assert counts[0] == (3, 0) and counts[1] == (1, 0) and counts[2] == (1, 1) and counts[4] == (1, 0)


def even_pieces(text, n, room, breaks, width):
    """Each break is tried on its own: pieces are cut out and measured as texts."""
    fine = {e for e, (rating, safe) in breaks.items() if safe and rating > 0}
    start, out = 0, []
    for left in range(n - 1, 0, -1):
        best = None
        for e in range(start + 1, len(text)):
            rating, safe = breaks[e]
            piece, rest = text[start:e].rstrip(), text[e:].lstrip()
            nxt = len(text) - len(rest)
            whole = not any(start < f < start + len(piece) for f in fine)
            if safe and piece and len(rest.replace(" ", "")) >= left and 1 + sum(f > nxt for f in fine) >= left and (width(piece) <= room + 1e-6 or whole):
                best = max(best or (-1,), (rating, -round(abs(width(piece) - width(text[start:]) / (left + 1)), 6), e, piece, nxt))
        if best is None:
            break
        out.append(best[3])
        start = best[4]
    return out + [text[start:]]


def lines_of(text, line, breaks, width, fine):
    """Every break of a piece (start, end) is tried; (start, end) of its lines."""

    def fits(a, z):
        return width(text[a:z]) <= line or not any(a < f < z for f in fine)

    def trim(a, z):
        while a < z and text[a].isspace():
            a += 1
        while a < z and text[z - 1].isspace():
            z -= 1
        return a, z

    def split(a, z):
        if width(text[a:z]) <= line:
            return [(a, z)]
        best = None
        for e in range(a + 1, z):
            (al, zl), (ar, zr) = trim(a, e), trim(e, z)
            if breaks[e][1] and al < zl and ar < zr and fits(al, zl) and fits(ar, zr):
                best = max(best or (-1,), (breaks[e][0], -round(abs(width(text[al:zl]) - width(text[ar:zr])), 6), e, (al, zl), (ar, zr)))
        return [best[3], best[4]] if best else [(a, z)]

    return fits, trim, split


def longest_pieces(text, line, breaks, width):
    """Every prefix of what is left is tried."""
    fine = {e for e, (rating, safe) in breaks.items() if safe and rating > 0}
    fits, trim, split = lines_of(text, line, breaks, width, fine)
    start, out = 0, []
    while start < len(text):
        first = last = None
        for e in range(start + 1, len(text) + 1):
            if e < len(text) and not breaks[e][1]:
                continue
            first = first or e
            a, z = trim(start, e)
            if (width(text[a:z]) <= 2 * line or not any(a < f < z for f in fine)) and all(fits(*x) for x in split(a, z)):
                last = e
        a, z = trim(start, last or first)
        out.append((a, z))
        start = trim(last or first, len(text))[0]
    return out


NARROW = {"en": "", "zh": "", "ja": " a,.'", "ko": " a,.'"}


def some_captions(rng, n):
    rows = [(1, 0, "en", None, 10, 0, 1), (1, 1, "en", "", 10, 0, 1), (1, 2, "en", "x" * 90, 10, 0, 9), (1, 3, "en", "a" * 30 + " b c", 10, 0, 90_000), (1, 4, "en", "x" * 50 + " " + "ab " * 300 + "y" * 33, 10, 0, 9), (1, 5, "en", "a(" * 120 + "b", 10, 0, 9)]
    for u in range(6, n):
        lang = rng.choice(["en", "ko", "zh", "ja"])
        letters = {"en": "ab'", "ko": "\uac00\ub098a", "zh": "\u4f60\u597d\u300a", "ja": "\u65e5\u672c\u304b"}[lang]
        words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(1, 14))]
        rows.append((1, u, lang, " ".join(words), rng.choice([6, 10]), 0, rng.choice([1, 20_000, 60_000])))
    return rows


def breaks_of(c):
    table = {}
    for r in layout.break_table(c).collect():
        table.setdefault(r.unit_id, {})[r.end] = (r.rating, r.safe)
    return table


def test_pieces_equal_every_break_tried(spark):
    rows = some_captions(random.Random(8), 90)
    c = layout.cue_counts(layout.measure(spark.createDataFrame(rows, CAPTION)))
    n = {r.unit_id: r.n_cues for r in c.collect()}
    table = breaks_of(c)
    got = {r.unit_id: (r.cues, r.short) for r in layout.partition_captions(c).collect()}
    far = {r.unit_id: r.cues for r in layout.capacity_fallback(c).collect()}
    whole = {r.unit_id: r.lines for r in layout.layout_lines(c).collect()}
    for _, u, lang, text, line, _, _ in rows:
        width = lambda t, lang=lang: len(t) - sum(x in NARROW[lang] for x in t) / 2
        breaks = table.get(u, {})
        want = even_pieces(text, n[u], 2 * line, breaks, width) if text else [text]
        assert got[u][0] == want and (not text or got[u][1] == (len(want) < n[u])), (text, n[u])
        assert far[u] == ([text[a:z] for a, z in longest_pieces(text, line, breaks, width)] if text else [text]), text
        fine = {e for e, (rating, safe) in breaks.items() if safe and rating > 0}
        assert whole[u] == ([text[a:z] for a, z in lines_of(text, line, breaks, width, fine)[2](0, len(text))] if text else [text])
    assert sum(len(x) > 2 for x, _ in got.values()) > 10 and sum(far[u] != got[u][0] for u in far) > 10


def test_units_without_a_time(spark):
    nan = float("nan")
    rows = [(1, 0, 0.0, 1000.0), (1, 1, nan, 2000.0), (1, 2, 3000.0, 2000.0), (1, 3, 4000.0, 5000.0), (1, 4, 4000.0, 6000.0), (1, 5, 9000.0, 9500.0)]
    got = layout.plan_timing(spark.createDataFrame([(*r, 1, 2000.0, 8000) for r in rows], "media_id long, unit_id long, start_ms double, end_ms double, n_cues long, readable_ms double, media_end_ms long"))
    got = {r.unit_id: r for r in got.collect()}
    assert (got[0].start_ms, got[0].end_ms) == (0, 2000) and sorted(u for u in got if "invalidSourceTiming" in got[u].issues) == [1, 2, 3, 5]
    assert (got[4].start_ms, got[4].end_ms, got[4].issues) == (4000, 6000, []) and got[3].issues == ["overlappingSourceUnits", "invalidSourceTiming"]


def test_transcripts(spark):
    word = lambda m, p, s, e, i=None, t="a", c=0.5: (m, p, i or str(p), s, e, t, c)
    heads = [(m, "1", "en") for m in range(1, 9)] + [(9, " ", "en"), (10, "2", "en"), (11, "1", "tlh"), (12, "1", "en")]
    words = [w for m in range(1, 12) for w in (word(m, 0, 0.0, 1.0), word(m, 1, 1.0, 2.0))] + [word(2, 2, 1.5, 3.0), word(3, 2, 2.0, 3.0, "1"), word(4, 2, 2.0, 3.0, c=float("nan")), word(8, 2, 2.0, 3.0, t="\u00a0")]
    span = lambda m, p, a, b, i=None: (m, p, i or str(p), 0.0 + p, 1.0 + p, "a", a, b)
    segments = [span(m, 0, 0, 1) for m in range(1, 12)] + [span(5, 1, 1, 9)]
    units = [span(m, 0, 0, 1) for m in range(1, 12)] + [span(6, 1, 1, 2, "0"), span(7, 1, 1, 1)]
    ranged = "media_id long, place long, id string, start double, end double, text string, word_start long, word_end long"
    got = status.validate_transcripts(
        spark.createDataFrame(heads, "media_id long, version string, language string"), spark.createDataFrame(words, "media_id long, place long, id string, start double, end double, text string, confidence double"),
        spark.createDataFrame(segments, ranged), spark.createDataFrame(units, ranged),
    )
    assert {r.media_id: r.fault for r in got.collect()} == {
        2: "invalidWord", 3: "invalidWord", 4: "invalidWord", 5: "invalidSegment", 6: "duplicateSemanticUnitID", 7: "invalidSemanticUnitWordRange", 8: "invalidWord",
        9: "missingVersion", 10: "unsupportedVersion", 11: "unsupportedLanguage", 12: "missingWords",
    }


def test_output_names_equal_the_queue(spark):
    rng = random.Random(7)
    paths = [f"/m/{rng.choice(['a', 'A', 'a.mp4', 'b', 'a.en', 'a-2'])}{rng.choice(['.mp4', '.MP4', '.mov', ''])}" for _ in range(120)]
    taken, want = set(), []
    for p in paths:
        m = re.fullmatch(r"(.*/)([^/]*?)(?:\.([^./]+))?", p)
        stem, ext = m[1] + m[2], (m[3] or "").lower()
        names = [f"{stem}.en.srt"] + [f"{stem}.{ext}.en.srt"] * bool(ext) + [f"{stem}.en-{k}.srt" for k in range(2, 200)]
        want.append(next(n for n in names if n.lower() not in taken))
        taken.add(want[-1].lower())
    jobs = spark.createDataFrame([(i, p, "en") for i, p in enumerate(paths)], "job_id long, path string, lang string")
    assert [r.output for r in status.assign_output_names(jobs).orderBy("job_id").collect()] == want


def test_broken_subtitle_files(spark):
    t = "00:00:00,000 --> 00:00:01,000"
    late = lambda a, b: f"1\n{t}\na\n\n2\n{a} --> {b}\nb".encode()
    cases = {
        "emptyFile": [None, b""], "noCues": [b"\r\n\n \t\xc2\xa0", b"\n"], "invalidUTF8": [f"1\n{t}\na".encode() + b"\xff", b"\xc3"], "cueMissingText": [f"1\n{t}\n\xa0".encode(), f"1\n{t}".encode()],
        "invalidNumbering": [f"x\n{t}\na".encode(), f"2\n{t}\na".encode(), f"99999999999999999999\n{t}\na".encode()],
        "invalidTimestamps": [b"1\nbad\na", f"1\n{t} --> {t[:12]}\na".encode(), b"1\n00:00:02,000 --> 00:00:01,000\na", late("00:00:00,999", "00:00:02,000"), late("00:00:01,000", "00:00:01,00"), late("00:60:01,000", "00:61:01,000"), late("99999999999999:00:00,000", "99999999999999:00:01,000")],
        None: [f"\ufeff1\n{t}\na".encode()[3:], f" 1 \r\n {t.replace(' ', '  ')}\t\r\na\r\n\r\n\r\n\r\n+2\r\n0:0:1,000 --> 100:00:00,000\r\nb".encode(), late("00:00:01,000", "00:00:02,000")],
    }
    rows = [(i, fault, d) for i, (fault, d) in enumerate((f, d) for f, ds in cases.items() for d in ds)]
    got = {r.media_id: r.fault for r in timeline.first_fault(spark.createDataFrame([(i, d) for i, _, d in rows], "media_id long, document binary")).collect()}
    assert got == {i: f for i, f, _ in rows if f}
    big = spark.range(1).select(F.col("id").alias("media_id"), F.repeat(F.lit("x"), (50 << 20) + 1).alias("document"))
    assert [r.fault for r in timeline.first_fault(big).collect()] == ["unexpectedlyLarge"]


def test_languages_of_a_media_stay_apart(spark):
    t = "00:00:00,000 --> 00:00:01,000"
    cues = spark.createDataFrame([(1, "de", 1, 1, t, "a"), (1, "en", 1, 1, t, "b"), (1, "en", 2, 2, "00:00:00,500 --> 00:00:01,000", "c")], "media_id long, lang string, ordinal long, cue_index long, timing string, text string")
    documents = timeline.srt_documents(cues)
    assert {r.lang: r.document for r in documents.collect()} == {"de": f"1\n{t}\na\n", "en": f"1\n{t}\nb\n\n2\n00:00:00,500 --> 00:00:01,000\nc\n"}
    assert {(r.lang, r.text) for r in timeline.parse_srt(documents).collect()} == {("de", "a"), ("en", "b"), ("en", "c")}
    assert [(r.lang, r.ordinal, r.issue) for r in quality.check_cues(cues).collect()] == [("en", 2, "overlappingCues")]
    assert [(r.lang, r.fault) for r in timeline.first_fault(documents).collect()] == [("en", "invalidTimestamps")]


ASSESSED = "media_id long, lang string, ordinal long, cue_index long, timing string, text string, unit_id string, media_end_ms double, chars_per_line int, chars_per_s double, least_s double"


def test_assessment(spark):
    cue = lambda m, timing, text, lang="en", end=None, line=42, speed=20.0, index=1: (m, lang, 1, index, timing, text, "u", end, line, speed, 0.833)
    rows = [
        cue(1, "00:00:00,000 --> 00:00:00,500", "a" * 43 + "\nsecond\nthird"), cue(2, "00:00:04,000 --> 00:00:05,001", "End", end=5000.0), cue(3, "bad", "x\n" * 9, index=2), cue(4, "00:00:00,000 --> 00:00:05,000", "\u00a0\n "),
        cue(5, "00:00:00,000 --> 00:00:08,000", "a b" * 20 + "\n \n", end=float("nan")), cue(6, "00:00:10,001 --> 00:00:11,706", "a" * 29, "fr", speed=17.0), cue(7, "00:00:10,001 --> 00:00:11,705", "a" * 29, "fr", speed=17.0),
        cue(8, "00:00:00,000 --> 00:00:07,000", "\uac00" * 16 + ".", "ko", line=16, speed=12.0), cue(9, "00:00:00,000 --> 00:00:07,000", "\u30a2" * 14, "ja", line=13, speed=4.0), cue(10, "00:00:00,000 --> 00:00:07,000", "x" * 99, "tlh", line=None, speed=None), cue(11, "00:00:00,000 --> 00:00:01,000", None),
    ]
    got = {}
    for r in quality.assess_cues(spark.createDataFrame(rows, ASSESSED)).collect():
        assert r.unit_id == "u"
        got.setdefault(r.media_id, []).append((r.severity, r.code, r.actual, r.limit))
    assert got[1] == [("error", "tooManyLines", 3, 2), ("warning", "lineTooLong", 43, 42), ("warning", "cueTooShort", 0.5, 0.833), ("warning", "readingSpeedExceeded", 108, 20)]
    assert got[2] == [("error", "cuePastMediaEnd", 5.001, 5)] and got[3] == [("error", "invalidCueNumbering", None, None), ("error", "invalidCueTiming", None, None)] and got[4] == [("error", "emptyCueText", None, None)]
    assert got[5] == [("error", "tooManyLines", 3, 2), ("error", "lineTooLong", 60, 42), ("error", "emptyLine", None, None), ("error", "emptyLine", None, None), ("warning", "cueTooLong", 8, 7)]
    assert 6 not in got and [x[1] for x in got[7]] == ["readingSpeedExceeded"] and got[8] == [("warning", "lineTooLong", 16.5, 16)] and [x[:2] for x in got[9]] == [("warning", "lineTooLong")] and 10 not in got
    assert got[11] == [("error", "emptyCueText", None, None)]
    assert {(r.media_id, r.n_errors, r.n_warnings) for r in quality.summary(quality.assess_cues(spark.createDataFrame(rows, ASSESSED))).collect()} >= {(1, 1, 3), (7, 0, 1)}


def test_a_language_without_limits_keeps_its_rows(spark):
    assert [tuple(r) for r in results.with_profile(spark.createDataFrame([("tlh", 1), (None, 2), ("ja", 3)], "lang string, n int")).orderBy("n").collect()] == [("tlh", 1, None, None, None), (None, 2, None, None, None), ("ja", 3, 13, 4.0, 0.5)]


def test_redaction(spark):
    cases = {
        "open [/Users/a/x.wav] and see,/home/u/x": "open [<private-path>] and see,<private-path>", "file:/a a/b https://c/d 1/2": "file:/a a/b https:/<private-path> 1/2", '"/a b" \'/c d\' "/e\nf"': '"<private-path>" \'<private-path>\' "<private-path>\nf"',
        "-/x </y> (/z) =/w": "-<private-path> <<private-path>> (<private-path>) =<private-path>", "Secret Name in clip.mov, ab\r\nx": "<private-path> in <private-path>, ab\n\nx", "": "", None: None,
    }
    private = F.array(F.lit("Secret Name"), F.lit("/v/clip.mov"), F.lit("Secret"), F.lit("ab"), F.lit(""), F.lit(None))
    got = values(spark, [(t,) for t in cases], "t string", T.redact_paths(F.col("t"), private))
    assert [r[0] for r in got] == list(cases.values())
    assert values(spark, [("EVT\tx\na\nEVT\ty",)], "t string", T.without_events(F.col("t"), "EVT\t")) == [("a",)]


def test_ranges_and_times_that_are_corrupt(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, 0.0, 1.0, "a"), (1, 1, 1.0, nan, "a"), (1, 2, nan, 9.0, "a"), (1, 3, 9.0, inf, "a"), (2, 0, -1.0, 1.0, "a"), (2, 1, 0.5, 2.0, "a"), (2, 2, 2.0, 3.0, " \u00a0"), (2, 3, 3.0, 4.0, None), (3, 0, None, 1.0, "a"), (3, 1, 1.0, 2.0, "a")]
    got = results.not_clean(spark.createDataFrame(rows, "media_id long, seg_idx long, start_ms double, end_ms double, text string")).collect()
    assert {(r.media_id, r.seg_idx) for r in got} == {(1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0)}
    units = [(1, 0, 1, 3), (1, 1, -9_223_372_036_854_775_807, 9_223_372_036_854_775_807), (1, 2, 3, 3), (1, 3, 5, 2), (1, 4, None, 2), (1, 5, 2, -9_223_372_036_854_775_808), (2, 0, 0, 9)]
    words = spark.createDataFrame([(1, i, "w") for i in range(4)], "media_id long, word_idx long, text string")
    found = results.words_in_units(spark.createDataFrame(units, "media_id long, unit_id long, word_start long, word_end long"), words).collect()
    assert sorted((r.unit_id, r.word_idx) for r in found) == [(0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3)]


def test_pairs_by_place(spark):
    units = spark.createDataFrame([(m, i) for m, n in ((1, 2), (2, 3), (3, 1), (4, 1)) for i in range(n)], "media_id long, unit_id long")
    texts = spark.createDataFrame([(m, i, 0, f"t{i}") for m, n in ((1, 2), (2, 1), (3, 3), (5, 1)) for i in range(n)], "media_id long, unit_id long, ord long, text string")
    got = {(r.media_id, r.unit_id, r.translated, r.issue) for r in results.match_by_position(units, texts).collect()}
    bad, miss = "translationCountMismatch", "missingTranslation"
    assert got == {(1, 0, "t0", None), (1, 1, "t1", None), (2, 0, "t0", None), (2, 1, None, miss), (2, 2, None, miss), (2, None, None, bad), (3, 0, "t0", None), (3, None, None, bad), (4, 0, None, miss), (4, None, None, bad), (5, None, None, bad)}


def test_a_file_can_have_two_problems(spark):
    key = "AK" + "IA" + "A" * 16
    got = policy.scan_files(spark.createDataFrame([("a/.npmrc", key), ("b", key), ("c", "x")], "path string, text string")).collect()
    assert sorted(tuple(r) for r in got) == [("a/.npmrc", "cloudKey"), ("a/.npmrc", "forbiddenName"), ("b", "cloudKey")]


def test_report_of_kept_segments(spark):
    word = "array<struct<text:string,start_ms:double,end_ms:double,probability:double>>"
    w = lambda *parts: [(t, float(a), float(b), 0.5) for t, a, b in parts]
    rows = [
        (1, "ab cd", 0, 10, -0.5, w((" ab", 0, 4), (" cd", 4, 10))), (1, "ab cd", 0, 10, -2.0, w(("ab", 0, 4), (" cd", 3, 10))), (1, "ab", 0, 10, float("nan"), None),
        (1, "ab", 0, 10, None, []), (1, "ab", 0, 10, float("-inf"), w(("ab", 0, 11))), (1, "ab", 0, 10, -1.0, w(("ab", None or 5, 5))), (2, "x", 0, 9, -0.1, w(("x", 0, 9))),
        (3, None, 0, 9, -0.1, w(("x", 0, 9))), (4, "x", 0, 9, -1.5, w(("x", 0, 9))),
    ]
    schema = f"media_id long, text string, start_ms double, end_ms double, avg_logprob double, words {word}"
    made = [(m, t, float(s), float(e), p, ws) for m, t, s, e, p, ws in rows]
    got = {r.media_id: tuple(r)[1:] for r in results.timeline_report(spark.createDataFrame(made, schema)).collect()}
    assert got == {1: (6, 1, 5, True), 2: (1, 0, 0, False), 3: (1, 0, 1, True), 4: (1, 1, 0, True)}
    assert results.timeline_report(spark.createDataFrame([], schema)).count() == 0


def test_evidence_keeps_first_words(spark):
    rows = [(1, 0, "r", "x", ["w"] * 65), (1, 1, "r", None, None), (1, 2, "r", "x", [])]
    got = results.discard_evidence(spark.createDataFrame(rows, "media_id long, seg_idx long, reason string, text string, words array<string>")).collect()
    assert {r.seg_idx: r.words for r in got} == {0: ["w"] * 64, 1: None, 2: []}


def test_bill_of_materials(spark):
    lock = spark.createDataFrame([("A_b", "1", ["h", "i"]), ("c", "2", None), ("d", "1", ["h"])], "name string, version string, hashes array<string>")
    listed = spark.createDataFrame([("a-B", "MIT"), ("d", None)], "name string, license string")
    ref = lambda n, v: f"pkg:pypi/{n}@{v}"
    rows = [
        (1, "a.b", "1", ref("a-b", 1), ref("a-b", 1), ["i", "i", None], ["MIT"]), (2, "A-B", "1", None, None, None, None), (3, None, "1", None, None, None, None), (4, "", None, None, None, None, None),
        (5, "C", "2", ref("c", 2), None, ["h"], []), (6, "d", None, ref("d", ""), ref("d", ""), ["h"], [""]), (7, "new", "1", None, None, None, None),
    ]
    schema = "place long, name string, version string, purl string, ref string, hashes array<string>, licenses array<string>"
    got = sorted((r.place, r.issue) for r in policy.bill_issues(lock, listed, spark.createDataFrame(rows, schema)).collect())
    assert got == [
        (2, "duplicateComponent"), (3, "duplicateComponent"), (4, "duplicateComponent"), (5, "hashNotLocked"), (5, "licenseMismatch"), (5, "referenceMismatch"),
        (6, "hashNotLocked"), (6, "versionMismatch"), (7, "notLocked"),
    ]
    assert policy.bill_issues(lock, listed, spark.createDataFrame([], schema)).count() == 0


def test_progress_updates(spark):
    e = lambda text: timelines.EVENT + text
    rows = [
        (e('{"event_id": 1, "job_id": 1, "stage": "speech", "fraction": 2, "eta": 4}'), 7.5), (e('{"event_id": 2, "stage": "speech", "fraction": -1, "elapsed": 3}'), 7.5),
        (e('{"event_id": 3, "stage": "speech"}'), 1.0), (e('{"event_id": 4, "stage": "?", "fraction": 1}'), 1.0), (e("{"), 1.0), ("x", 1.0), (None, 1.0),
    ]
    lines = spark.createDataFrame(rows, "value string, since double")
    got = {r.event_id: (r.progress, r.elapsed, r.eta) for r in timelines.progress_updates(lines).collect()}
    assert got == {1: (pytest.approx(0.78), 7.5, 4.0), 2: (pytest.approx(0.15), 3.0, None)}
    assert timelines.progress_updates(lines.drop("since")).where("event_id = 1").first().elapsed is None
