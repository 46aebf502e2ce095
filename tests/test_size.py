"""What a query costs must not grow with how often an expression stands in it: each step of a text is taken once."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from captionlake.functions import texts as T
from captionlake.functions.scalars import cue_times
from captionlake.operators import layout, speech
from captionlake.sources import timelines


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_timing_is_parsed_once(spark):
    times = cue_times(F.col("t"))
    df = spark.createDataFrame([("00:00:01,000 --> \t00:00:02,500 ",), ("00:00:01,000",), (None,)], "t string").select(times["start"].alias("s"), times["end"].alias("e"))
    assert [tuple(r) for r in df.collect()] == [(1000, 2500), (None, None), (None, None)]
    assert plan(df).count("split(") <= 6  # 80 when each number parsed the text anew


def test_widths_of_plain_texts_are_those_of_their_graphemes(spark):
    r, letters = random.Random(3), ["a", "7", " ", "\n", "é", "か", "ｶ", "ﾞ", "가", "ᅡ", "漢", "。", "’", "́", "‍", "\r"]
    rows = [("".join(r.choice(letters[: r.choice((5, 13, 16))]) for _ in range(r.randrange(12))), lang) for lang in ("ja", "ko", "en") for _ in range(150)]
    clusters = F.filter(F.regexp_extract_all("t", F.lit(r"(?s)\X"), F.lit(0)), lambda c: ~c.isin("\n", "\r"))
    half = F.when(F.col("l") == "ja", F.filter(clusters, lambda c: c.rlike(T.HALF_JA))).when(F.col("l") == "ko", F.filter(clusters, lambda c: c.rlike(T.HALF_KO))).otherwise(F.array().cast("array<string>"))
    df = spark.createDataFrame(rows, "t string, l string")
    assert df.where(T.char_units(F.col("t"), F.col("l")) != F.size(clusters) - F.size(half) / 2).count() == 0
    assert "RLIKE" in plan(df.select(T.char_units(F.col("t"), F.col("l"))))  # most texts never come to the graphemes


def test_strip_takes_the_edges_alone(spark):
    rows = [("  a b \n",), ("　\n ",), ("",), (None,), ("a\n\nb",), (" \x85a ",)]
    df = spark.createDataFrame(rows, "t string").select(T.strip(F.col("t")), T.is_blank(F.col("t")))
    assert [tuple(r) for r in df.collect()] == [("a b", False), ("", True), ("", True), (None, None), ("a\n\nb", False), ("a", False)]


def test_even_pieces_are_taken_by_batch_and_only_from_reachable_places(spark):
    rows = [(1, "en", "one two three four five six, seven eight nine ten. " * 5, 4), (2, "en", "", 1), (3, "en", None, 2), (4, "xx", "a b", 2), (5, "en", "a b c d", None), (6, "en", "a b c d", 4), (7, "en", "x" * 300, 3)]
    captions = spark.createDataFrame(rows, "media_id long, lang string, text string, n_cues long").selectExpr("*", "media_id AS unit_id", "if(lang = 'en', 42, null) AS chars_per_line")
    found = layout.partition_captions(layout.measure(captions.withColumn("text", F.rtrim("text"))))
    got = {r.media_id: r.cues for r in found.collect()}
    assert len(got[1]) == 4 and " ".join(got[1]) == ("one two three four five six, seven eight nine ten. " * 5).strip()
    assert (got[2], got[3], got[4], got[5], got[6], got[7]) == ([""], [None], ["a b"], ["a b c d"], ["a", "b", "c", "d"], ["x" * 300])
    assert "aggregate(" not in plan(found)  # one fold step a piece, over all places of the text, before
    m = layout.measure(captions.where("media_id = 1")).selectExpr("m.most AS first", "m.places.most AS most", "m.places.till AS till").first()
    assert m.till[m.first - 1] <= 84 < m.till[m.first] and max(m.most) <= len(m.most)


def test_only_texts_with_odd_characters_are_searched_for_damage(spark):
    r = random.Random(5)
    kinds = ["a", " ", "é", "\n", "漢", "\u2019", "ｱ", "\x0b", "\x85", "\x00", "\xad", "\u200b", "\ufeff", "\ufffd", "\ufdd0", "\uffff", "\U0001ffff", "\U000e0001", "\t", "\u200d", "\u0600"]
    texts = [None, "", " ", "\u3000\n", "\x0b a", "a \x0b", *kinds, *("".join(r.choice(kinds[: r.choice((7, 21))]) for _ in range(r.randrange(5))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = T.strip(F.col("t"))
    bad = F.regexp_extract(t, rf"[\x{{FFFD}}{T.NONCHARACTERS}[\p{{Cc}}\p{{Cf}}&&[^{T.SHAPING}]]]", 0)
    want = F.when(t.isNull() | (t == ""), "empty").when(bad == "", F.lit(None)).when(bad == "\ufffd", "replacementCharacter").when(bad.rlike(rf"[{T.NONCHARACTERS}]"), "invalidUnicodeScalar").otherwise("disallowedControlCharacter")
    assert df.where(~T.damage(F.col("t")).eqNullSafe(want)).count() == 0
    # every text was matched against a class of some forty ranges
    assert plan(df.select(T.damage(F.col("t")))).count(r"\x{600}-\x{10FFFF}") > 0


def test_a_document_is_parsed_once_for_all_its_lists(spark):
    item = '{"id": "7", "start": "1.5", "end": 2, "text": "a"}'
    docs = [f'{{"words": [{item}, {item}], "segments": [], "semantic_units": [{item}]}}', '{"words": 3, "segments": [], "semantic_units": []}', "{", "", None, f'{{"words": [], "segments": [{item}], "semanticUnits": []}}']
    df = spark.createDataFrame(list(enumerate(docs)), "media_id long, document string").repartition(2)
    every = timelines.read_all_timelines(df)
    singles = [timelines.read_timelines(df, kind).withColumn("kind", F.lit(kind)) for kind in timelines.LISTS]
    want = singles[0].unionByName(singles[1]).unionByName(singles[2]).select(every.columns)
    assert sorted(map(str, every.collect())) == sorted(map(str, want.collect())) and every.count() == 4
    assert plan(every).count("from_json(") == 1  # a parse for each list and one for the code, before


def test_loops_are_found_where_the_text_stands(spark):
    rows = [(1, 0, "so " * 9 + "it ends", -2.0), (1, 1, "so " * 9, -0.5), (1, 2, None, -2.0), (1, 3, "a b c d e f g h i", -2.0), (1, 4, "one two " * 5 + "three", -2.0), (1, 5, "さあ" * 6, -2.0), (1, 6, "- " * 9, -2.0), (1, 7, "", None)]
    found = speech.trim_decoder_loops(spark.createDataFrame(rows, "media_id long, seg_idx long, text string, avg_logprob double").coalesce(1))
    got = {r.seg_idx: (r.text, r.trimmed) for r in found.collect()}
    assert got == {0: ("it ends", True), 1: (("so " * 9).strip(), False), 2: (None, False), 3: ("a b c d e f g h i", False), 4: ("three", True), 5: ("", True), 6: (("- " * 9).strip(), False), 7: ("", False)}
    assert not [w for w in ("Window", "Join", "Sort", "Generate") if w in plan(found)]  # a row a unit and length, sorted, before


def test_keys_go_through_a_text_whole(spark):
    nfc = lambda t: unicodedata.normalize("NFC", t)
    steady = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", T.STEADY) + "]")
    every = [c for c in map(chr, range(0x110000)) if steady.match(c)]
    pairs = {nfc(c): chr(int(p[1], 16)) for c in map(chr, range(0x110000)) if len(p := unicodedata.decomposition(c).split()) == 2 and p[0][0] != "<"}
    assert not [c for c in every if unicodedata.combining(c) or nfc(c) != c] and not set(every) & {b for c, b in pairs.items() if len(c) == 1}

    def key(t, fold):
        words = re.split(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", re.sub(f"[{T.APOSTROPHES}]", "'", cased(t, fold)))
        kept = ["".join(c for c in w if c == "'" or unicodedata.category(c)[0] in "LMN") for w in words]
        return " ".join(w for w in kept if any(unicodedata.category(c)[0] in "LN" for c in w))

    cased = lambda t, fold: nfc(nfc(t).casefold() if fold else nfc(t).lower())
    r = random.Random(7)
    odd = [" ", "  ", "\n", "\x85", "\u3000", "a", "I", "'", "\u2019", "\u02bc", "-", ".", "4", "\xdf", "\xb5", "\u0149", "\u017f", "\u0130", "\xcd", "\x1f", "\x7f", "\u201a", "\u0416", "\u65e5", "\U0001f600", "\u0301", "\u3099", "\u304b", "\u03a3", "\u01f0", "\ufb01", "\u0928", "\u093f"]
    texts = ["", " ' \n '", *("".join(r.choice(odd[: r.choice((6, 25, 33))]) for _ in range(r.randrange(12))) for _ in range(600))]
    known = [c for c in every if unicodedata.category(c) != "Cn" and not "\u9ffd" <= c <= "\u9fff"]  # Java 17 doesn't know these three
    texts += ["".join(known[i : i + 500]) for i in range(0, len(known), 500)]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.compare_key(t).alias("compared"), T.duplicate_key(t).alias("lowered"), T.case_folded(t).alias("folded"))
    locales = spark._jvm.java.util.Locale
    own = locales.getDefault()
    for tag in (own.toLanguageTag(), "tr-TR", "lt-LT"):  # where a plain lower() has rules of its own
        locales.setDefault(locales.forLanguageTag(tag))
        try:
            got = df.collect()
        finally:
            locales.setDefault(own)
        assert not [x for x in got if (x.compared, x.lowered, x.folded) != (key(x.t, True), key(x.t, False), cased(x.t, True))]
    assert "split(" not in plan(df) and "lambda" not in plan(df)  # each word was matched by itself, before
    assert not df.where(T._loose(F.translate(t, "".join(odd[25:]), ""))).count()  # only odd texts come to Python


def test_captions_are_composed_and_close_whatever_is_searched(spark):
    r = random.Random(9)
    odd = ["a", " ", "b", "'", "’", "e", "  ", "\n", "\t", "\xa0", "　", "\x85", " ", ".", "́", "か", "゙", "カ", "日", "가", "ᄀ", "ᅡ", "न", "़", "4", " ", "​"]
    texts = [None, "", " ", "\n 　", *("".join(r.choice(odd[: r.choice((6, 14, 27))]) for _ in range(r.randrange(14))) for _ in range(800))]

    def rule(t):
        plain = re.sub(r"[\t-\r \x85\xa0  -     　]+", " ", unicodedata.normalize("NFC", t)).strip(" ")
        for mark in "'\u2019":
            plain = re.sub(rf"(?<=[^\W\d_]) ?{mark} ?(?=[^\W\d_])", mark, plain)
        return plain

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.caption(F.col("t")).alias("c"))
    assert not [x for x in df.collect() if x.c != (None if x.t is None else rule(x.t))]
    steady = F.col("t").isNotNull() & ~T._loose(F.col("t"))
    assert df.where(steady & F.col("t").rlike(r"[\x{300}-\x{10FFFF}]")).count() > 9  # all of these came to Python, before
