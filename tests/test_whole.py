"""Branches that the given tables lack, in small tables."""

import random

import duckdb
from pyspark.sql import functions as F

from captionlake.operators import grouping, jobs, policy, timeline
from captionlake.plans import catalogue

def test_cues_keep_text_number_and_timing(spark):
    text = "".join(chr(97 + k % 26) for k in range(333)) + "\U0001f600"
    rows_ = [(m, i, text if i else "", 1000 * i, 1000 * i + 900) for m in range(3) for i in range(75)]
    got = timeline.cues(spark.createDataFrame(rows_, "media_id long, seg_idx long, text string, start_ms long, end_ms long")).collect()
    assert len(got) == 225
    for c in got:
        assert c.text.replace("\n", "") == (text if c.ordinal > 1 else "") and all(len(x) <= 40 for x in c.text.split("\n"))
        assert c.cue_index == c.ordinal and c.timing != "bad"


def test_units_over_the_limit_stand_alone(spark):
    units = [(1, "en", i, "x" * n, 3000 * i, 3000 * i + 2500, "s") for i, n in enumerate((100, 601, 700, 100, 499, 1))]
    got = grouping.group_units(spark.createDataFrame(units, "media_id long, lang string, unit_id long, text string, start_ms long, end_ms long, speaker string"))
    assert [r.group_id for r in got.orderBy("unit_id").collect()] == [0, 1, 2, 3, 3, 4]


def test_a_line_over_64_kib_fails_its_source(spark):
    texts = {1: "a\r\n" + "x" * 65_536 + "\n", 2: "a\n" + "x" * 65_537 + "\nb", 3: "\u00e9" * 32_769}
    chunks = [(m, p, t[p * 500 : p * 500 + 500]) for m, t in texts.items() for p in range(-(-len(t) // 500))]
    got = policy.framed(spark.createDataFrame(chunks, "media_id long, p int, chunk string")).orderBy("media_id", "p").collect()
    assert [(r.media_id, r.failed, r.p, r.line) for r in got] == [(1, False, 0, "a"), (1, False, 1, "x" * 65_536), (2, True, 0, None), (3, True, 0, None)]


def test_updates_closer_than_the_limit_are_held_back(spark):
    updates = [(1, 0, i, f) for i, f in enumerate((0.0, 0.001, 0.0025, 0.004, 0.0055, 0.006))]
    got = grouping.throttled(spark.createDataFrame(updates, "job_id long, run_id long, event_id long, fraction double"))
    assert sorted(r.event_id for r in got.collect()) == [0, 2, 4, 5]


def test_bad_blocks_are_reported(spark):
    t = "00:00:0{},000 --> 00:00:0{},000"
    block = lambda n, at, text: f"{n}\n{t.format(at, at + 1)}\n{text}"
    docs = {
        1: [block(1, 0, " a "), block(2, 1, "b ")], 2: [block(1, 0, "a"), block(2, 1, "")], 3: [block(1, 0, "a"), block(7, 1, " \t")],
        4: [block(1, 0, "a\n\nb"), block(2, 1, "c")], 5: [block(1, 0, "a"), block(3, 1, "c")], 6: [block(1, 0, "a\n\nb\nc\nd"), block(2, 1, "c")],
    }
    rows_ = [(m, "\n\n".join(b) + "\n") for m, b in docs.items()]
    got = timeline.first_fault(spark.createDataFrame(rows_, "media_id long, document string")).collect()
    assert sorted(tuple(r) for r in got) == [(2, 2, "cueMissingText"), (3, 2, "cueMissingText"), (4, 2, "cueMissingText"), (5, 2, "invalidNumbering"), (6, 2, "invalidNumbering")]


def test_cues_come_back_as_they_were_written(spark, tmp_path):
    """Lines without text, with blanks at their edges or in a whole piece of 40, and with other line ends; against the SQL."""
    odd = ["", " ", "a ", " a", "\t", "a\u00a0", "x" * 40 + " ", "x" * 40 + " " * 45, " " * 80, "a\r", "\r", "a\r\rb", "x" * 40 + "\r", "b\x0b", "\x85", "\u2028", "7", "c\u3000", "e\u0301", "\U0001f600" * 41]
    r = random.Random(2)
    texts = ["", " ", "\n", None, "\n\n \n", *odd, *("\n".join(r.choice(odd) for _ in range(r.randrange(1, 30))) for _ in range(200))]
    langs = ("en", "de", "es", "fr", None, "xx")
    docs = [(i, t, langs[i % 6]) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES["S3_read_srt"](spark, str(tmp_path)).select("media_id", "lang", "cue_index", "timing", "n_chars").collect()
    want = duck.sql(f"SELECT media_id, lang, cue_index, timing, n_chars FROM ({catalogue.ORACLE_SQL['S3_read_srt']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 4000


def test_blanks_of_a_text_are_read_and_counted_as_no_line(spark):
    t = "00:00:00,000 --> 00:00:01,000"
    document = f"\r\n \r\n 1 \r\n{t}\t\r\n a \r\n\r\n\r\n2\r{t} \r \r\r3\n{t}\nb\n \n\n\n"
    got = timeline.parse_srt(spark.createDataFrame([(1, document)], "media_id long, document string")).orderBy("ordinal").collect()
    assert [(r.cue_index, r.timing, r.text, r.n_lines) for r in got] == [(1, f"{t}\t", " a ", 3), (2, f"{t} ", " ", 2), (3, t, "b\n ", 3)]


def test_every_page_is_checked_for_its_destination(spark, tmp_path):
    spark.range(120).withColumnRenamed("id", "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    assert catalogue.QUERIES["U2_duplicate_destinations"](spark, str(tmp_path)).count() == 120


def test_detections_without_values_never_match(spark):
    found = [("en", 90, 10), ("fr", 90, 10), ("en", 79, 10), (None, 90, 10), ("en", None, 10), ("en", 90, None), (None, None, None)]
    got = jobs.check_language(spark.createDataFrame([(i, "en", *f) for i, f in enumerate(found)], "i int, lang string, code string, confidence int, runner_up int"))
    assert [r.decision for r in got.orderBy("i").collect()] == ["matched", "mismatch", "lowConfidence", "failed", "failed", "lowConfidence", "failed"]


def test_repeated_units_and_blank_translations(spark):
    units = spark.createDataFrame([(1, 0), (1, 0), (1, 0), (1, 1), (1, 2), (1, None)], "media_id long, unit_id long")
    told = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "\t\r\n\u00a0 "), (1, 2, 0, "a\n")], "media_id long, unit_id long, ord long, text string")
    got = timeline.match_translations(units, told).collect()
    assert sorted((str(r.unit_id), r.issue) for r in got) == [("0", "duplicateUnitIdentifier"), ("1", "emptyTranslation"), ("None", "duplicateUnitIdentifier"), ("None", "missingTranslation")]


def test_private_names_are_found(spark):
    files = [("a/PROJECT_MEMORY.md", "x"), ("b_PRIVATE_CHATS/c", "see /home/u"), ("d_PROJECT_AUDIT", "in /Users/u")]
    got = policy.scan_private_folders(spark.createDataFrame(files, "path string, text string")).collect()
    assert sorted(tuple(r) for r in got) == [("a/PROJECT_MEMORY.md", "PROJECT_MEMORY"), ("b_PRIVATE_CHATS/c", "/home/"), ("d_PROJECT_AUDIT", "/Users/"), ("d_PROJECT_AUDIT", "_PROJECT_AUDIT")]
