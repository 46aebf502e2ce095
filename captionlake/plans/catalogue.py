"""Every query over the subtitle operators, with the same question in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import cleaning, jobs, quality, results, timeline
from ..sources import fixtures as fx

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


JUDGED = "WITH " + fx.SQL_SEGMENTS + """, judged AS (SELECT media_id, seg_idx, text, greatest(start_ms, 0) AS start_ms, greatest(end_ms, 0) AS end_ms,
  CASE WHEN greatest(end_ms, 0) <= greatest(start_ms, 0) THEN 'invalid_timestamp' WHEN no_speech_prob > 0.6::DOUBLE AND avg_logprob < -1.0::DOUBLE THEN 'no_speech'
       WHEN compression_ratio > 2.4::DOUBLE AND avg_logprob < -1.0::DOUBLE THEN 'low_confidence_repetition' END AS reason FROM segments) """


@query(JUDGED + "SELECT media_id, seg_idx, reason FROM judged WHERE reason IS NOT NULL")
def F1_F2_reject_segments(spark, d):
    return cleaning.judge_segments(fx.segments(spark, d)).where("reason is not null").select("media_id", "seg_idx", "reason")


@query(JUDGED + """, b AS (SELECT *, greatest(start_ms, coalesce(max(end_ms) OVER (PARTITION BY media_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s
  FROM judged WHERE reason IS NULL) SELECT media_id, seg_idx, text, s AS start_ms, end_ms, s > start_ms AS start_adjusted, CASE WHEN end_ms <= s THEN 'fully_overlapped' END AS reason FROM b""")
def W1_clamp_overlaps(spark, d):
    return cleaning.clamp_overlaps(cleaning.judge_segments(fx.segments(spark, d)).where("reason is null").drop("reason"))


@query(JUDGED + """SELECT media_id, count(*) AS n_input, count(reason) AS n_removed, count(*) FILTER (reason = 'invalid_timestamp') AS n_invalid,
  count(*) FILTER (reason = 'no_speech') AS n_no_speech, count(*) FILTER (reason = 'low_confidence_repetition') AS n_repetition,
  count(reason) >= greatest(5, (count(*) * 5 + 99) // 100) AS quality_warning FROM judged GROUP BY media_id""")
def A1_sanitize_report(spark, d):
    return cleaning.report(cleaning.judge_segments(fx.segments(spark, d)))


@query("WITH " + fx.SQL_SEGMENTS + """, n AS (SELECT media_id, seg_idx, len(list_filter(string_split(text, ' '), lambda w: w <> ''))::BIGINT AS n FROM segments)
SELECT media_id, seg_idx, (sum(n) OVER w - n)::BIGINT AS word_start, (sum(n) OVER w)::BIGINT AS word_end FROM n WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING)""")
def W4_number_words(spark, d):
    n = F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long")
    return cleaning.number_words(fx.segments(spark, d).select("media_id", "seg_idx", n.alias("n")))


@query("WITH " + fx.SQL_WORDS + r""", m AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w >= 800 OR regexp_matches(lag(text) OVER w, '[.!?。！？।॥]["''”’»)\]}]*\s*$') THEN 1 ELSE 0 END AS new
  FROM words WINDOW w AS (PARTITION BY media_id ORDER BY word_idx)), g AS (SELECT *, (sum(new) OVER (PARTITION BY media_id ORDER BY word_idx))::BIGINT AS island FROM m)
SELECT media_id, island, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY word_idx) AS text FROM g GROUP BY media_id, island""")
def W5_hard_breaks(spark, d):
    return timeline.hard_breaks(fx.words(spark, d))


@query("WITH " + fx.SQL_UNITS + " SELECT media_id, unit_id, text, lag(text) OVER w AS preceding, lead(text) OVER w AS following FROM units WINDOW w AS (PARTITION BY media_id ORDER BY unit_id)")
def W7_with_context(spark, d):
    return timeline.with_context(fx.units(spark, d))


@query("WITH " + fx.SQL_UNITS + """, o AS (SELECT media_id, unit_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms % 9000, unit_id) - 1 AS place FROM units)
SELECT media_id, unit_id, place, place <> unit_id AS moved FROM o""")
def W8_order_units(spark, d):
    return timeline.order_units(fx.units(spark, d).withColumn("start_ms", F.col("start_ms") % 9000))


@query("WITH " + fx.SQL_UNITS + """, u AS (SELECT media_id, unit_id, start_ms - 3000 AS s, max(end_ms) OVER (PARTITION BY media_id) AS m FROM units)
SELECT media_id, unit_id, least(coalesce(min(CASE WHEN s >= 0 THEN s END) OVER (PARTITION BY media_id ORDER BY unit_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), m), m) AS next_start_ms FROM u""")
def W9_next_valid_start(spark, d):
    from pyspark.sql import Window

    u = fx.units(spark, d)
    last = F.max("end_ms").over(Window.partitionBy("media_id"))
    return timeline.next_valid_start(u.select("media_id", "unit_id", (F.col("start_ms") - 3000).alias("start_ms"), last.alias("media_end_ms")))


@query("WITH " + fx.SQL_TRANSLATIONS + """, l AS (SELECT media_id, unit_id, arg_max(text, ord) AS t, count(*) AS n FROM tr GROUP BY ALL),
b AS (SELECT coalesce(u.media_id, l.media_id) AS media_id, coalesce(u.unit_id, l.unit_id) AS unit_id, u.media_id IS NOT NULL AS known, t, n FROM units u FULL JOIN l ON u.media_id = l.media_id AND u.unit_id = l.unit_id)
SELECT media_id, unit_id, 'missingTranslation' AS issue FROM b WHERE n IS NULL UNION ALL SELECT media_id, unit_id, 'emptyTranslation' FROM b WHERE trim(t) = ''
UNION ALL SELECT media_id, unit_id, 'orphanTranslation' FROM b WHERE NOT known UNION ALL SELECT media_id, unit_id, 'duplicateTranslation' FROM b WHERE n > 1""")
def J2_match_translations(spark, d):
    return timeline.match_translations(fx.units(spark, d), fx.translations(spark, d))


TIME = "lpad(({v} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({v} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({v} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({v} % 1000)::VARCHAR, 3, '0')"
#: Two languages of each media; a timing that isn't good stands as it is written.
CUES = "WITH " + fx.SQL_SEGMENTS + f""", c0 AS (SELECT media_id, seg_idx + 1 AS ordinal, lang, text, 0 AS more, greatest(start_ms, 0) AS s, greatest(end_ms, 0) AS e FROM segments
  UNION ALL SELECT media_id, seg_idx + 1, CASE lang WHEN 'en' THEN 'de' WHEN 'de' THEN 'es' WHEN 'es' THEN 'fr' WHEN 'fr' THEN 'en' END, text, 7, greatest(start_ms, 0), greatest(end_ms, 0) FROM segments),
c1 AS (SELECT *, media_id + ordinal - 1 + more AS k, {TIME.format(v='s')} || ' --> ' || {TIME.format(v='e')} AS plain, CASE WHEN more = 7 THEN 'bis ' ELSE '' END || array_to_string(list_transform(range(0, length(text), 40), lambda k: substring(text, k + 1, 40)), chr(10)) AS shown FROM c0),
cues AS (SELECT media_id, lang, ordinal, ordinal + CASE WHEN k % 71 = 0 THEN 1 ELSE 0 END AS cue_index, s, e, k % 73 = 0 OR k % 79 = 0 OR k % 83 = 0 AS bad,
  CASE WHEN k % 73 = 0 THEN 'bad' WHEN k % 79 = 0 THEN '99999999999999' || plain WHEN k % 83 = 0 THEN plain || ' --> ' || substring(plain, 1, 12) WHEN k % 89 = 0 THEN ' ' || replace(plain, ' --> ', '  --> ') || chr(9) || ' ' ELSE plain END AS timing, shown AS text FROM c1) """


#: What is wrong with the sequence of cues, and (of a good one) with its text.
SEQUENCE = CUES + r""", g AS (SELECT *, NOT bad AND e > s AS good FROM cues), p AS (SELECT *, row_number() OVER w AS rn, coalesce(regexp_matches(text, '^\s*$'), true) AS blank,
  last_value(CASE WHEN good THEN e END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM g WINDOW w AS (PARTITION BY media_id, lang ORDER BY ordinal)),
si AS (SELECT media_id, lang, ordinal, cue_index, 'invalidCueNumbering' AS code FROM p WHERE cue_index <> rn UNION ALL SELECT media_id, lang, ordinal, cue_index, 'invalidCueTiming' FROM p WHERE NOT good
  UNION ALL SELECT media_id, lang, ordinal, cue_index, 'overlappingCues' FROM p WHERE good AND s < le UNION ALL SELECT media_id, lang, ordinal, cue_index, 'emptyCueText' FROM p WHERE good AND blank) """


@query(SEQUENCE + "SELECT media_id, lang, ordinal, code AS issue FROM si")
def W13_cue_sequence_checks(spark, d):
    return quality.check_cues(fx.flawed(timeline.cues(fx.segments(spark, d))))


@query(CUES + "SELECT media_id, lang, string_agg(cue_index::VARCHAR || chr(10) || timing || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) || chr(10) AS document FROM cues GROUP BY media_id, lang")
def S7_write_srt(spark, d):
    return timeline.srt_documents(fx.flawed(timeline.cues(fx.segments(spark, d))))


@query(CUES + "SELECT media_id, lang, cue_index, timing, length(text) AS n_chars FROM cues")
def S3_read_srt(spark, d):
    c = fx.flawed(timeline.cues(fx.segments(spark, d)))
    return timeline.parse_srt(timeline.srt_documents(c), own=True).select("media_id", "lang", "cue_index", "timing", F.length("text").cast("long").alias("n_chars"))


@query("WITH " + fx.SQL_UNITS + f" SELECT media_id, unit_id, {TIME.format(v='start_ms')} AS start_text, start_ms AS start_back FROM units")
def X6_X7_srt_times(spark, d):
    t = X.srt_time(F.col("start_ms"))
    return fx.units(spark, d).select("media_id", "unit_id", t.alias("start_text"), X.srt_ms(t).alias("start_back"))


@query("""SELECT doc_id, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE (s // 60 % 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS shown
FROM (SELECT doc_id, n_chars * 3 AS s FROM documents)""")
def X12_fmt_duration(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", X.duration((F.col("n_chars") * 3).cast("double")).alias("shown"))


@query("""SELECT doc_id, codes[doc_id % 4 + 1] AS code, CASE WHEN 40 + doc_id % 60 < 80 OR 40 + doc_id % 60 - (60 - doc_id % 60) < 20 THEN 'lowConfidence' WHEN codes[doc_id % 4 + 1] = lang THEN 'matched' ELSE 'mismatch' END AS decision
FROM (SELECT *, ['en', 'fr', 'de', 'es'] AS codes FROM documents)""")
def J7_check_language(spark, d):
    docs, k = fx.table(spark, d, "documents"), F.col("doc_id") % 60
    code = F.get(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("doc_id") % 4).cast("int"))
    return jobs.check_language(docs.select("doc_id", "lang", code.alias("code"), (40 + k).alias("confidence"), (60 - k).alias("runner_up"))).select("doc_id", "code", "decision")


@query("""SELECT doc_id, duration_ms, 1073741824 + 2 * ((duration_ms * 32100 + 999) // 1000) AS workspace_bytes
FROM (SELECT doc_id, (3000 * len(string_split(text, chr(10))) + doc_id % 5 * 500) * CASE WHEN doc_id % 59 = 0 THEN 100000 ELSE 1 END AS duration_ms FROM documents) WHERE duration_ms BETWEEN 1 AND 43200000""")
def F7_admit_media(spark, d):
    ms = (3000 * F.size(F.split("text", "\n")).cast("long") + F.col("doc_id") % 5 * 500) * F.when(F.col("doc_id") % 59 == 0, 100000).otherwise(1)
    return jobs.admit_media(fx.table(spark, d, "documents").select("doc_id", ms.alias("duration_ms")))


@query("""WITH e AS (SELECT 'f' || doc_id AS path, sha256(text) AS sha FROM documents), a AS (SELECT 'f' || doc_id AS path, sha256(CASE WHEN doc_id % 67 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 61 <> 0
  UNION ALL SELECT 'x' || doc_id, sha256(text) FROM documents WHERE doc_id % 71 = 0)
SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' ELSE 'changed' END AS state FROM e FULL JOIN a ON e.path = a.path WHERE e.sha IS DISTINCT FROM a.sha""")
def J8_reconcile_manifest(spark, d):
    docs, k = fx.table(spark, d, "documents"), F.col("doc_id")
    sha = lambda t: F.sha2(t.cast("binary"), 256).alias("sha")
    name = lambda p: F.concat(F.lit(p), k.cast("string")).alias("path")
    changed = F.when(k % 67 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    extra = docs.where(k % 71 == 0).select(name("x"), sha(F.col("text")))
    return jobs.reconcile(docs.select(name("f"), sha(F.col("text"))), docs.where(k % 61 != 0).select(name("f"), sha(changed)).unionByName(extra))


@query("""SELECT path, min(page_id) AS page_id FROM (SELECT page_id, '/m/clip' || (page_id % 40) || ['.mp4', '.mov', '.MP4'][page_id % 3 + 1] AS path FROM pages) GROUP BY path""")
def U1_dedupe_media(spark, d):
    p = F.col("page_id")
    path = F.concat(F.lit("/m/clip"), (p % 40).cast("string"), F.get(F.array(*map(F.lit, (".mp4", ".mov", ".MP4"))), (p % 3).cast("int")))
    return jobs.first_of(fx.table(spark, d, "pages").select("page_id", path.alias("path")), F.col("path"), F.col("page_id")).select("path", "page_id")


RUNS = "u AS (SELECT user_id AS job_id, event_id // 2500 AS run_id, event_id, ts, (event_id % 500) / 500::DOUBLE AS fraction FROM events)"


def _updates(spark, d):
    return fx.table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), F.floor(F.col("event_id") / 2500).alias("run_id"), "event_id", "ts", ((F.col("event_id") % 500) / F.lit(500.0)).alias("fraction")
    )


@query(f"WITH {RUNS} SELECT job_id, run_id, event_id, fraction FROM u QUALIFY row_number() OVER (PARTITION BY job_id, run_id ORDER BY ts DESC, event_id DESC) = 1")
def R2_latest_stage_timings(spark, d):
    return jobs.latest(_updates(spark, d), ["job_id", "run_id"], "ts", "event_id")


@query(f"WITH {RUNS} SELECT job_id, run_id, event_id FROM u QUALIFY run_id = max(run_id) OVER (PARTITION BY job_id)")
def R3_drop_stale_runs(spark, d):
    return jobs.active_runs(_updates(spark, d)).select("job_id", "run_id", "event_id")


@query("WITH " + fx.SQL_SEGMENTS + """, p AS (SELECT media_id, seg_idx, text, start_ms, end_ms, lag(end_ms) OVER (PARTITION BY media_id ORDER BY seg_idx) AS b FROM segments)
SELECT media_id, seg_idx FROM p WHERE start_ms < 0 OR end_ms <= start_ms OR coalesce(start_ms < b, false) OR trim(text, ' ') = '' OR (media_id + seg_idx) % 43 = 0""")
def F8_assert_clean(spark, d):
    """Some segments have a text that is none."""
    s = fx.segments(spark, d)
    return results.not_clean(s.withColumn("text", F.when((F.col("media_id") + F.col("seg_idx")) % 43 != 0, F.col("text")))).select("media_id", "seg_idx")


@query(JUDGED + "SELECT j.media_id, count(*) AS n_kept, count(*) FILTER (s.avg_logprob < -1) AS n_unsure FROM judged j JOIN segments s ON j.media_id = s.media_id AND j.seg_idx = s.seg_idx WHERE reason IS NULL GROUP BY j.media_id")
def J1_A2_timeline_report(spark, d):
    s = fx.segments(spark, d)
    kept = cleaning.judge_segments(s).where("reason is null").select("media_id", "seg_idx")
    both = kept.join(s.select("media_id", "seg_idx", "avg_logprob"), ["media_id", "seg_idx"])
    return both.groupBy("media_id").agg(F.count("*").alias("n_kept"), F.count_if(F.col("avg_logprob") < -1).alias("n_unsure"))


@query("WITH " + fx.SQL_TRANSLATIONS + """, x AS (SELECT media_id, text, row_number() OVER (PARTITION BY media_id ORDER BY unit_id, ord) AS place FROM tr),
y AS (SELECT media_id, unit_id, row_number() OVER (PARTITION BY media_id ORDER BY unit_id) AS place FROM units),
c AS (SELECT media_id, n IS NOT DISTINCT FROM m AS same FROM (SELECT media_id, count(*) AS n FROM y GROUP BY 1) FULL JOIN (SELECT media_id, count(*) AS m FROM x GROUP BY 1) USING (media_id))
SELECT y.media_id, unit_id, text AS translated, CASE WHEN x.media_id IS NULL THEN 'missingTranslation' END AS issue FROM y LEFT JOIN x ON y.media_id = x.media_id AND y.place = x.place
UNION ALL SELECT media_id, NULL, NULL, 'translationCountMismatch' FROM c WHERE NOT same""")
def J3_match_by_position(spark, d):
    return results.match_by_position(fx.units(spark, d), fx.translations(spark, d))


@query("WITH " + fx.SQL_UNITS + """, p(lang, w, c) AS (VALUES ('en', 42, 20.0::DOUBLE), ('ru', 42, 17), ('de', 42, 17), ('es', 42, 17), ('it', 42, 17), ('fr', 42, 17), ('ja', 13, 4), ('zh', 16, 9), ('ko', 16, 12), ('hi', 42, 22))
SELECT media_id, unit_id, w AS chars_per_line, length(text) * 1000 > c * (end_ms - start_ms) AS too_fast FROM units JOIN p USING (lang)""")
def J5_with_profile(spark, d):
    fast = F.length("text") * 1000 > F.col("chars_per_s") * (F.col("end_ms") - F.col("start_ms"))
    return results.with_profile(fx.units(spark, d)).select("media_id", "unit_id", "chars_per_line", fast.alias("too_fast"))


@query("WITH " + fx.SQL_WORDS + """, r AS (SELECT media_id, word_idx // 12 AS unit_id, min(word_idx) AS ws, max(word_idx) + 1 AS we FROM words GROUP BY ALL)
SELECT r.media_id, unit_id, word_idx, text FROM r JOIN words w ON r.media_id = w.media_id AND ws <= word_idx AND word_idx < we""")
def J6_words_in_units(spark, d):
    w = fx.words(spark, d)
    ranges = w.groupBy("media_id", F.floor(F.col("word_idx") / 12).alias("unit_id")).agg(F.min("word_idx").alias("word_start"), (F.max("word_idx") + 1).alias("word_end"))
    return results.words_in_units(ranges, w).select("media_id", "unit_id", "word_idx", "text")


@query("WITH " + fx.SQL_SEGMENTS + """, m AS (SELECT doc_id AS media_id, 3000 * len(string_split(text, chr(10))) AS l FROM documents)
SELECT media_id, seg_idx, end_ms - l AS over_ms FROM segments JOIN m USING (media_id) WHERE end_ms > l""")
def J10_cues_past_media_end(spark, d):
    media = fx.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), (F.size(F.split("text", "\n")) * F.lit(3.0)).alias("duration_s"))
    return results.past_media_end(fx.segments(spark, d), media).select("media_id", "seg_idx", "over_ms")


@query("WITH " + fx.SQL_SEGMENTS + ", " + fx.SQL_UNITS.removeprefix(fx.SQL_LINES + ", ") + """SELECT media_id, greatest(max(end_ms), 0) AS duration_ms FROM (SELECT media_id, end_ms FROM segments UNION ALL SELECT media_id, end_ms FROM units) GROUP BY media_id""")
def A3_transcript_duration(spark, d):
    return results.duration_of(fx.segments(spark, d), fx.units(spark, d))


STATES = "['runnable', 'waiting', 'running', 'completed', 'failed', 'inspecting', 'undecided']"


def _state(key):
    return F.get(F.array(*map(F.lit, ("runnable", "waiting", "running", "completed", "failed", "inspecting", "undecided"))), (key % 7).cast("int"))


@query(f"""SELECT DISTINCT source, target FROM (SELECT lang AS source, unnest(['en', ['fr', 'ja', 'ko'][doc_id % 3 + 1]]) AS target, {STATES}[doc_id % 7 + 1] AS state FROM documents)
WHERE state IN ('runnable', 'waiting', 'running') AND source <> target""")
def A6_required_pairs(spark, d):
    k = F.col("doc_id")
    targets = F.array(F.lit("en"), F.get(F.array(*map(F.lit, ("fr", "ja", "ko"))), (k % 3).cast("int")))
    return results.required_pairs(fx.table(spark, d, "documents").select(F.col("lang").alias("source"), targets.alias("targets"), _state(k).alias("state")))


@query(JUDGED + """, r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS p, count(*) OVER (PARTITION BY media_id) AS n FROM judged WHERE reason IS NOT NULL)
SELECT media_id, seg_idx, reason, substring(text, 1, 2000) AS text, greatest(n - 100, 0) AS n_omitted FROM r WHERE p <= 100""")
def A7_discard_evidence(spark, d):
    return results.discard_evidence(cleaning.judge_segments(fx.segments(spark, d)).where("reason is not null"))


@query(JUDGED + r""", s AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS p FROM judged WHERE reason IS NOT NULL)
SELECT media_id, seg_idx, least(len(ws), 64)::INTEGER AS n_words, array_to_string(ws[1:64], ' ') AS words FROM s WHERE p <= 100""")
def A7_discard_words(spark, d):
    """Removed segments with their words, the first 64 of each."""
    s = cleaning.judge_segments(fx.segments(spark, d)).where("reason is not null")
    got = results.discard_evidence(s.withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    return got.select("media_id", "seg_idx", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words"))


@query(JUDGED + r""", k AS (SELECT j.media_id, s.avg_logprob < -1 AS unsure, regexp_matches(j.text, '^\S[\s\S]{2}[\s\S]*\S$') AND (j.media_id + j.seg_idx) % 7 <> 0 AND (j.media_id + j.seg_idx) % 5 <> 0 AS told FROM judged j JOIN segments s ON j.media_id = s.media_id AND j.seg_idx = s.seg_idx WHERE reason IS NULL)
SELECT media_id, count(*) AS n_kept, count(*) FILTER (unsure) AS retained_low_confidence, count(*) FILTER (NOT told) AS synthetic_word_timing, count(*) FILTER (unsure OR NOT told) > 0 AS quality_warning FROM k GROUP BY media_id""")
def A2_timeline_report(spark, d):
    """Two words a segment, whose texts don't tell every seventh one; every fifth one ends too early."""
    k = F.col("media_id") + F.col("seg_idx")
    word = lambda text, start, end: F.struct(text.alias("text"), start.alias("start_ms"), end.alias("end_ms"), F.lit(0.5).alias("probability"))
    start, end = F.col("start_ms").cast("double"), F.col("end_ms").cast("double")
    tail = F.concat(F.substring("text", 4, 1 << 30), F.when(k % 7 == 0, "!").otherwise(""))
    words = F.array(word(F.left("text", F.lit(3)), start, (start + end) / 2), word(tail, (start + end) / 2, end))
    s = cleaning.judge_segments(fx.segments(spark, d)).where("reason is null").withColumn("words", words)
    return results.timeline_report(s.withColumn("end_ms", F.when(k % 5 == 0, end - 0.5).otherwise(end)))


@query("""SELECT user_id AS job_id, count(*) FILTER (event_id % 3 <> 0) AS n_saved, count(*) AS n_total,
  CASE WHEN count(*) FILTER (event_id % 3 <> 0) = 0 THEN 'failed' WHEN count(*) FILTER (event_id % 3 = 0) > 0 THEN 'completedWithWarnings' ELSE 'completed' END AS state FROM events GROUP BY user_id""")
def A9_job_rollup(spark, d):
    return results.job_rollup(fx.table(spark, d, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 3 != 0).alias("saved")))


@query("WITH " + fx.SQL_WORDS + """ SELECT media_id, word_idx // 12 AS group_id, arg_min(speaker, word_idx) FILTER ((media_id + word_idx) % 5 = 0 AND speaker IS NOT NULL) AS speaker FROM words GROUP BY ALL""")
def A10_group_speaker(spark, d):
    w = fx.words(spark, d).withColumn("speaker", F.when((F.col("media_id") + F.col("word_idx")) % 5 == 0, F.col("speaker")))
    return results.first_speaker(w, F.floor(F.col("word_idx") / 12))


@query(f"""SELECT queue, NOT bool_or(state IN ('running', 'inspecting', 'undecided')) AND bool_or(state = 'runnable') AS can_begin
FROM (SELECT event_id // 2 AS queue, {STATES}[(event_id // 2 + event_id * event_id) % 7 + 1] AS state FROM events) GROUP BY queue""")
def A11_queue_readiness(spark, d):
    e, q = F.col("event_id"), F.floor(F.col("event_id") / 2)
    return results.queue_readiness(fx.table(spark, d, "events").select(q.alias("queue"), _state(q + e * e).alias("state")))


@query("""SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 3 = 0 AND doc_id % 7 = 0 THEN 'create' WHEN doc_id % 3 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'conflict' ELSE 'replace' END AS action FROM documents""")
def S9_plan_publish(spark, d):
    docs, k = fx.table(spark, d, "documents"), F.col("doc_id")
    path, sha = F.concat(F.lit("p"), k.cast("string")).alias("path"), F.sha2(F.col("text").cast("binary"), 256)
    current = docs.where(k % 7 != 0).select(path, F.when(k % 5 == 0, F.lit("other")).otherwise(sha).alias("sha"))
    return results.plan_publish(docs.select(path, F.when(k % 3 != 0, sha).alias("sha")), current)


@query("""SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN n_chars + 2 WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n_bytes FROM documents UNION ALL
SELECT 'g' || doc_id, n_chars + 1 FROM documents WHERE doc_id % 4 = 0""")
def S10_upsert_manifest(spark, d):
    docs, k = fx.table(spark, d, "documents"), F.col("doc_id")
    row = lambda p, add, seq: [F.concat(F.lit(p), k.cast("string")).alias("path"), (F.col("n_chars") + add).alias("n_bytes"), F.lit(seq).alias("seq")]
    new = docs.where(k % 4 == 0).select(*row("f", 1, 0)).unionByName(docs.where(k % 6 == 0).select(*row("f", 2, 1))).unionByName(docs.where(k % 4 == 0).select(*row("g", 1, 0)))
    return results.upsert(docs.select(*row("f", 0, 0)), new)


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN n_chars * 2.5::DOUBLE ELSE n_chars * 3.5::DOUBLE END AS seconds,
CASE WHEN doc_id % 11 = 0 THEN 'invalidDescription' WHEN doc_id % 7 = 0 THEN 'noAudioTrack' WHEN (CASE WHEN doc_id % 5 = 0 THEN n_chars * 2.5 ELSE n_chars * 3.5 END) <= 0 THEN 'durationUnavailable'
  WHEN (CASE WHEN doc_id % 5 = 0 THEN n_chars * 2.5 ELSE n_chars * 3.5 END) > 43200 THEN 'overLimit' END AS problem FROM documents""")
def S4_probe_media(spark, d):
    k, n = F.col("doc_id"), F.col("n_chars")
    kind = F.when(k % 7 == 0, F.lit("subtitle")).otherwise(F.lit("audio"))
    whole = F.when(k % 5 == 0, F.lit('"unknown"')).otherwise((n * 3.5).cast("decimal(20,1)").cast("string"))
    text = F.format_string('{"streams": [{"codec_type": "video", "duration": "%s"}, {"codec_type": "%s", "duration": 0}], "format": {"duration": %s}}', (n * 2.5).cast("decimal(20,1)").cast("string"), kind, whole)
    return results.probe(fx.table(spark, d, "documents").select("doc_id", F.when(k % 11 == 0, F.lit("{")).otherwise(text).alias("description")))


@query("SELECT doc_id, '/m/Clip.' || doc_id || '.' || lang || '.srt' AS output, '/m/clip.' || doc_id || '.' || lower(lang) || '.srt' AS reserved FROM documents")
def X14_output_name(spark, d):
    name = X.output_name(F.concat(F.lit("/m/Clip."), F.col("doc_id").cast("string"), F.lit(".mp4")), F.col("lang"))
    return fx.table(spark, d, "documents").select("doc_id", name.alias("output"), F.lower(name).alias("reserved"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0::DOUBLE + 0.05::DOUBLE * f WHEN 1 THEN 0.05::DOUBLE + (0.15::DOUBLE - 0.05::DOUBLE) * f WHEN 2 THEN 0.15::DOUBLE + (0.78::DOUBLE - 0.15::DOUBLE) * f
  WHEN 3 THEN 0.78::DOUBLE + (0.95::DOUBLE - 0.78::DOUBLE) * f ELSE 0.95::DOUBLE + (0.99::DOUBLE - 0.95::DOUBLE) * f END AS progress, CASE WHEN f > 0 THEN 64 * (1 - f) / f END AS eta_s
FROM (SELECT event_id, (event_id % 8) / 8::DOUBLE AS f FROM events)""")
def X16_progress(spark, d):
    e = F.col("event_id")
    stage = F.get(F.array(*map(F.lit, X.STAGE_SHARE)), (e % 5).cast("int"))
    f = (e % 8) / F.lit(8.0)
    return fx.table(spark, d, "events").select("event_id", X.overall_progress(stage, f).alias("progress"), X.remaining(F.lit(64), f).alias("eta_s"))
