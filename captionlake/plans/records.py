"""Queries over files, logs, events, nested documents and folds, with the same question in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import texts as T
from ..operators import cleaning, grouping, policy, quality, results, timeline, translation
from ..operators.tables import scratch_dir, stored
from ..sources import fixtures as fx
from ..sources import outputs, timelines
from ..streaming import state
from ..streaming.files import through_stream
from .catalogue import CUES, JUDGED, SEQUENCE, query


def _docs(spark, d):
    return fx.table(spark, d, "documents")


def _named(prefix):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("path")


FOLD = r"""WITH RECURSIVE """ + JUDGED.removeprefix("WITH ") + r""", k AS MATERIALIZED (SELECT *, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{M}\p{N}'']', '', 'g')), lambda w: regexp_matches(w, '[\p{L}\p{N}]')), ' ') AS key
  FROM judged WHERE reason IS NULL), o AS MATERIALIZED (SELECT media_id, seg_idx, key, start_ms, end_ms, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS rn FROM k WHERE key <> ''),
f AS (SELECT media_id, 0::BIGINT AS seg_idx, 0::BIGINT AS rn, NULL::VARCHAR AS last, 0::BIGINT AS reach, 0::BIGINT AS start_ms, NULL::VARCHAR AS reason FROM (SELECT DISTINCT media_id FROM o)
  UNION ALL SELECT media_id, seg_idx, rn, CASE WHEN why IS NULL THEN key ELSE last END, CASE WHEN why IS NULL THEN end_ms ELSE reach END, CASE WHEN why = 'duplicate' THEN start_ms ELSE greatest(start_ms, reach) END, why
  FROM (SELECT o.*, f.last, f.reach, CASE WHEN o.key = f.last AND o.start_ms < f.reach THEN 'duplicate' WHEN o.end_ms <= greatest(o.start_ms, f.reach) THEN 'fully_overlapped' END AS why FROM f JOIN o ON o.media_id = f.media_id AND o.rn = f.rn + 1))
SELECT media_id, seg_idx, start_ms, reason FROM f WHERE rn > 0 UNION ALL SELECT media_id, seg_idx, start_ms, 'empty_or_decoder_loop' FROM k WHERE key = ''"""


@query(FOLD)
def W2_W3_sanitize(spark, d):
    return grouping.sanitize(cleaning.judge_segments(fx.segments(spark, d)))


@query("WITH RECURSIVE " + fx.SQL_UNITS + r""", u AS MATERIALIZED (SELECT media_id, unit_id, lang, start_ms, end_ms, CASE WHEN (media_id + unit_id) % 5 <> 0 THEN 's' || ((media_id + unit_id) // 4 % 2) END AS sp,
  regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM units), v AS MATERIALIZED (SELECT *, length_grapheme(t)::BIGINT AS n, coalesce(right(t, 1) IN ('.', '!', '?', '。', '！', '？', '…'), false) AS done FROM u),
f AS (SELECT media_id, unit_id, 0::BIGINT AS group_id, 1 AS k, start_ms AS s, end_ms AS e, n, done, sp FROM v WHERE unit_id = 0
  UNION ALL SELECT media_id, unit_id, g + CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN fk + 1 ELSE 1 END, CASE WHEN ok THEN fs ELSE start_ms END, end_ms, CASE WHEN ok THEN total ELSE n END, done, sp
  FROM (SELECT *, fk < 6 AND start_ms - fe BETWEEN 0 AND 1000 AND end_ms - fs <= 20000 AND total <= 600 AND NOT ((fk >= 3 OR fe - fs >= 12000) AND fdone) AND NOT coalesce(sp <> fsp, false) AS ok
    FROM (SELECT v.*, f.group_id AS g, f.k AS fk, f.s AS fs, f.e AS fe, f.done AS fdone, f.sp AS fsp, f.n + v.n + CASE WHEN f.n > 0 AND v.n > 0 AND v.lang NOT IN ('ja', 'zh') THEN 1 ELSE 0 END AS total
      FROM f JOIN v ON v.media_id = f.media_id AND v.unit_id = f.unit_id + 1)))
SELECT media_id, unit_id, group_id FROM f""")
def W6_group_units(spark, d):
    k = F.col("media_id") + F.col("unit_id")
    speaker = F.when(k % 5 != 0, F.concat(F.lit("s"), (F.floor(k / 4) % 2).cast("string")))
    return grouping.group_units(fx.units(spark, d).withColumn("speaker", speaker))


@query("WITH " + fx.SQL_UNITS + " SELECT media_id, unit_id, CASE WHEN contains(text, 'z') THEN NULL ELSE '<' || text || '>' END AS translated, CASE WHEN contains(text, 'z') THEN 'ValueError' END AS problem FROM units")
def E1_apply_translator(spark, d):
    def translate(texts):
        if any("z" in t for t in texts):
            raise ValueError("unknown letter")
        return [f"<{t}>" for t in texts]

    return grouping.apply_translator(fx.units(spark, d), translate)


@query("WITH " + fx.SQL_UNITS + r""", tg AS (SELECT media_id, lang FROM units WHERE lang IS NOT NULL UNION SELECT media_id, CASE lang WHEN 'en' THEN 'de' WHEN 'de' THEN 'es' WHEN 'es' THEN 'fr' WHEN 'fr' THEN 'en' ELSE 'de' END FROM units),
e AS (SELECT u.media_id, tg.lang, unit_id, text, tg.lang IS NOT DISTINCT FROM u.lang AS own, length(text) AS n FROM units u JOIN tg ON u.media_id = tg.media_id),
f AS (SELECT media_id, lang, bool_or(own) AS own, min(CASE WHEN own THEN CASE WHEN regexp_matches(text, '^\s*$') THEN 'empty' END WHEN lang = 'en' AND n % 83 = 7 THEN 'ValueError' WHEN lang = 'fr' AND n % 89 = 11 THEN 'unknownId'
  WHEN lang = 'es' AND n % 97 = 13 THEN 'replacementCharacter' END) AS problem FROM e GROUP BY media_id, lang)
SELECT e.media_id, e.lang, unit_id, CASE WHEN e.own THEN text ELSE '<' || text || '>' END AS text, NULL AS status, NULL AS problem FROM e JOIN f ON e.media_id = f.media_id AND e.lang = f.lang WHERE problem IS NULL
UNION ALL SELECT media_id, lang, NULL, NULL, CASE WHEN problem IS NOT NULL THEN 'failed' WHEN own THEN 'copied' ELSE 'translated' END, problem FROM f""")
def E1_J4_translate_targets(spark, d):
    """Every media in its own language and in one more. Translators leave out or damage some units until they are asked alone
    (German, Spanish), and fail on some lengths of text: Spanish each time, French by a wrong id, English by an error."""

    def translator(lang):
        def answer(i, t, alone):
            if lang == "en" and len(t) % 83 == 7:
                raise ValueError("unknown length")
            if lang == "de" and len(t) % 7 == 3 and not alone:
                return []
            if lang == "es" and (len(t) % 97 == 13 or (len(t) % 5 == 1 and not alone)):
                return [(i, "\ufffd")]
            return [(i, f"<{t}>")] + [(i + 1_000_000_000, t)] * (lang == "fr" and len(t) % 89 == 11)

        return lambda pairs: [a for i, t in pairs for a in answer(i, t, len(pairs) == 1)]

    u = fx.units(spark, d)
    after = F.create_map(*[F.lit(x) for pair in zip(("en", "de", "es", "fr"), ("de", "es", "fr", "en")) for x in pair])
    media = u.select("media_id", "lang").distinct()
    targets = media.unionByName(media.withColumn("lang", F.coalesce(F.try_element_at(after, F.col("lang")), F.lit("de"))))
    done, status = translation.translate_targets(u, targets, {x: translator(x) for x in ("en", "de", "es", "fr")})
    return done.unionByName(status, allowMissingColumns=True)


#: A line is indivisible if no place in it has white space or follows punctuation (and may be parted at).
ISSUES = SEQUENCE + r""", pr(lang, w, c, m) AS (VALUES ('en', 42, 20::DOUBLE, 833), ('de', 42, 17, 833), ('es', 42, 17, 833), ('fr', 42, 17, 833)),
q AS (SELECT p.*, w, c, m, e - s AS took, string_split(text, chr(10)) AS ls, length_grapheme(replace(text, chr(10), '')) AS units, ordinal * 3000 + (media_id % 5) * 100 AS media_end FROM p LEFT JOIN pr USING (lang)),
ok AS (SELECT * FROM q WHERE good AND NOT blank), li AS (SELECT media_id, lang, ordinal, cue_index, w, unnest(ls) AS x FROM ok), lw AS (SELECT *, row_number() OVER () AS r, length_grapheme(x)::DOUBLE AS wide, regexp_matches(x, '^\s*$') AS blank FROM li),
lb AS (SELECT r, bool_or(coalesce(instr('([{（［｛〈《「『【〔〖〘〚‘“', l) = 0 AND instr(')]},.!?;:%）］｝〉》」』】〕〗〙〛’”、。，．！？：；％‰℃…', r_) = 0 AND (l = ' ' OR r_ = ' ' OR (regexp_matches(l, '\p{P}') AND l NOT IN ('''', '’') AND r_ NOT IN ('''', '’') AND NOT regexp_matches(l || r_, '^_[A-Za-z0-9_]$'))), false)) AS parts
  FROM (SELECT r, substring(x, j, 1) AS l, substring(x, j + 1, 1) AS r_ FROM (SELECT *, unnest(range(1, greatest(length(x), 2))) AS j FROM lw WHERE NOT blank AND wide > w)) GROUP BY r),
i AS (SELECT media_id, lang, ordinal, cue_index, 'error' AS severity, code, NULL::DOUBLE AS actual, NULL::DOUBLE AS "limit" FROM si
  UNION ALL SELECT media_id, lang, ordinal, cue_index, 'error', 'tooManyLines', len(ls), 2 FROM ok WHERE len(ls) > 2 UNION ALL SELECT media_id, lang, ordinal, cue_index, 'error', 'emptyLine', NULL, NULL FROM lw WHERE blank
  UNION ALL SELECT media_id, lang, ordinal, cue_index, CASE WHEN parts THEN 'error' ELSE 'warning' END, 'lineTooLong', wide, w FROM lw JOIN lb USING (r)
  UNION ALL SELECT media_id, lang, ordinal, cue_index, 'warning', 'cueTooShort', took / 1000, m / 1000::DOUBLE FROM ok WHERE took < m UNION ALL SELECT media_id, lang, ordinal, cue_index, 'warning', 'cueTooLong', took / 1000, 7 FROM ok WHERE took > 7000
  UNION ALL SELECT media_id, lang, ordinal, cue_index, 'warning', 'readingSpeedExceeded', units * 1000::DOUBLE / took, c FROM ok WHERE took + 1.001::DOUBLE < units::DOUBLE * 1000 / c
  UNION ALL SELECT media_id, lang, ordinal, cue_index, 'error', 'cuePastMediaEnd', e / 1000, media_end / 1000 FROM q WHERE good AND e > media_end) """


def _issues(spark, d):
    """Some cues end after their media: each cue's media is taken to end somewhere behind its place."""
    cues = fx.flawed(timeline.cues(fx.segments(spark, d)))
    return quality.assess_cues(results.with_profile(cues).withColumn("media_end_ms", F.col("ordinal") * 3000 + F.col("media_id") % 5 * 100))


@query(ISSUES + 'SELECT media_id, lang, ordinal, cue_index, severity, code, actual, "limit" FROM i')
def Q1_assess_cues(spark, d):
    return _issues(spark, d)


@query(ISSUES + "SELECT media_id, lang, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings FROM i GROUP BY media_id, lang")
def A4_qa_summary(spark, d):
    return quality.summary(_issues(spark, d))


NAMES = "CASE WHEN doc_id % 59 = 0 THEN 'x/.npmrc' WHEN doc_id % 19 = 0 THEN '/abs' || doc_id WHEN doc_id % 23 = 0 THEN 'a/../b' || doc_id ELSE 'f' || doc_id END"


def _files(spark, d):
    name = F.when(F.col("doc_id") % 59 == 0, "x/.npmrc").when(F.col("doc_id") % 19 == 0, _named("/abs")).when(F.col("doc_id") % 23 == 0, _named("a/../b")).otherwise(_named("f"))
    key = F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit(" AK" + "IA"), F.upper(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 16)))).otherwise("")
    home = F.when(F.col("doc_id") % 89 == 0, F.concat(F.lit(" /home/u"), F.col("doc_id").cast("string"), F.lit("/a.wav"))).otherwise("")
    return _docs(spark, d).select(name.alias("path"), F.concat("text", key, home).alias("text"))


FILES = f"""WITH files AS (SELECT {NAMES} AS path, text || CASE WHEN doc_id % 97 = 0 THEN ' AK' || 'IA' || upper(substring(md5(doc_id::VARCHAR), 1, 16)) ELSE '' END
  || CASE WHEN doc_id % 89 = 0 THEN ' /home/u' || doc_id || '/a.wav' ELSE '' END AS text FROM documents) """


@query(FILES + """, x AS (SELECT path, 'forbiddenName' AS problem FROM files WHERE path LIKE '%/.npmrc' UNION ALL SELECT path, CASE WHEN contains(text, '-----BEGIN ' || 'PRIVATE KEY-----') OR contains(text, '-----BEGIN OPENSSH ' || 'PRIVATE KEY-----') THEN 'privateKey'
  WHEN regexp_matches(text, 'AK' || 'IA[0-9A-Z]{16}') THEN 'cloudKey' WHEN regexp_matches(text, 'gh' || '[ps]_[A-Za-z0-9]{30,}') THEN 'token' WHEN regexp_matches(text, 'github_pat' || '_[A-Za-z0-9_]{30,}') THEN 'fineToken' END AS problem FROM files)
SELECT path, problem FROM x WHERE problem IS NOT NULL""")
def P1_scan_secrets(spark, d):
    return policy.scan_files(_files(spark, d))


@query(FILES + "SELECT path, m AS marker FROM files, (SELECT unnest(['/Users/', '/home/', '/private/var/folders/']) AS m) WHERE contains(text, m)")
def P2_scan_private_paths(spark, d):
    return policy.scan_private_folders(_files(spark, d))


@query(FILES + "SELECT path, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha FROM files WHERE path NOT LIKE '/%' AND NOT list_contains(string_split(path, '/'), '..')")
def S11_build_manifest(spark, d):
    return policy.build_manifest(_files(spark, d))


@query("""SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 67 = 0 THEN 'first' ELSE 'second' END AS side FROM documents WHERE (doc_id % 67 = 0) <> (doc_id % 61 = 0)""")
def U4_catalogue_difference(spark, d):
    docs = _docs(spark, d)
    return policy.catalogue_difference(docs.where(F.col("doc_id") % 61 != 0).select(_named("f")), docs.where(F.col("doc_id") % 67 != 0).select(_named("f")), "path")


@query("""WITH r AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS p FROM documents), s AS (SELECT doc_id, p, ['en', 'fr', 'de', 'es'][p + 1] AS code, (doc_id * (3 + p) % 10) / 10::DOUBLE AS score FROM r WHERE p < 1 + doc_id % 4),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p) AS rn FROM s)
SELECT doc_id, max(code) FILTER (rn = 1) AS code, max(score) FILTER (rn = 1) AS best, coalesce(max(score) FILTER (rn = 2), 0) AS runner_up FROM n GROUP BY doc_id""")
def T1_top2_languages(spark, d):
    codes = F.array(*map(F.lit, ("en", "fr", "de", "es")))
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.slice(codes, F.lit(1), (1 + F.col("doc_id") % 4).cast("int"))).alias("p", "code"))
    return policy.two_best(rows.withColumn("score", (F.col("doc_id") * (3 + F.col("p")) % 10) / F.lit(10.0)), ["doc_id"], "p", "score", "code")


@query("""WITH n AS (SELECT page_id, lower('/m/Clip' || page_id % 40 || '.en.srt') AS reserved FROM pages)
SELECT page_id, reserved FROM n QUALIFY count(*) OVER (PARTITION BY reserved) > 1""")
def U2_duplicate_destinations(spark, d):
    p = F.col("page_id")
    rows = fx.table(spark, d, "pages").select(p, X.output_name(F.concat(F.lit("/m/Clip"), (p % 40).cast("string"), F.lit(".mp4")), F.lit("en")).alias("out"))
    return policy.duplicates(rows, F.lower("out")).select("page_id", "reserved")


BAD = r"\x{FFFD}\x{FDD0}-\x{FDEF}" + "".join(rf"\x{{{n:X}}}" for p in range(17) for n in (p * 65536 + 65534, p * 65536 + 65535))
DAMAGED = "WITH " + fx.SQL_TRANSLATIONS + rf""", x AS (SELECT media_id, unit_id, ord, CASE WHEN (media_id + unit_id) % 37 = 0 THEN text || chr(8203) || chr(65533) WHEN (media_id + unit_id) % 47 = 0 THEN text || chr(64976) ELSE text END AS text FROM tr),
y AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM x), z AS (SELECT *, regexp_extract(regexp_replace(t, '[\x09\x0A\x0D\x{{061C}}\x{{200C}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}\x{{FE0E}}\x{{FE0F}}]', '', 'g'), '[\p{{Cc}}\p{{Cf}}{BAD}]') AS b FROM y),
dm AS (SELECT media_id, unit_id, ord, CASE WHEN t = '' THEN 'empty' WHEN b = '' THEN NULL WHEN b = chr(65533) THEN 'replacementCharacter' WHEN regexp_matches(b, '[{BAD}]') THEN 'invalidUnicodeScalar' ELSE 'disallowedControlCharacter' END AS damage FROM z) """


def _damaged(spark, d):
    k = F.col("media_id") + F.col("unit_id")
    text = F.when(k % 37 == 0, F.concat("text", F.lit("​�"))).when(k % 47 == 0, F.concat("text", F.lit("﷐"))).otherwise(F.col("text"))
    return fx.translations(spark, d).withColumn("text", text)


@query(DAMAGED + "SELECT media_id, unit_id, ord, damage FROM dm WHERE damage IS NOT NULL")
def F6_text_damage(spark, d):
    return _damaged(spark, d).select("media_id", "unit_id", "ord", T.damage(F.col("text")).alias("damage")).where("damage is not null")


@query(DAMAGED + """, g AS (SELECT media_id, unit_id, count(*) AS n, max(damage) AS damage FROM dm GROUP BY ALL), b AS (SELECT coalesce(u.media_id, g.media_id) AS batch, coalesce(u.unit_id, g.unit_id) AS unit_id, u.media_id IS NOT NULL AS asked, n, damage
  FROM units u FULL JOIN g ON u.media_id = g.media_id AND u.unit_id = g.unit_id), k AS (SELECT DISTINCT batch FROM b WHERE NOT asked OR n > 1)
SELECT batch, NULL::BIGINT AS unit_id, 'failed' AS verdict FROM k UNION ALL SELECT batch, unit_id, 'retry' FROM b WHERE (n IS NULL OR damage IS NOT NULL) AND batch NOT IN (SELECT batch FROM k)""")
def J4_retry_set(spark, d):
    as_batch = lambda rows: rows.withColumnRenamed("media_id", "batch")
    return policy.retry_units(as_batch(fx.units(spark, d)), as_batch(_damaged(spark, d)), T.damage(F.col("text")))


@query("WITH " + fx.SQL_LINES + r""", a AS (SELECT media_id, i, regexp_replace(CASE WHEN (media_id + i) % 7 = 0 THEN 'EVT' || chr(9) || '{}' WHEN (media_id + i) % 5 = 0 AND i > 0 THEN prev ELSE t END, '^[ \t]+|[ \t]+$', '', 'g') AS t FROM lines),
b AS (SELECT * FROM (SELECT *, lag(t) OVER (PARTITION BY media_id ORDER BY i) AS p FROM a WHERE t <> '' AND NOT starts_with(t, 'EVT' || chr(9))) WHERE t IS DISTINCT FROM p QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY i DESC) <= 120),
j AS (SELECT media_id, string_agg(t, chr(10) ORDER BY i) AS s FROM b GROUP BY media_id)
SELECT media_id, CASE WHEN octet_length(encode(s)) <= 16384 THEN s ELSE decode(unhex(regexp_replace(right(hex(encode(s)), 32768), '^(?:[89AB][0-9A-F])+', ''))) END AS tail FROM j""")
def W14_log_tail(spark, d):
    k = F.col("media_id") + F.col("i")
    t = F.when(k % 7 == 0, timelines.EVENT + "{}").when((k % 5 == 0) & (F.col("i") > 0), F.col("prev")).otherwise(F.col("t"))
    return policy.log_tail(fx.lines(spark, d).withColumn("t", t), timelines.EVENT)


@query("WITH " + fx.SQL_LINES + """ SELECT media_id, i, t FROM lines QUALIFY sum(length(t)) OVER (PARTITION BY media_id ORDER BY i DESC) <= 8000 OR row_number() OVER (PARTITION BY media_id ORDER BY i DESC) = 1""")
def W15_bounded_log(spark, d):
    return policy.bounded_log(fx.lines(spark, d))


FRAMED = r"""WITH l AS (SELECT doc_id AS media_id, regexp_split_to_array(regexp_replace(replace(text, 'a ', 'a' || chr(13) || chr(10)), '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS ls FROM documents WHERE text <> ''),
f AS (SELECT *, len(list_filter(ls, lambda x: octet_length(encode(x)) > 65536)) > 0 AS failed FROM l)
SELECT media_id, failed, p, CASE WHEN NOT failed THEN ls[p + 1] END AS line FROM (SELECT *, unnest(CASE WHEN failed THEN [0] ELSE range(len(ls)) END)::INTEGER AS p FROM f)"""


def _chunks(spark, d):
    """Chunks of 500 characters; a text without any has none."""
    chunks = F.regexp_extract_all(F.replace("text", F.lit("a "), F.lit("a\r\n")), F.lit("(?s).{1,500}"), F.lit(0))
    docs = _docs(spark, d).select(F.col("doc_id").alias("media_id"), chunks.alias("chunks"))
    return docs.select("media_id", F.size("chunks").alias("n"), F.posexplode("chunks").alias("p", "chunk")).select("media_id", "p", "chunk", (F.col("p") == F.col("n") - 1).alias("last"))


@query(FRAMED)
def R6_frame_lines(spark, d):
    return policy.framed(_chunks(spark, d))


@query(FRAMED)
def R6_frame_lines_stream(spark, d):
    """The same as a stream of files that come in three pieces, each with a third of every source's chunks, so that lines go on
    from piece to piece."""
    folder = state.run_in_pieces(_chunks(spark, d).withColumnRenamed("p", "seq"), 3, "seq", state.frame_lines)
    return spark.read.schema(state.LINES).parquet(f"{folder}/out")


EVENTS = """WITH e AS (SELECT event_id, user_id AS job_id, ['check', 'audio', 'speech', 'translate', 'save'][event_id % 5 + 1] AS stage, (event_id % 8) / 8::DOUBLE AS f FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0) """


def _event_lines(spark, d):
    e = F.col("event_id")
    stage = F.get(F.array(*map(F.lit, X.STAGE_SHARE)), (e % 5).cast("int"))
    event = F.to_json(F.struct("event_id", F.col("user_id").alias("job_id"), stage.alias("stage"), ((e % 8) / F.lit(8.0)).alias("fraction")))
    line = F.when(e % 7 == 0, F.concat(F.lit("wrote /tmp/"), e.cast("string"))).when(e % 11 == 0, timelines.EVENT + "{broken").otherwise(F.concat(F.lit(timelines.EVENT), event))
    return fx.table(spark, d, "events").select(line.alias("value"))


@query(EVENTS + "SELECT event_id, job_id, stage, f AS fraction FROM e")
def S6_R7_event_lines(spark, d):
    return timelines.event_lines(_event_lines(spark, d))


@query(EVENTS + """SELECT event_id, job_id, CASE stage WHEN 'check' THEN 0::DOUBLE + 0.05::DOUBLE * f WHEN 'audio' THEN 0.05::DOUBLE + (0.15::DOUBLE - 0.05::DOUBLE) * f WHEN 'speech' THEN 0.15::DOUBLE + (0.78::DOUBLE - 0.15::DOUBLE) * f
  WHEN 'translate' THEN 0.78::DOUBLE + (0.95::DOUBLE - 0.78::DOUBLE) * f ELSE 0.95::DOUBLE + (0.99::DOUBLE - 0.95::DOUBLE) * f END AS progress FROM e""")
def R1_progress_stream(spark, d):
    progress = lambda lines: timelines.event_lines(lines).select("event_id", "job_id", X.overall_progress(F.col("stage"), F.col("fraction")).alias("progress"))
    return through_stream(spark, _event_lines(spark, d), progress)


@query("""WITH e AS (SELECT event_id, user_id AS job_id, ['audio', 'speech', 'none'][event_id % 3 + 1] AS stage, CASE WHEN event_id % 5 <> 0 THEN greatest(0, least(1, (event_id % 13 - 2) / 8::DOUBLE)) END AS f FROM events)
SELECT event_id, job_id, stage, CASE stage WHEN 'audio' THEN 0.05::DOUBLE + (0.15::DOUBLE - 0.05::DOUBLE) * f ELSE 0.15::DOUBLE + (0.78::DOUBLE - 0.15::DOUBLE) * f END AS progress,
  CASE WHEN event_id % 4 <> 0 THEN (event_id % 100)::DOUBLE END AS elapsed, CASE WHEN event_id % 4 = 1 THEN (event_id % 7)::DOUBLE END AS eta FROM e WHERE f IS NOT NULL AND stage <> 'none'""")
def R1_progress_times(spark, d):
    """A stream of events with the times that they tell; fractions run beyond both ends, some are missing."""
    e = F.col("event_id")
    fraction = F.when(e % 5 != 0, (e % 13 - 2) / F.lit(8.0))
    event = F.to_json(F.struct("event_id", F.col("user_id").alias("job_id"), F.get(F.array(*map(F.lit, ("audio", "speech", "none"))), (e % 3).cast("int")).alias("stage"), fraction.alias("fraction"), F.when(e % 4 != 0, (e % 100).cast("double")).alias("elapsed"), F.when(e % 4 == 1, (e % 7).cast("double")).alias("eta")))
    return through_stream(spark, fx.table(spark, d, "events").select(F.concat(F.lit(timelines.EVENT), event).alias("value")), timelines.progress_updates)


@query("WITH " + fx.SQL_SEGMENTS + ", " + fx.SQL_UNITS.removeprefix(fx.SQL_LINES + ", ") + """SELECT 'segments' AS kind, media_id, seg_idx AS place, seg_idx::VARCHAR AS id, start_ms, end_ms, text FROM segments
UNION ALL SELECT 'semantic_units', media_id, unit_id, unit_id::VARCHAR, start_ms, end_ms, text FROM units UNION ALL SELECT 'words', media_id, unit_id, unit_id::VARCHAR, start_ms, start_ms + 100, left(text, 5) FROM units""")
def S1_S8_timelines(spark, d):
    u = fx.units(spark, d)
    words = u.select("media_id", F.col("unit_id").alias("word_idx"), F.left("text", F.lit(5)).alias("text"), "start_ms", (F.col("start_ms") + 100).alias("end_ms"))
    documents = stored(timelines.build_timelines(fx.segments(spark, d), u, words)).where("not too_large")
    return timelines.read_all_timelines(documents).select("kind", "media_id", "place", "id", "start_ms", "end_ms", "text")


@query("""SELECT doc_id AS media_id, CASE doc_id % 9 WHEN 0 THEN 'emptyFile' WHEN 1 THEN 'invalidUTF8' WHEN 2 THEN 'invalidJSON' WHEN 3 THEN 'missingWords' WHEN 4 THEN 'missingSegments' WHEN 5 THEN 'missingSemanticUnits' WHEN 6 THEN 'missingWords' END AS code
FROM documents WHERE doc_id % 9 < 7""")
def S1_timeline_rejects(spark, d):
    """Documents without text, that are no UTF-8, no JSON, or lack a list; the last two kinds can be read."""
    k, text = F.col("doc_id") % 9, F.to_json(F.struct("text"))
    lists = lambda *names: F.concat(F.lit("{"), *[F.lit(f'"{n}": [],') for n in names], F.lit('"note": '), text, F.lit("}")).cast("binary")
    document = (
        F.when(k == 0, F.lit(b"")).when(k == 1, F.concat(lists("words"), F.lit(b"\xff"))).when(k == 2, text.substr(F.lit(1), F.length(text) - 1).cast("binary")).when(k == 3, lists("segments", "semantic_units"))
        .when(k == 4, lists("words", "semantic_units")).when(k == 5, lists("words", "segments")).when(k == 6, F.concat(F.lit('{"words": 3, "segments": [], "semantic_units": [], "note": '), text, F.lit("}")).cast("binary")).when(k == 7, lists("words", "segments", "semanticUnits"))
        .otherwise(lists("words", "segments", "semantic_units"))
    )
    return timelines.timeline_rejects(_docs(spark, d).select(F.col("doc_id").alias("media_id"), document.alias("document")))


@query("WITH " + fx.SQL_TRANSLATIONS + " SELECT media_id, unit_id::VARCHAR AS unit_id, text FROM tr")
def S5_read_translations(spark, d):
    u = F.col("unit_id")
    as_line = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()], "text"))
    line = F.when(u % 3 == 0, as_line(id=u.cast("string"))).when(u % 3 == 1, as_line(unitID=u)).otherwise(as_line(unit_id=u))
    return timelines.read_translations(fx.translations(spark, d).select("media_id", line.alias("line")))


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' WHEN 'fr' THEN 'fr' END WHEN 1 THEN 'es' WHEN 2 THEN NULL ELSE 'zh' END AS code,
  CASE WHEN doc_id % 5 > 1 THEN doc_id / 8::DOUBLE END AS n, regexp_matches(text, '[぀-ヿ一-鿿가-힯]') AS cjk, length_grapheme(text)::INTEGER AS width FROM documents""")
def X3_X5_X11_X13_measures(spark, d):
    tag = F.when(F.col("doc_id") % 4 == 0, F.upper("lang")).when(F.col("doc_id") % 4 == 1, " es_419 ").when(F.col("doc_id") % 4 == 2, "tlh").otherwise("zh_Hans_CN")
    number = F.when(F.col("doc_id") % 5 == 0, "NaN").when(F.col("doc_id") % 5 == 1, "n/a").otherwise((F.col("doc_id") / F.lit(8.0)).cast("string"))
    return _docs(spark, d).select("doc_id", T.language_code(tag).alias("code"), T.safe_number(number).alias("n"), T.has_cjk(F.col("text")).alias("cjk"), T.graphemes(F.col("text")).alias("width"))


SPACED = r"regexp_replace({x}, '(\p{{L}}) ?'' ?(\p{{L}})', '\1''\2', 'g')"


@query(r"WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, 'e s', 'e '' s'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents) SELECT doc_id, " + SPACED.format(x=SPACED.format(x="t")) + " AS caption FROM c")
def X8_normalize_caption(spark, d):
    return _docs(spark, d).select("doc_id", T.caption(F.replace("text", F.lit("e s"), F.lit("e ' s"))).alias("caption"))


@query(r"""WITH p AS (SELECT doc_id, text || CASE WHEN doc_id % 8 = 0 THEN ' [/Users/u' || doc_id || '/x.wav], see,/home/u' || doc_id || ' <-/tmp/a>' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' "/m/a b' || doc_id || '.wav" ''/n/it"s'' file:/a a/b https://c/d' ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN chr(13) || 'clip' || doc_id || '.mov of /v/clip' || doc_id || '.mov by Ann ' || doc_id ELSE '' END AS t FROM documents),
v AS (SELECT doc_id, replace(replace(replace(replace(t, chr(13), chr(10)), '/v/clip' || doc_id || '.mov', '<private-path>'), 'clip' || doc_id || '.mov', '<private-path>'), 'Ann ' || doc_id, '<private-path>') AS t FROM p),
q AS (SELECT doc_id, regexp_replace(regexp_replace(t, '"/[^"\r\n]+"', '"<private-path>"', 'g'), '''/[^''\r\n]+''', '''<private-path>''', 'g') AS t FROM v)
SELECT doc_id, regexp_replace(t, '(^|[^A-Za-z0-9:])/[^\s"''<>\[\](),;]+', '\1<private-path>', 'g') AS shown FROM q""")
def X15_redact_paths(spark, d):
    """Paths behind brackets, commas and dashes, in quotes, behind a colon (which stay), and values named by the caller."""
    k = F.col("doc_id").cast("string")
    when = lambda n, *parts: F.when(F.col("doc_id") % n == 0, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")
    bare, quoted = when(8, " [/Users/u", k, "/x.wav], see,/home/u", k, " <-/tmp/a>"), when(7, ' "/m/a b', k, ".wav\" '/n/it\"s' file:/a a/b https://c/d")
    told = when(5, "\rclip", k, ".mov of /v/clip", k, ".mov by Ann ", k)
    private = F.array(F.concat(F.lit("Ann "), k), F.concat(F.lit("/v/clip"), k, F.lit(".mov")), F.lit("/v"), F.lit(""), F.lit(None))
    return _docs(spark, d).select("doc_id", T.redact_paths(F.concat("text", bare, quoted, told), private).alias("shown"))


@query("WITH RECURSIVE " + fx.SQL_WORDS + r""", m AS MATERIALIZED (SELECT media_id, word_idx, start_ms, end_ms, coalesce(start_ms - lag(end_ms) OVER w >= 800 OR regexp_matches(lag(text) OVER w, '[.!?。！？।॥]["''”’»)\]}]*\s*$'), false) AS new
  FROM words WINDOW w AS (PARTITION BY media_id ORDER BY word_idx)), f AS (SELECT media_id, word_idx, 0::BIGINT AS unit_id, start_ms AS s, end_ms AS e FROM m WHERE word_idx = 0
  UNION ALL SELECT m.media_id, m.word_idx, f.unit_id + CASE WHEN new OR f.e - f.s >= 15000 THEN 1 ELSE 0 END, CASE WHEN new OR f.e - f.s >= 15000 THEN m.start_ms ELSE f.s END, m.end_ms FROM f JOIN m ON m.media_id = f.media_id AND m.word_idx = f.word_idx + 1)
SELECT media_id, word_idx, unit_id FROM f""")
def W5_split_units(spark, d):
    return grouping.split_units(fx.words(spark, d))


THROTTLED = """WITH RECURSIVE u AS MATERIALIZED (SELECT user_id AS job_id, event_id // 2500 AS run_id, event_id, least(1, (event_id % 500) / 450::DOUBLE) AS fraction, row_number() OVER w AS rn, lead(event_id) OVER w IS NULL AS final
  FROM events WINDOW w AS (PARTITION BY user_id, event_id // 2500 ORDER BY event_id)), f AS (SELECT job_id, run_id, rn, event_id, fraction, fraction AS last, true AS shown FROM u WHERE rn = 1
  UNION ALL SELECT u.job_id, u.run_id, u.rn, u.event_id, u.fraction, CASE WHEN u.final OR u.fraction >= 1 OR u.fraction - f.last >= 0.002::DOUBLE THEN u.fraction ELSE f.last END, u.final OR u.fraction >= 1 OR u.fraction - f.last >= 0.002::DOUBLE
  FROM f JOIN u ON u.job_id = f.job_id AND u.run_id = f.run_id AND u.rn = f.rn + 1)
SELECT job_id, run_id, event_id, fraction FROM f WHERE shown"""


def _fractions(spark, d):
    e = F.col("event_id")
    return fx.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.floor(e / 2500).alias("run_id"), e, F.least(F.lit(1.0), (e % 500) / F.lit(450.0)).alias("fraction"))


@query(THROTTLED)
def R5_throttle_progress(spark, d):
    return grouping.throttled(_fractions(spark, d))


@query(THROTTLED)
def R5_throttle_stream(spark, d):
    """The same as a stream of files by run, which remembers what it showed last."""
    u = _fractions(spark, d)
    last = u.groupBy("job_id", "run_id").agg(F.max("event_id").alias("event_id"), F.lit(True).alias("final"))
    told = u.join(last, ["job_id", "run_id", "event_id"], "left").withColumns({"final": F.coalesce("final", F.lit(False)), "piece": F.floor(F.col("event_id") % 2500 / 834)})
    folder = state.run_in_pieces(told, 3, "piece", state.throttle_progress)
    return spark.read.schema(state.SHOWN).parquet(f"{folder}/out")


@query("""WITH u AS (SELECT user_id AS job_id, event_id // 2500 AS run_id, event_id, ts, ['check', 'audio', 'speech'][event_id % 3 + 1] AS stage, (event_id % 500) / 500::DOUBLE AS fraction FROM events)
SELECT job_id, run_id, stage, event_id, fraction FROM (SELECT * FROM u QUALIFY run_id = max(run_id) OVER (PARTITION BY job_id)) QUALIFY row_number() OVER (PARTITION BY job_id, stage ORDER BY ts DESC, event_id DESC) = 1""")
def R2_R3_stage_timings_stream(spark, d):
    """A stream of updates, some repeated and some late; only the stages of each job's newest run are kept."""
    e = F.col("event_id")
    stage = F.get(F.array(F.lit("check"), F.lit("audio"), F.lit("speech")), (e % 3).cast("int"))
    u = fx.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.floor(e / 2500).alias("run_id"), stage.alias("stage"), F.col("ts").cast("timestamp").alias("ts"), e, ((e % 500) / F.lit(500.0)).alias("fraction"))
    told = u.withColumn("piece", e % 3).unionByName(u.where(e % 5 == 0).withColumn("piece", (e + 1) % 3))
    folder = state.run_in_pieces(told, 3, "piece", state.stage_timings, ["job_id", "stage"])
    newest = state.newest(spark, folder, state.TIMINGS, ["job_id", "stage"])
    last = newest.groupBy("job_id").agg(F.max("run_id").alias("run_id"))
    return newest.join(last, ["job_id", "run_id"]).select("job_id", "run_id", "stage", "event_id", "fraction")


@query("""SELECT queue, job, state FROM (SELECT user_id AS queue, 'j' || event_id AS job, CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' WHEN 2 THEN 'completedWithWarnings' ELSE 'cancelled' END AS state FROM events)""")
def R4_job_states(spark, d):
    """Each queue adds, inspects and settles its jobs, begins, and starts and ends one after another."""
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("queue"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"), F.count("*").over(Window.partitionBy("user_id")).alias("all"))
    name, k = F.concat(F.lit("j"), F.col("event_id").cast("string")), F.col("event_id") % 4
    end = F.when(k == 0, "fail").when(k == 3, "cancel").otherwise("finish")
    row = lambda seq, event, job=name, detail=None: F.struct(seq.cast("long").alias("seq"), (event if not isinstance(event, str) else F.lit(event)).alias("event"), job.alias("job"), (F.lit(detail).cast("string") if detail is None or isinstance(detail, str) else detail).alias("detail"))
    first, then = 4 * (F.col("n") - 1), 4 * F.col("all") + 1 + 2 * (F.col("n") - 1)
    rows = [row(first, "add"), row(first + 1, "inspect"), row(first + 2, "inspected", detail=F.when(k == 1, "undecided").otherwise("matched")), row(first + 3, "decide"), row(then, "start"), row(then + 1, end, detail=F.when(k == 1, "saved").when(k == 2, "partly"))]
    begin = F.when(F.col("n") == 1, F.array(row(4 * F.col("all"), "begin", F.lit(None).cast("string")))).otherwise(F.array().cast("array<struct<seq:long,event:string,job:string,detail:string>>"))
    events = e.select("queue", F.explode(F.concat(F.array(*rows), begin)).alias("x")).select("queue", "x.*")
    changes = state.replay(events)
    return changes.groupBy("queue", "job").agg(F.max_by("state", "seq").alias("state"))


@query("""WITH i AS (SELECT 'n' || doc_id AS name, doc_id % 61 <> 0 AS a, doc_id % 67 <> 0 AS b, doc_id % 71 <> 0 AS c, doc_id % 73 = 0 AS twice, doc_id % 79 = 0 AS other FROM documents)
SELECT name, 'missing:lock' AS issue FROM i WHERE NOT a AND (b OR c) UNION ALL SELECT name, 'missing:listed' FROM i WHERE NOT b AND (a OR c) UNION ALL SELECT name, 'missing:bill' FROM i WHERE NOT c AND (a OR b)
UNION ALL SELECT name, 'duplicate:listed' FROM i WHERE b AND twice UNION ALL SELECT name, 'versionMismatch' FROM i WHERE c AND other AND (a OR b)""")
def J9_reconcile_three_way(spark, d):
    docs, k = _docs(spark, d), F.col("doc_id")
    item = lambda rows, version="1": rows.select(F.concat(F.lit("n"), k.cast("string")).alias("name"), F.lit(version).alias("version") if isinstance(version, str) else version.alias("version"))
    listed = docs.where(k % 67 != 0)
    bill = item(docs.where(k % 71 != 0), F.when(k % 79 == 0, "2").otherwise("1"))
    return policy.three_way(item(docs.where(k % 61 != 0)), item(listed.unionByName(listed.where(k % 73 == 0))), bill)


@query("""WITH c AS (SELECT doc_id AS place, 'n-' || (doc_id // 2 * 2) AS name, doc_id % 2 = 1 AND doc_id % 3 <> 0 AS again, doc_id // 2 * 2 AS k, doc_id FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY place) AS nth, k % 11 = 0 AS unlocked, doc_id % 13 = 0 AS v, doc_id % 17 = 0 AS r, doc_id % 19 = 0 AS h, doc_id % 23 = 0 AS l FROM c)
SELECT place, name, 'duplicateComponent' AS issue FROM f WHERE nth > 1 UNION ALL SELECT place, name, 'notLocked' FROM f WHERE nth = 1 AND unlocked
UNION ALL SELECT place, name, unnest(list_filter([CASE WHEN v THEN 'versionMismatch' END, CASE WHEN r THEN 'referenceMismatch' END, CASE WHEN v OR h THEN 'hashNotLocked' END, CASE WHEN l THEN 'licenseMismatch' END], lambda x: x IS NOT NULL)) FROM f WHERE nth = 1 AND NOT unlocked""")
def J9_bill_issues(spark, d):
    """Names in pairs of documents, written in two ways; some aren't locked, or have another version, reference, hash or
    license."""
    k = F.col("doc_id")
    even = F.floor(k / 2) * 2
    docs = _docs(spark, d).select("doc_id", even.alias("k"))
    key, text = F.col("k").cast("string"), lambda x: F.lit(x)
    lock = docs.where((k % 2 == 0) & (k % 11 != 0)).select(F.concat(text("n-"), key).alias("name"), text("1").alias("version"), F.array(F.concat(text("a"), key), F.concat(text("b"), key)).alias("hashes"))
    listed = docs.where(k % 2 == 0).select(F.concat(text("n."), key).alias("name"), text("MIT").alias("license"))
    version = F.when(k % 13 == 0, "2").otherwise("1")
    purl = F.concat(text("pkg:pypi/n-"), key, text("@"), version)
    bill = docs.where((k % 2 == 0) | (k % 3 != 0)).select(
        k.alias("place"), F.concat(F.when(k % 4 == 0, "N__").otherwise("n-"), key).alias("name"), version.alias("version"), purl.alias("purl"), F.when(k % 17 != 0, purl).alias("ref"),
        F.when(k % 19 == 0, F.array(F.concat(text("a"), key), F.concat(text("b"), key))).otherwise(F.array(F.concat(text("b"), key))).alias("hashes"), F.when(k % 23 != 0, F.array(text("MIT"))).alias("licenses"),
    )
    return policy.bill_issues(lock, listed, bill)


@query(CUES + r""", g AS (SELECT *, row_number() OVER (PARTITION BY media_id, lang ORDER BY ordinal) AS n FROM cues),
p AS (SELECT *, lag(CASE WHEN NOT bad THEN e END) OVER (PARTITION BY media_id, lang ORDER BY ordinal) AS le FROM g),
q AS (SELECT media_id, lang, n AS ordinal, CASE WHEN coalesce(regexp_matches(text, '^\s*$'), true) THEN 'cueMissingText' WHEN cue_index <> n THEN 'invalidNumbering' WHEN bad OR e <= s OR s < coalesce(le, 0) THEN 'invalidTimestamps' END AS fault FROM p),
f AS (SELECT media_id, lang, ordinal, fault FROM q WHERE fault IS NOT NULL QUALIFY row_number() OVER (PARTITION BY media_id, lang ORDER BY ordinal) = 1),
l AS (SELECT DISTINCT media_id, lang FROM cues)
SELECT media_id, lang, CASE WHEN media_id % 7 > 3 THEN ordinal END AS ordinal, CASE media_id % 7 WHEN 0 THEN 'emptyFile' WHEN 1 THEN 'invalidUTF8' WHEN 2 THEN 'noCues' WHEN 3 THEN 'emptyFile' ELSE fault END AS fault FROM l LEFT JOIN f USING (media_id, lang) WHERE media_id % 7 <= 3 OR fault IS NOT NULL""")
def F5_validate_srt(spark, d):
    """Documents as bytes; some are null, empty, blank or no UTF-8."""
    docs, k = timeline.srt_documents(fx.flawed(timeline.cues(fx.segments(spark, d)))), F.col("media_id") % 7
    raw = F.col("document").cast("binary")
    broken = F.when(k == 0, F.lit(b"")).when(k == 1, F.concat(raw, F.lit(b"\xff"))).when(k == 2, F.lit(b" \r\n\r\n\t")).when(k == 3, F.lit(None)).otherwise(raw)
    return timeline.first_fault(docs.withColumn("document", broken))


@query(CUES + """, d AS (SELECT media_id, lang, string_agg(cue_index::VARCHAR || chr(10) || timing || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) || chr(10) AS document FROM cues GROUP BY media_id, lang)
SELECT media_id, lang, CASE WHEN media_id % 3 = 1 THEN 'conflict' WHEN media_id % 3 = 2 THEN 'replace' ELSE 'create' END AS action, CASE WHEN media_id % 3 = 1 THEN 'old' || chr(10) ELSE document END AS document FROM d""")
def S7_S9_publish_files(spark, d):
    """Two thirds of the outputs have a file, and half of those aren't as they were approved; then what is published is read."""
    documents = stored(timeline.srt_documents(fx.flawed(timeline.cues(fx.segments(spark, d)))))
    folder = f"{scratch_dir(spark)}/published"
    old = documents.where("media_id % 3 <> 0").withColumn("document", F.lit("old\n"))
    outputs.publish(old, old.select("media_id", "lang", F.lit(None).cast("string").alias("sha")), folder)
    approved = outputs.fingerprints(spark, folder).withColumn("sha", F.when(F.col("media_id") % 3 == 2, F.col("sha")).otherwise("another"))
    plan = outputs.publish(documents, approved, folder)
    return plan.join(outputs.read_documents(spark, folder), ["media_id", "lang"])
