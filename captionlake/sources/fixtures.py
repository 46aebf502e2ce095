"""Views over the given tables in the shapes of a subtitle pipeline's inputs (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, lang, i, t, prev): the lines of every document with their place."""
    split = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), "lang", F.split("text", "\n").alias("ls"))
    out = split.select("media_id", "lang", "ls", F.posexplode("ls").alias("p", "t"))
    return out.select("media_id", "lang", F.col("p").cast("long").alias("i"), "t", F.when(F.col("p") > 0, F.get("ls", F.col("p") - 1)).alias("prev"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw recogniser segments with their metrics; times in milliseconds, as start_ms and end_ms."""
    d, i = F.col("media_id"), F.col("i")
    back = (i > 0) & ((3 * d + i) % 17 == 0)
    text = F.when(back, F.col("prev")).when((d + i) % 13 == 0, F.concat("t", F.repeat(F.lit(" income"), 12))).otherwise(F.col("t"))
    start = 3000 * i + (7 * d + 13 * i) % 700 - F.when(((d + i) % 11 == 0) | ((3 * d + i) % 17 == 0), 2900).otherwise(0)
    length = F.when((d + i) % 37 == 0, 0).otherwise(400 + (3 * d + 29 * i) % 3600)
    rows = lines(spark, sf_dir).select("media_id", i.alias("seg_idx"), "lang", text.alias("text"), start.alias("start_ms"), length.alias("len"))
    d, i = F.col("media_id"), F.col("seg_idx")
    return rows.select(
        "media_id", "seg_idx", "lang", "text", "start_ms", (F.col("start_ms") + F.col("len")).alias("end_ms"),
        (-((5 * d + 7 * i) % 15) / F.lit(10.0)).alias("avg_logprob"), ((10 + (11 * d + 3 * i) % 20) / F.lit(10.0)).alias("compression_ratio"),
        (((13 * d + 17 * i) % 11) / F.lit(10.0)).alias("no_speech_prob"),
    )


def flawed(cues: DataFrame) -> DataFrame:
    """Cues in two languages, the second with a word in front and 7 ms later, with some wrong numbers and timings: none, an
    hour beyond all numbers, a third part, blanks around the times (which are allowed)."""
    after = F.create_map(*[F.lit(x) for pair in zip(("en", "de", "es", "fr"), ("de", "es", "fr", "en")) for x in pair])
    second = cues.withColumns({"lang": F.try_element_at(after, F.col("lang")), "text": F.concat(F.lit("bis "), F.col("text"))})
    both = cues.withColumn("more", F.lit(0)).unionByName(second.withColumn("more", F.lit(7)))
    k = F.col("media_id") + F.col("ordinal") - 1 + F.col("more")
    timing = (
        F.when(k % 73 == 0, "bad").when(k % 79 == 0, F.concat(F.lit("99999999999999"), F.col("timing"))).when(k % 83 == 0, F.concat("timing", F.lit(" --> "), F.substring("timing", 1, 12)))
        .when(k % 89 == 0, F.concat(F.lit(" "), F.replace("timing", F.lit(" --> "), F.lit("  --> ")), F.lit("\t "))).otherwise(F.col("timing"))
    )
    return both.withColumns({"cue_index": F.col("cue_index") + F.when(k % 71 == 0, 1).otherwise(0), "timing": timing}).drop("more")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units to caption: (media_id, lang, unit_id, text, start_ms, end_ms)."""
    d, i = F.col("media_id"), F.col("i")
    start = 3000 * i + (7 * d) % 700
    rows = lines(spark, sf_dir)
    return rows.select("media_id", "lang", i.alias("unit_id"), F.col("t").alias("text"), start.alias("start_ms"), (start + 800 + (3 * d + 29 * i) % 2600).alias("end_ms"))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, unit_id, ord, text): with missing, repeated, orphan, damaged and empty ones."""
    return own_translations(spark, sf_dir).drop("lang")


def own_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lang, the language of their unit."""
    u = units(spark, sf_dir)
    d, i = F.col("media_id"), F.col("unit_id")
    text = F.when((d + i) % 43 == 0, "  ").when((d + i) % 41 == 0, F.concat("text", F.lit("�"))).otherwise(F.col("text"))
    first = u.where((d + i) % 23 != 0).select("media_id", "lang", "unit_id", F.lit(0).cast("long").alias("ord"), text.alias("text"))
    again = u.where(((d + i) % 29 == 0) & ((d + i) % 23 != 0)).select("media_id", "lang", "unit_id", F.lit(1).cast("long").alias("ord"), F.concat("text", F.lit(" bis")).alias("text"))
    orphan = u.where((d + i) % 31 == 0).select("media_id", "lang", (i + 1_000_000).alias("unit_id"), F.lit(0).cast("long").alias("ord"), "text")
    return first.unionByName(again).unionByName(orphan)


#: Letters of other scripts in place of a to z, by language.
SCRIPTS = {"ja": "かきくけこさしすせそたちつてと日月火水木金土ラリルレ", "ko": "가나다라마바사아자차카타파하거너더러머버서어저처커터", "zh": "天地人你我他山水火木金土日月上中下大小多少書本學車馬"}


def outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(units, translations, targets, media) to render: each media in its own language and in one of another script, some
    units out of order or without a time, every third media without an end."""
    u = units(spark, sf_dir)
    d, i = F.col("media_id"), F.col("unit_id")
    other = F.get(F.array(*map(F.lit, SCRIPTS)), (d % 3).cast("int"))
    start = F.col("start_ms") + F.when((d + i) % 37 == 0, -4000).when((d + i) % 41 == 0, F.lit(float("nan"))).otherwise(0)
    timed = u.select("media_id", i.alias("place"), F.when((d + i) % 53 == 0, i - 1).otherwise(i).alias("unit_id"), start.alias("start_ms"), "end_ms")
    own = own_translations(spark, sf_dir).where("media_id IS NOT NULL")
    script = F.lit(None).cast("string")
    for lang, letters in SCRIPTS.items():
        script = F.when(other == lang, F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", letters)).otherwise(script)
    told = own.unionByName(own.withColumns({"lang": other, "text": F.when((d + i) % 2 == 0, F.replace(script, F.lit(" "), F.lit("、"))).otherwise(script)}))
    targets = u.select("media_id", "lang").distinct()
    ends = u.groupBy("media_id").agg(F.when(F.first(d) % 3 != 0, F.max("end_ms") - 300).alias("media_end_ms"))
    return timed, told, targets.unionByName(targets.withColumn("lang", other)), ends


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words of conversations: (media_id, word_idx, text, start_ms, end_ms, speaker)."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("media_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("speaker"),
        F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("ws"),
    )
    from pyspark.sql import Window

    before = Window.partitionBy("media_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    based = turns.withColumn("base", F.coalesce(F.sum(F.size("ws").cast("long")).over(before), F.lit(0)))
    out = based.select("media_id", "turn", "speaker", "base", F.posexplode("ws").alias("p", "w"))
    g = F.col("base") + F.col("p")
    start = 400 * g + 1300 * F.col("turn") + F.floor((g + F.col("media_id")) / 67) * 850
    return out.select("media_id", g.alias("word_idx"), F.col("w").alias("text"), start.alias("start_ms"), (start + 350).alias("end_ms"), "speaker")


# The same views for DuckDB, as WITH clauses.
SQL_LINES = """lines AS (SELECT media_id, lang, i, ls[i + 1] AS t, CASE WHEN i > 0 THEN ls[i] END AS prev FROM
  (SELECT doc_id AS media_id, lang, string_split(text, chr(10)) AS ls, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""
SQL_SEGMENTS = SQL_LINES + """, seg0 AS (SELECT media_id, i AS seg_idx, lang,
  CASE WHEN i > 0 AND (3 * media_id + i) % 17 = 0 THEN prev WHEN (media_id + i) % 13 = 0 THEN t || repeat(' income', 12) ELSE t END AS text,
  3000 * i + (7 * media_id + 13 * i) % 700 - CASE WHEN (media_id + i) % 11 = 0 OR (3 * media_id + i) % 17 = 0 THEN 2900 ELSE 0 END AS start_ms,
  CASE WHEN (media_id + i) % 37 = 0 THEN 0 ELSE 400 + (3 * media_id + 29 * i) % 3600 END AS len FROM lines),
segments AS (SELECT media_id, seg_idx, lang, text, start_ms, start_ms + len AS end_ms,
  -((5 * media_id + 7 * seg_idx) % 15) / 10::DOUBLE AS avg_logprob, (10 + (11 * media_id + 3 * seg_idx) % 20) / 10::DOUBLE AS compression_ratio,
  ((13 * media_id + 17 * seg_idx) % 11) / 10::DOUBLE AS no_speech_prob FROM seg0)"""
SQL_UNITS = SQL_LINES + """, units AS (SELECT media_id, lang, i AS unit_id, t AS text, 3000 * i + (7 * media_id) % 700 AS start_ms,
  3000 * i + (7 * media_id) % 700 + 800 + (3 * media_id + 29 * i) % 2600 AS end_ms FROM lines)"""
SQL_TRANSLATIONS = SQL_UNITS + """, tr AS (
  SELECT media_id, unit_id, 0::BIGINT AS ord, CASE WHEN (media_id + unit_id) % 43 = 0 THEN '  ' WHEN (media_id + unit_id) % 41 = 0 THEN text || chr(65533) ELSE text END AS text
    FROM units WHERE (media_id + unit_id) % 23 <> 0
  UNION ALL SELECT media_id, unit_id, 1, text || ' bis' FROM units WHERE (media_id + unit_id) % 29 = 0 AND (media_id + unit_id) % 23 <> 0
  UNION ALL SELECT media_id, unit_id + 1000000, 0, text FROM units WHERE (media_id + unit_id) % 31 = 0)"""
SQL_WORDS = r"""turns AS (SELECT conv_id AS media_id, turn::BIGINT AS turn, role AS speaker, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM conversations),
based AS (SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY media_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM turns),
w0 AS (SELECT media_id, turn, speaker, base + p AS word_idx, ws[p + 1] AS text FROM (SELECT *, unnest(range(len(ws))) AS p FROM based)),
words AS (SELECT media_id, word_idx, text, speaker, 400 * word_idx + 1300 * turn + ((word_idx + media_id) // 67) * 850 AS start_ms,
  400 * word_idx + 1300 * turn + ((word_idx + media_id) // 67) * 850 + 350 AS end_ms FROM w0)"""
