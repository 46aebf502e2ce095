"""Joins and roll-ups around a job: sources, ranges of words, publishing, manifests, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import PROFILES
from ..functions.texts import is_blank
from .cleaning import LOW_LOGPROB
from .speech import words_tell

EVIDENCE_ROWS, EVIDENCE_CHARS, EVIDENCE_WORDS = 100, 2000, 64


def not_clean(segments: DataFrame) -> DataFrame:
    """Segments that break what cleaning promises: finite times from 0 on, end after start, no overlap, some text. A null
    time or text breaks it too."""
    before = F.lag("end_ms").over(Window.partitionBy("media_id").orderBy("seg_idx"))
    finite = lambda c: ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    good = finite("start_ms") & finite("end_ms") & (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")) & ~is_blank(F.col("text"))
    apart = F.coalesce(F.col("start_ms") >= F.col("before"), F.lit(True)) | F.isnan(F.col("before").cast("double"))
    return segments.withColumn("before", before).where(~F.coalesce(good & apart, F.lit(False))).drop("before")


def with_profile(rows: DataFrame) -> DataFrame:
    """rows with the reading limits of their language, null where it has none. The profiles are ten fixed rows, so they are
    broadcast."""
    limits = rows.sparkSession.createDataFrame(PROFILES, "lang string, chars_per_line int, chars_per_s double, least_s double")
    return rows.join(F.broadcast(limits), "lang", "left")


def words_in_units(units: DataFrame, words: DataFrame) -> DataFrame:
    """Words with word_start <= word_idx < word_end, as an equi-join on each unit's own word numbers. A range is cut to the
    words that its media has, so one that is corrupt is no longer than they are; null and empty ones hold no word."""
    known = words.groupBy("media_id").agg(F.min("word_idx").alias("least"), F.max("word_idx").alias("most"))
    start, last = F.greatest("word_start", "least"), F.least(F.col("word_end") - F.when(F.col("word_end") > F.col("least"), 1), F.col("most"))
    cut = units.where(F.col("word_end") > F.col("word_start")).join(known, "media_id").select("media_id", "unit_id", start.alias("start"), last.alias("last")).where("start <= last")
    return cut.select("media_id", "unit_id", F.explode(F.sequence("start", "last")).alias("word_idx")).join(words, ["media_id", "word_idx"])


def past_media_end(cues: DataFrame, media: DataFrame) -> DataFrame:
    """Cues that end after the media does; media without a positive finite duration are left out."""
    known = media.where((F.col("duration_s") > 0) & (F.col("duration_s") < float("inf")))
    limit = F.floor(F.col("duration_s") * 1000)
    return cues.join(known.select("media_id", limit.alias("limit_ms")), "media_id").where("end_ms > limit_ms").withColumn("over_ms", F.col("end_ms") - F.col("limit_ms"))


def match_by_position(units: DataFrame, texts: DataFrame) -> DataFrame:
    """(media_id, unit_id, translated, issue): the n-th text for the n-th unit of a media. Where a media's counts differ, its
    units get what texts there are, one row without a unit says translationCountMismatch, and a unit without a text
    missingTranslation. One grouping by place takes the part of the join."""
    place = lambda rows, by: F.row_number().over(Window.partitionBy("media_id").orderBy(*by)).alias("place")
    none = F.lit(None).cast("string")
    u = units.select("media_id", place(units, ["unit_id"]), F.lit(True).alias("is_unit"), "unit_id", none.alias("text"))
    t = texts.select("media_id", place(texts, ["unit_id", "ord"]), F.lit(False).alias("is_unit"), F.lit(None).cast("long").alias("unit_id"), F.col("text"))
    both, media = u.unionByName(t), Window.partitionBy("media_id")
    n = lambda f: F.count_if(f).over(media)
    rows = both.withColumns({"n_units": n(F.col("is_unit")), "n_texts": n(~F.col("is_unit"))})
    told = F.lead("text").over(media.orderBy("place", F.desc("is_unit"))), F.lead("is_unit").over(media.orderBy("place", F.desc("is_unit")))
    rows = rows.withColumns({"next": told[0], "next_is_unit": told[1]})
    has = F.col("next_is_unit").eqNullSafe(False) & (F.col("place") <= F.col("n_texts"))
    pairs = rows.where("is_unit").select("media_id", "unit_id", F.when(has, F.col("next")).alias("translated"), F.when(~has, "missingTranslation").alias("issue"))
    wrong = rows.where((F.col("place") == 1) & (F.col("n_units") != F.col("n_texts"))).select("media_id").distinct()
    return pairs.unionByName(wrong.select("media_id", F.lit(None).cast("long").alias("unit_id"), none.alias("translated"), F.lit("translationCountMismatch").alias("issue")))


def discard_evidence(removed: DataFrame) -> DataFrame:
    """The first removed rows of each media, with shortened texts, and how many more there were; where rows have `words`, an
    array, its first ones too (null for null). The limits are the feature: they bound what a report carries."""
    whole = Window.partitionBy("media_id")
    ranked = removed.withColumns({"place": F.row_number().over(whole.orderBy("seg_idx")), "n": F.count("*").over(whole)})
    more = F.greatest(F.col("n") - EVIDENCE_ROWS, F.lit(0))
    words = [F.slice("words", 1, EVIDENCE_WORDS).alias("words")] if "words" in removed.columns else []
    return ranked.where(F.col("place") <= EVIDENCE_ROWS).select("media_id", "seg_idx", "reason", F.substring("text", 1, EVIDENCE_CHARS).alias("text"), *words, more.alias("n_omitted"))


def timeline_report(kept: DataFrame) -> DataFrame:
    """(media_id, n_kept, retained_low_confidence, synthetic_word_timing, quality_warning) of kept segments with text,
    start_ms, end_ms, avg_logprob and words (text, start_ms, end_ms, probability): how many are unsure (a metric that is
    null or not finite isn't), and how many have words that don't tell their text in order inside them (see
    speech.usable_words; no words are none). Either asks for a look. A media without kept segments has no row."""
    logprob = F.col("avg_logprob").cast("double")
    unsure = F.coalesce(~F.isnan(logprob) & (F.abs(logprob) < float("inf")) & (logprob < LOW_LOGPROB), F.lit(False))
    words = F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["start_ms"].cast("double").alias("start"), w["end_ms"].cast("double").alias("end"), w["probability"].cast("double").alias("probability")))
    rows = kept.select("media_id", unsure.alias("unsure"), words_tell(F.col("text"), F.col("start_ms"), F.col("end_ms"), words).alias("told"))
    n = lambda c: F.count_if(c)
    both = rows.groupBy("media_id").agg(F.count("*").alias("n_kept"), n(F.col("unsure")).alias("retained_low_confidence"), n(~F.col("told")).alias("synthetic_word_timing"))
    return both.withColumn("quality_warning", (F.col("retained_low_confidence") > 0) | (F.col("synthetic_word_timing") > 0))


def duration_of(*parts: DataFrame) -> DataFrame:
    """The latest end of any word, segment or unit of a media."""
    ends = parts[0].select("media_id", "end_ms")
    for p in parts[1:]:
        ends = ends.unionByName(p.select("media_id", "end_ms"))
    return ends.groupBy("media_id").agg(F.greatest(F.max("end_ms"), F.lit(0)).alias("duration_ms"))


def first_speaker(words: DataFrame, group: Column) -> DataFrame:
    """The first known speaker of each group of words."""
    return words.groupBy("media_id", group.alias("group_id")).agg(F.min_by("speaker", F.when(F.col("speaker").isNotNull(), F.col("word_idx"))).alias("speaker"))


def required_pairs(jobs: DataFrame) -> DataFrame:
    """Distinct language pairs that open jobs need."""
    opened = jobs.where(F.col("state").isin("runnable", "waiting", "running"))
    return opened.select("source", F.explode("targets").alias("target")).where("source <> target").distinct()


def queue_readiness(jobs: DataFrame) -> DataFrame:
    """Can a queue begin: nothing runs, is inspected or waits for a language decision, and something is runnable."""
    has = lambda s: F.bool_or(F.col("state") == s)
    return jobs.groupBy("queue").agg((~has("running") & ~has("inspecting") & ~has("undecided") & has("runnable")).alias("can_begin"))


def job_rollup(targets: DataFrame) -> DataFrame:
    """A job's state from its targets': a failed one makes it completedWithWarnings; none saved, failed."""
    saved, failed = F.count_if(F.col("saved")), F.count_if(~F.col("saved"))
    state = F.when(saved == 0, "failed").when(failed > 0, "completedWithWarnings").otherwise("completed")
    return targets.groupBy("job_id").agg(saved.alias("n_saved"), F.count("*").alias("n_total"), state.alias("state"))


def plan_publish(approved: DataFrame, current: DataFrame) -> DataFrame:
    """What to do with each destination: create where it was and is absent, replace where it is as it was
    approved, else a conflict; nothing is overwritten."""
    now = current.select("path", F.col("sha").alias("now"))
    then, have = F.col("sha"), F.col("now")
    action = F.when(then.isNull() & have.isNull(), "create").when(then == have, "replace").otherwise("conflict")
    return approved.join(now, "path", "left").select("path", action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Rows of new replace those of old with the same key; among several in new the last by seq counts."""
    cols = [c for c in new.columns if c != "seq"]
    both = old.select(*cols, F.lit(-1).cast("long").alias("seq")).unionByName(new.select(*cols, F.col("seq").cast("long")))
    newest = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in cols if c != key]), "seq").alias("x"))
    return newest.select(key, "x.*")


def probe(descriptions: DataFrame, longest_s: float = 43_200.0) -> DataFrame:
    """Duration of media from JSON descriptions (numbers may be strings), or why there is none."""
    schema = "streams array<struct<codec_type:string,duration:string>>, format struct<duration:string>"
    parsed = descriptions.withColumn("j", F.from_json("description", schema))
    seconds = F.coalesce(F.expr("try_cast(j.format.duration AS double)"), F.expr("array_max(transform(j.streams, s -> try_cast(s.duration AS double)))"))
    audio = F.exists("j.streams", lambda s: s["codec_type"] == "audio")
    out = parsed.withColumns({"seconds": seconds, "audio": F.coalesce(audio, F.lit(False))})
    problem = (
        F.when(F.col("j").isNull() | F.col("j.streams").isNull(), "invalidDescription").when(~F.col("audio"), "noAudioTrack")
        .when(F.col("seconds").isNull() | (F.col("seconds") <= 0), "durationUnavailable").when(F.col("seconds") > longest_s, "overLimit")
    )
    return out.withColumn("problem", problem).drop("j", "audio", "description")
