"""Whole transcripts and jobs: validation, what a target's outputs come to, names of outputs, the queue's states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import output_name
from ..functions.texts import is_blank, language_code
from .issues import keys_of
from .tables import stored

PLANNING = ("timingCapacityExceeded", "timingWindowInsufficient")
FINAL_TIMING = ("cueTooShort", "cueTooLong", "readingSpeedExceeded")


def review_warnings(issues: DataFrame) -> DataFrame:
    """(keys, n_review) of issues with severity, code and unit_id: warnings of the outputs, plus units with a planning
    warning that no final timing warning of the same output tells of, plus planning warnings without a unit. Outputs without
    issues have no row."""
    keys = keys_of(issues)
    warns = issues.where("severity = 'warning'").withColumn("planned", F.col("code").isin(*PLANNING))
    final = F.col("code").isin(*FINAL_TIMING)
    by_unit = warns.groupBy(*keys, "unit_id").agg(F.count_if(~F.col("planned")).alias("outputs"), F.count_if("planned").alias("plans"), F.bool_or(final).alias("told"))
    planned = F.when(F.col("unit_id").isNull(), F.col("plans")).when((F.col("plans") > 0) & ~F.col("told"), 1).otherwise(0)
    return by_unit.groupBy(*keys).agg(F.sum(F.col("outputs") + planned).alias("n_review"))


def target_status(targets: DataFrame, faults: DataFrame, issues: DataFrame, saves: DataFrame) -> DataFrame:
    """(media_id, lang, status) of every target: invalidTranslation if its translations have faults, invalidLayout if its
    cues have errors, saveFailed where the destination was a conflict or isn't known, else saved or savedWithWarnings. One
    target's failure doesn't touch another's."""
    key = ["media_id", "lang"]
    bad = faults.groupBy(key).agg(F.count("*").alias("n_faults"))
    told = issues.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    rows = targets.select(*key).distinct().join(bad, key, "left").join(told, key, "left").join(saves.groupBy(key).agg(F.max("action").alias("action"), F.bool_or(F.col("action") == "conflict").alias("conflict")), key, "left")
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    status = (
        F.when(some("n_faults"), "invalidTranslation").when(some("n_errors"), "invalidLayout").when(F.col("action").isNull() | F.col("conflict"), "saveFailed")
        .when(some("n_warnings"), "savedWithWarnings").otherwise("saved")
    )
    return rows.select(*key, status.alias("status"))


def _why(rank: int, fault: str) -> Column:
    return F.struct(F.lit(rank).alias("rank"), F.lit(fault).alias("fault"))


def validate_transcripts(transcripts: DataFrame, words: DataFrame, segments: DataFrame, units: DataFrame) -> DataFrame:
    """(media_id, fault, place) of transcripts that break a rule, by the first rule that fails: version, language, then the
    three lists in turn, each in its own order. transcripts: media_id, version, language; words: place, id, start, end,
    text, confidence; segments and units: place, id, start, end, text, word_start, word_end."""
    n_words = words.groupBy("media_id").agg(F.count("*").alias("n_words"))
    n = lambda rows, name: rows.groupBy("media_id").agg(F.lit(True).alias(name))
    heads = transcripts.join(n(words, "w"), "media_id", "left").join(n(segments, "s"), "media_id", "left").join(n(units, "u"), "media_id", "left")
    head = (
        F.when(F.coalesce(is_blank(F.col("version")), F.lit(True)), _why(0, "missingVersion"))
        .when(F.col("version") != "1", _why(1, "unsupportedVersion")).when(language_code(F.col("language")).isNull(), _why(2, "unsupportedLanguage"))
        .when(F.col("w").isNull(), _why(3, "missingWords")).when(F.col("s").isNull(), _why(4, "missingSegments"))
        .when(F.col("u").isNull(), _why(5, "missingSemanticUnits"))
    )
    none = F.lit(None).cast("long")
    faults = heads.select("media_id", head["rank"].alias("rank"), none.alias("place"), head["fault"].alias("fault")).where("fault is not null")

    def listed(rows, rank, fault, twice, ranged, no_id=lambda c: c == ""):
        order = Window.partitionBy("media_id").orderBy("place")
        finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
        seen = F.row_number().over(Window.partitionBy("media_id", "id").orderBy("place")) > 1
        rows = rows.withColumns({"last": F.coalesce(F.lag("end").over(order), F.lit(0.0)), "seen": seen})
        sound = finite("start") & finite("end") & (F.col("start") >= F.col("last")) & (F.col("start") >= 0) & (F.col("end") > F.col("start")) & ~no_id(F.col("id")) & ~is_blank(F.col("text"))
        if "confidence" in rows.columns:
            sound = sound & (F.col("confidence").isNull() | (finite("confidence") & F.col("confidence").between(0, 1)))
        why = F.when(~F.coalesce(sound, F.lit(False)), fault).when(F.col("seen"), twice)
        if ranged:
            rows = rows.join(n_words, "media_id", "left")
            within = (F.col("word_start") >= 0) & (F.col("word_end") > F.col("word_start")) & (F.col("word_end") <= F.col("n_words"))
            why = why.when(~F.coalesce(within, F.lit(False)), ranged)
        return rows.select("media_id", F.lit(rank).alias("rank"), "place", why.alias("fault")).where("fault is not null")

    faults = faults.unionByName(listed(words, 6, "invalidWord", "invalidWord", None)).unionByName(listed(segments, 7, "invalidSegment", "invalidSegment", "invalidSegment"))
    faults = faults.unionByName(listed(units, 8, "invalidSemanticUnit", "duplicateSemanticUnitID", "invalidSemanticUnitWordRange", is_blank))
    first = faults.groupBy("media_id").agg(F.min(F.struct("rank", "place", "fault")).alias("x"))
    return first.select("media_id", "x.fault", "x.place")


def assign_output_names(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, path, lang; job_id is the queue's order) with output: <stem>.<lang>.srt, where an earlier job has that
    <stem>.<ext>.<lang>.srt, else the first name with -2, -3, ... before .srt that is free. Names are compared in lower
    case.

    Each round, the earliest claim to a name stands and the later ones move on; jobs that share their numbers then line up
    in the queue's order, each at least one past the one before. So rounds are few, whatever the number of jobs of one name; they
    end, since a job that moves only ever moves on, and the earliest claim of those that are left always stands."""
    base = output_name(F.col("path"), F.col("lang"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = F.regexp_replace(base, r"\.srt$", "")
    qualified = F.concat(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit("."), ext, F.lit("."), F.col("lang"), F.lit(".srt"))
    plain = F.when(F.col("try") == 1, qualified).otherwise(F.concat(named, F.lit("-"), F.col("try").cast("string"), F.lit(".srt")))
    output = F.when(F.col("try") == 0, base).otherwise(plain)
    now = stored(jobs.select("job_id", "path", "lang", F.lit(0).alias("try")).withColumn("output", output))
    while True:
        first = now.groupBy(F.lower("output").alias("name")).agg(F.min("job_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("name", "owner")
        claims = now.join(first, F.lower("output") == F.col("name"))
        moves = stored(claims.where("job_id <> owner").select("job_id", F.lit(True).alias("moves")))
        if not moves.limit(1).count():
            return now.select("job_id", "path", "lang", "output")
        # a job's names: 0, then 1 where there is an extension, then 2, 3, ...
        on = F.when(F.col("try") == 0, F.when(ext != "", 1).otherwise(2)).otherwise(F.col("try") + 1)
        moved = now.join(moves, "job_id", "left").select("job_id", "path", "lang", F.when(F.col("moves"), on).otherwise(F.col("try")).alias("try"))
        # jobs that share their numbers take them in the queue's order, so each stands at least one past the one before
        numbered = Window.partitionBy(F.lower(named), F.col("try") >= 2).orderBy("job_id")
        moved = moved.withColumn("nth", F.row_number().over(numbered))
        reach = F.max(F.col("try") - F.col("nth")).over(numbered.rowsBetween(Window.unboundedPreceding, 0)) + F.col("nth")
        now = stored(moved.withColumn("try", F.when(F.col("try") >= 2, reach).otherwise(F.col("try")).cast("int")).drop("nth").withColumn("output", output))
