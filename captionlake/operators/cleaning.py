"""Cleaning of recogniser segments: every rule is a window or a filter over all media at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_SPEECH, LOW_LOGPROB, HIGH_RATIO = 0.6, -1.0, 2.4


def judge_segments(segments: DataFrame) -> DataFrame:
    """segments with reason: why a segment goes, or null. Times are clamped to 0 first, NaN with them; times that are null
    or infinite reject. A metric that is null, NaN or infinite isn't known and never rejects."""
    time = lambda c: F.when(F.isnan(F.col(c).cast("double")), F.lit(0)).otherwise(F.greatest(c, F.lit(0)))
    endless = lambda c: F.col(c).cast("double") == float("inf")
    known = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    start, end = time("start_ms"), time("end_ms")
    unsure = known("avg_logprob") < LOW_LOGPROB
    # a null start would be clamped away by greatest
    nothing = F.col("start_ms").isNull() | F.col("end_ms").isNull()
    reason = (
        F.when(nothing | endless("start_ms") | endless("end_ms") | (end <= start), "invalid_timestamp")
        .when(F.coalesce((known("no_speech_prob") > NO_SPEECH) & unsure, F.lit(False)), "no_speech")
        .when(F.coalesce((known("compression_ratio") > HIGH_RATIO) & unsure, F.lit(False)), "low_confidence_repetition")
    )
    return segments.withColumns({"start_ms": start, "end_ms": end, "reason": reason})


def clamp_overlaps(segments: DataFrame) -> DataFrame:
    """Starts moved to the end of all earlier segments; what doesn't reach past them gets reason
    fully_overlapped. One window by media."""
    before = Window.partitionBy("media_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest("start_ms", F.coalesce(F.max("end_ms").over(before), F.lit(0)))
    moved = segments.withColumn("new_start", start)
    return moved.select(
        "media_id", "seg_idx", "text", F.col("new_start").alias("start_ms"), "end_ms", (F.col("new_start") > F.col("start_ms")).alias("start_adjusted"),
        F.when(F.col("end_ms") <= F.col("new_start"), "fully_overlapped").alias("reason"),
    )


def report(judged: DataFrame) -> DataFrame:
    """Counts by media, and whether so many went that the result needs a look."""
    n = lambda r: F.count_if(F.col("reason") == r)
    removed = F.count("reason")
    return judged.groupBy("media_id").agg(
        F.count("*").alias("n_input"), removed.alias("n_removed"), n("invalid_timestamp").alias("n_invalid"), n("no_speech").alias("n_no_speech"),
        n("low_confidence_repetition").alias("n_repetition"),
        (removed >= F.greatest(F.lit(5), F.ceil(F.count("*") * 5 / 100))).alias("quality_warning"),
    )


def number_words(per: DataFrame) -> DataFrame:
    """Word ranges [word_start, word_end) of segments, words numbered over the media. per: (media_id, seg_idx, n)."""
    w = Window.partitionBy("media_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n").over(w)
    return per.select("media_id", "seg_idx", (end - F.col("n")).alias("word_start"), end.alias("word_end"))
