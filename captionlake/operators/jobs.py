"""Media, languages, manifests and queues as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_S, BASE_BYTES, BYTES_PER_S = 12 * 3600, 1 << 30, 32_100


def check_language(jobs: DataFrame, selected: str = "lang") -> DataFrame:
    """jobs with decision: is the detected language sure enough, and is it the selected one? Without a code or a
    confidence the detection failed; without a runner-up it isn't sure."""
    sure = (F.col("confidence") >= 80) & (F.col("confidence") - F.col("runner_up") >= 20)
    return jobs.withColumn("decision", F.when(F.col("code").isNull() | F.col("confidence").isNull(), "failed").when(~F.coalesce(sure, F.lit(False)), "lowConfidence").when(F.col("code") == F.col(selected), "matched").otherwise("mismatch"))


def admit_media(media: DataFrame) -> DataFrame:
    """Media of at most 12 hours, with the workspace they need."""
    need = F.lit(BASE_BYTES) + 2 * F.ceil(F.col("duration_ms") * BYTES_PER_S / 1000)
    return media.where((F.col("duration_ms") > 0) & (F.col("duration_ms") <= LONGEST_S * 1000)).withColumn("workspace_bytes", need.cast("long"))


def reconcile(expected: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """Paths that are missing, extra or changed."""
    e, a = expected.select(key, F.col("sha").alias("want"), F.lit(1).alias("e")), actual.select(key, F.col("sha").alias("have"), F.lit(1).alias("a"))
    both = e.join(a, key, "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(~F.col("want").eqNullSafe(F.col("have")), "changed")
    return both.select(key, state.alias("state")).where("state is not null")


def first_of(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key, in the given order; of rows with equal order any one. A partial minimum by key, so that a
    common key isn't one task's window."""
    first = rows.groupBy(key.alias("first_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("x"))
    return first.select("x.*")


def latest(updates: DataFrame, keys: list[str], time: str, id_col: str) -> DataFrame:
    """Newest update of each key; ties go to the larger id."""
    newest = F.max(F.struct(F.col(time), F.col(id_col), F.col("fraction"))).alias("x")
    return updates.groupBy(keys).agg(newest).select(*keys, F.col(f"x.{id_col}").alias(id_col), F.col("x.fraction").alias("fraction"))


def active_runs(updates: DataFrame) -> DataFrame:
    """Updates of each job's newest run; those of runs that were replaced go. A partial maximum, then a join."""
    newest = updates.groupBy("job_id").agg(F.max("run_id").alias("run_id"))
    return updates.join(newest, ["job_id", "run_id"], "left_semi")
