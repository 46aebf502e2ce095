"""Sharding by proportional stratified interleaving (operator 4).

Rows of a source are ranked in a seeded pseudo-random order; rank r of n becomes the fraction (r - 0.5) / n;
all rows are put in the order of their fractions and that order is cut into equal runs. Each run then holds
every source in its share of the whole, to within two rows.

No window is taken over a whole source or over all rows. The random keys are spread evenly, so rows are first
dealt into ranges of the key; the ranges' counts (a small table) give the rank at which each range starts, and
only rows inside a range are ranked with each other. The same is done for the fractions. Texts aren't shuffled.

Nulls: a null source is a source of its own; a null text has 0 bytes and the CRC of the empty text; a null
doc_id is ranked by the key of its text. Repeated rows are separate rows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 20_000


def _ranges(n_rows: int) -> int:
    return max(1, -(-n_rows // ROWS_PER_RANGE))


def interleave(
    docs: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source"
) -> DataFrame:
    """(id, size, text_crc32, stratum, shard, slot): shard counts are at most one apart and every shard has
    each stratum in proportion."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the text is part of the key, so that rows with one id, or none, are spread as well
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(text).cast("string"))
    unit = F.conv(F.substring(F.md5(name), 1, 12), 16, 10)
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col(stratum_col).alias("stratum"),
        unit.cast("long").alias("key"),
    )
    total = docs.count()
    ranges = _ranges(total)
    width = -(-(1 << 48) // ranges)
    rows = rows.withColumn("range", F.expr(f"key div {width}"))

    # rank within the stratum: where the range starts, plus the rank inside the range
    counts = rows.groupBy("stratum", "range").agg(F.count("*").alias("here"))
    before = Window.partitionBy("stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("stratum").alias("s2"),
        F.col("range").alias("r2"),
        F.coalesce(F.sum("here").over(before), F.lit(0)).alias("start"),
        F.sum("here").over(Window.partitionBy("stratum")).alias("of"),
    )
    inside = Window.partitionBy("stratum", "range").orderBy("key", id_col, "text_crc32", "size")
    ranked = rows.withColumn("i", F.row_number().over(inside)).join(
        starts, F.col("stratum").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2"))
    )
    # (2 rank - 1) / (2 of) as a double; equal ones are ordered by key
    fraction = F.expr("cast((2 * (start + i) - 1) as double) / (2 * of)")
    placed = ranked.select(id_col, "size", "text_crc32", "stratum", "key", fraction.alias("f"))
    placed = placed.withColumn("slice", F.least(F.floor(F.col("f") * ranges), F.lit(ranges - 1)))

    # position in the order of all fractions, in the same two steps
    heights = placed.groupBy("slice").agg(F.count("*").alias("here"))
    below = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    floors = heights.select(F.col("slice").alias("sl2"), F.coalesce(F.sum("here").over(below), F.lit(0)).alias("floor"))
    order = Window.partitionBy("slice").orderBy("f", "key", id_col, "text_crc32", "size")
    at = F.col("floor") + F.row_number().over(order) - 1
    out = placed.join(floors, F.col("slice") == F.col("sl2")).withColumn("at", at)
    shard = F.expr(f"((at + 1) * {shards} - 1) div {max(total, 1)}")
    first = F.expr(f"(shard * {total}L) div {shards}")
    return out.withColumn("shard", shard.cast("int")).select(
        id_col, "size", "text_crc32", "stratum", "shard", (F.col("at") - first).cast("long").alias("slot")
    )
