"""Streams over text files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def through_stream(spark: SparkSession, lines: DataFrame, transform) -> DataFrame:
    """transform(lines) as a stream: lines are written as text files, read as a stream until all are taken, and
    the results written in append mode, all below
    spark.checkpoint.dir."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    lines.select("value").write.text(f"{root}/lines")
    out = transform(spark.readStream.schema("value string").text(f"{root}/lines"))
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def staged(spark: SparkSession, rows: DataFrame, pieces: int, order: str) -> tuple[DataFrame, str]:
    """(stream, folder): rows as a stream of files, a piece after the other in the given order, one each micro-batch."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    for k in range(pieces):
        rows.where(F.pmod(F.col(order), F.lit(pieces)) == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), root
