"""Helpers that the operators share: scratch tables, fixed-size bitmaps, column hygiene."""

from __future__ import annotations

import ctypes
import functools
import inspect
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors must share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _give_back() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f):
    """A task function (of batches, or of a group's table) that hands memory back when it is done."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(batches):
            yield from f(batches)
            _give_back()
    else:

        @functools.wraps(f)
        def run(table):
            out = f(table)
            if table.nbytes > 4_000_000:
                _give_back()
            return out

    return run


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared scratch folder and read it back."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have 1000 rows, where the session leaves that setting alone: texts can be long, and a batch is
    held by the executor and by its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many underscores after it as keep it apart from all columns, whatever their case."""
    low = {c.lower() for c in columns}
    while name.lower() in low:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that clash, whatever their case, with columns about to be added."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


class Bitmap:
    """A set of longs as 2**log2 bits. Its size is fixed, so it may be broadcast whatever it was built
    from; a set bit can be a false positive, so callers follow it with an exact join or comparison."""

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key], np.int64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.int64) & ((1 << self.log2) - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


MOST_BITS = 28  # log2: 32 MB


def bits_for(n: int) -> int:
    """log2 of the bits that a Bitmap of n keys should have: 16 a key, as far as MOST_BITS allows. Past that bound false
    positives grow, and with them what the exact join after the bitmap has to move; results stay the same."""
    return min(MOST_BITS, max(16, (16 * n).bit_length()))


def bitmap_of(df: DataFrame, key, log2: int = 23) -> Bitmap:
    """Build a Bitmap from a long column (use a hash: only the low log2 bits count). What reaches the
    driver is 2**log2 / 8 bytes at most."""
    at = F.col(key) if isinstance(key, str) else key
    low = at.bitwiseAND(F.lit((1 << log2) - 1)) + 1  # Spark's bitmap buckets count from 1
    rows = (
        df.select(low.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        .collect()
    )
    bits = np.zeros(max(1 << log2, 32768) // 8, np.uint8)
    for r in rows:
        bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return Bitmap(bits, log2)


def drop_rows(docs: DataFrame, gone: DataFrame, keys: dict) -> DataFrame:
    """docs without the rows whose keys are in gone. keys: columns of docs by the name that gone has for them; nulls
    equal nulls. Texts of rows outside a bitmap of the keys aren't shuffled."""
    spark = docs.sparkSession
    gone = gone.select(*keys).distinct()
    hashed = F.xxhash64(*[F.coalesce(F.hash(k), F.lit(0)) for k in keys], *keys)
    bits = spark.sparkContext.broadcast(bitmap_of(gone, hashed, bits_for(gone.count())))
    schema = docs.schema
    names = {k: fresh(f"key_{k}", docs.columns) for k in keys}
    keyed = docs.withColumns({names[k]: c for k, c in keys.items()})
    last = fresh("key_hash", keyed.columns)
    keyed = keyed.withColumn(last, F.xxhash64(*[F.coalesce(F.hash(names[k]), F.lit(0)) for k in keys], *names.values()))

    def mark(hit: bool):
        @lean
        def f(batches):
            import pyarrow as pa

            for b in batches:
                m = bits.value.test(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)) == hit
                yield b.filter(pa.array(m)).select(range(b.num_columns - (1 + len(names)) * (not hit)))

        return f

    sure = keyed.mapInArrow(mark(False), schema)
    unsure = keyed.mapInArrow(mark(True), keyed.schema)
    same = [unsure[names[k]].eqNullSafe(gone[k]) for k in keys]
    return sure.unionByName(unsure.join(gone, same, "left_anti").select(*docs.columns))
