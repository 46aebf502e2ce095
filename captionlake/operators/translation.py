"""Calls of a user's translators in two rounds, with ids that are checked and targets that fail alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.texts import damage
from .tables import stored

Translator = Callable[[list[tuple[int, str]]], Iterable[tuple[int, str]]]
TARGET = ["media_id", "lang"]


def _answers(requests: DataFrame, translators: dict[str, Translator], batch: int) -> DataFrame:
    """(media_id, lang, asked, unit_id, text, problem): a row for each answer, asked being the first id of its call. A call
    that raises, or whose answers are no pairs of an id and a text, gives one row with a problem and no id."""

    kinds = StructType([requests.schema["media_id"], *(StructField(c, t) for c, t in (("lang", StringType()), ("asked", LongType()), ("unit_id", LongType()), ("text", StringType()), ("problem", StringType())))])
    told = to_arrow_schema(kinds)

    def call(lang, pairs):
        if lang not in translators:
            return [(None, None, "translationNotReady")]
        try:
            return [(int(i), None if t is None else str(t), None) for i, t in translators[lang](pairs)]
        except Exception as e:  # a row: one target's translator must not stop the others
            return [(None, None, type(e).__name__)]

    def run(batches):
        for b in batches:
            medias, langs, ids, texts = (b.column(c).to_pylist() for c in (*TARGET, "unit_id", "text"))
            rows, at = [], 0
            while at < len(ids):
                upto = at + 1
                while upto < min(at + batch, len(ids)) and (medias[upto], langs[upto]) == (medias[at], langs[at]):
                    upto += 1
                rows += [(medias[at], langs[at], ids[at], *r) for r in call(langs[at], list(zip(ids[at:upto], texts[at:upto])))]
                at = upto
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), told)] if rows else [pa.array([], f.type) for f in told], schema=told)

    dealt = requests.repartitionByRange(*TARGET, "unit_id").sortWithinPartitions(*TARGET, "unit_id")
    return dealt.select(*TARGET, "unit_id", "text").mapInArrow(run, kinds)


def translate_targets(units: DataFrame, targets: DataFrame, translators: dict[str, Translator], batch: int = 50) -> tuple[DataFrame, DataFrame]:
    """(translations, status) of units (media_id, lang, unit_id, text) for targets (media_id, lang).

    translations: (media_id, lang, unit_id, text), whole targets only. status: (media_id, lang, status, problem), a row for
    each target: copied where the media is in that language already, else translated, or failed with a problem.

    A translator takes at most `batch` (id, text) pairs of one target and answers with pairs, in any order. An unknown
    or repeated id, or an error, fails its target. What is missing or damaged is asked for once more, alone; then exactly
    one sound answer with its id must come, or the target fails. A copy with a damaged text fails too. Other targets go on.

    unit_id is unique in a media; repeated targets count once, ones with a null media or language, or of a media without
    units, are left out; a null text is sent as an empty one. The units of each target, the answers of both rounds and the
    status are written to scratch tables, so that a translator isn't called anew for each use of its answers. Rows are dealt by ranges of (media_id, lang,
    unit_id): a media of any size is many tasks' work."""
    sent = units.select("media_id", F.col("lang").alias("source"), F.col("unit_id").cast("long").alias("unit_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = targets.select(*TARGET).where("media_id is not null and lang is not null").distinct()
    every = stored(sent.join(wanted, "media_id"))
    own = F.col("lang").eqNullSafe(F.col("source"))
    requests = every.where(~own).drop("source")

    first = _answers(requests, translators, batch).groupBy(*TARGET, "unit_id").agg(F.count("*").alias("n"), F.min("text").alias("got"), F.max("problem").alias("problem"))
    asked = requests.withColumn("asked", F.lit(True))
    good = F.col("n").isNotNull() & damage(F.col("got")).isNull()
    both = stored(asked.join(first, [*TARGET, "unit_id"], "full_outer").withColumn("sound", good))
    known = F.coalesce("asked", F.lit(False))
    fault = F.when(F.col("problem").isNotNull(), F.col("problem")).when(~known, "unknownId").when(F.col("n") > 1, "repeatedId")
    broken = both.withColumn("fault", fault).where("fault is not null").groupBy(*TARGET).agg(F.min("fault").alias("fault"))
    going = both.where(known).join(broken, TARGET, "left_anti")
    open_ = going.where("not sound").select(*TARGET, "unit_id", "text")

    second = _answers(open_, translators, 1).withColumn("fits", F.col("unit_id").eqNullSafe(F.col("asked")))
    second = second.groupBy(*TARGET, F.col("asked").alias("unit_id")).agg(F.count("*").alias("n"), F.max("problem").alias("problem"), F.min("fits").alias("fits"), F.min("text").alias("got"))
    again = stored(open_.join(second, [*TARGET, "unit_id"], "left"))
    fault = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("n").isNull(), "missing").when((F.col("n") > 1) | ~F.col("fits"), "unknownId").otherwise(damage(F.col("got")))
    again = again.withColumn("fault", fault)
    copies = every.where(own).withColumn("fault", damage(F.col("text")))
    # one grouping tells a target's kind and what is wrong with it
    faults = broken.withColumn("copy", F.lit(False)).unionByName(again.where("fault is not null").select(*TARGET, "fault", F.lit(False).alias("copy")))
    told = every.select(*TARGET, F.lit(None).cast("string").alias("fault"), own.alias("copy")).unionByName(faults).unionByName(copies.where("fault is not null").select(*TARGET, "fault", F.lit(True).alias("copy")))
    status = told.groupBy(*TARGET).agg(F.min("fault").alias("problem"), F.max("copy").alias("copy"))
    kind = F.when(F.col("problem").isNotNull(), "failed").when(F.col("copy"), "copied").otherwise("translated")
    status = stored(status.select(*TARGET, kind.alias("status"), "problem"))

    done = going.where("sound").select(*TARGET, "unit_id", F.col("got").alias("text"))
    done = done.unionByName(again.where("fault is null").select(*TARGET, "unit_id", F.col("got").alias("text"))).unionByName(copies.select(*TARGET, "unit_id", "text"))
    return done.join(status.where("status = 'failed'"), TARGET, "left_anti"), status
