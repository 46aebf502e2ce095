"""Nested JSON documents of timed text, lists of translations, and lines of progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import overall_progress

EVENT = "EVT\t"
ITEM = "struct<" + ",".join(f"{n}:string" for n in ("id", "index", "start", "end", "text", "word", "confidence", "probability", "word_start", "wordStart", "word_end", "wordEnd")) + ">"
MOST_BYTES = 64 << 20


#: The lists that a document must have, by the names they may have, and the reject code of one that hasn't.
LISTS = {"words": (("words",), "missingWords"), "segments": (("segments",), "missingSegments"), "semantic_units": (("semantic_units", "semanticUnits"), "missingSemanticUnits")}


def build_timelines(segments: DataFrame, units: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(media_id, document, too_large): one JSON document for each media, times in seconds; the three lists are always
    there. words: media_id, word_idx, text, start_ms, end_ms, and confidence where they have one."""
    time = lambda c: (F.col(c) / 1000).alias(c.removesuffix("_ms"))
    item = lambda rows, key: F.struct(F.col(key).cast("string").alias("id"), time("start_ms"), time("end_ms"), "text", *[c for c in ("confidence",) if c in rows.columns])
    nest = lambda rows, key, name: rows.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, item(rows, key).alias("x")))), lambda r: r["x"]).alias(name))
    both = nest(segments, "seg_idx", "segments").join(nest(units, "unit_id", "semantic_units"), "media_id", "full_outer")
    both = both.join(nest(words, "word_idx", "words"), "media_id", "full_outer") if words is not None else both.withColumn("words", F.array().cast("array<string>"))
    lists = [F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType)).alias(c) for c in LISTS]
    document = F.to_json(F.struct(F.lit("1").alias("version"), *lists))
    return both.select("media_id", document.alias("document")).withColumn("too_large", F.octet_length("document") > MOST_BYTES)


def timeline_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, document) of files, as bytes; a file over the limit isn't read, and has no document. Spark's readers pass
    over files without a byte; whoever has a list of the files finds those by an anti join."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= MOST_BYTES).select("path", F.col("length").alias("n_bytes"), F.col("content").alias("document"))
    return small.unionByName(files.where(F.col("length") > MOST_BYTES).select("path", F.col("length").alias("n_bytes"), F.lit(None).cast("binary").alias("document")))


def _read(documents: DataFrame) -> DataFrame:
    """documents, text or bytes, with code, why one is rejected (null: it isn't), version, language and the three lists."""
    raw = F.col("document").cast("binary")
    size = F.coalesce(F.col("n_bytes") if "n_bytes" in documents.columns else F.octet_length(raw), F.lit(0))
    text = raw.cast("string")
    plain = F.when((size > 0) & (size <= MOST_BYTES) & F.is_valid_utf8(text), text)
    schema = "version string, language string, " + ", ".join(f"{n} array<{ITEM}>" for names, _ in LISTS.values() for n in names)
    rows = documents.withColumns({"keys": F.json_object_keys(plain), "j": F.from_json(plain, schema, {"caseSensitive": "true"})})
    code = F.when(size == 0, "emptyFile").when(size > MOST_BYTES, "unexpectedlyLarge").when(plain.isNull(), "invalidUTF8").when(F.col("keys").isNull(), "invalidJSON")
    lists = {}
    for name, (names, missing) in LISTS.items():
        lists[name] = F.col(f"j.{names[0]}") if len(names) == 1 else F.when(F.array_contains("keys", names[0]), F.col(f"j.{names[0]}")).otherwise(F.col(f"j.{names[1]}"))
        code = code.when(lists[name].isNull() | F.exists(lists[name], lambda x: x.isNull()), missing)
    return rows.withColumns({**lists, "code": code, "version": F.coalesce("j.version", F.lit("1")), "language": F.coalesce("j.language", F.lit("und"))})


def timeline_rejects(documents: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, code) of documents that can't be read: emptyFile, unexpectedlyLarge (over 64 MiB), invalidUTF8, invalidJSON, or
    the first list that is missing or isn't one of objects. A list may be empty."""
    return _read(documents).where("code is not null").select(key, "code")


def timeline_heads(documents: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, version, language) of documents that can be read; without them version is 1 and language und."""
    return _read(documents).where("code is null").select(key, "version", "language")


def read_timelines(documents: DataFrame, kind: str, key: str = "media_id") -> DataFrame:
    """(key, place, id, start_ms, end_ms, text, confidence, word_start, word_end) of words, segments or semantic_units.
    Numbers may be strings, a missing start is 0, a missing end the start, a missing id or text empty; names may be in either
    form (id or index, text or word, confidence or probability, word_start or wordStart). Rejected documents have no rows."""
    return _items(_read(documents).where("code is null").select(key, F.posexplode(kind).alias("p", "x")), key)


def read_all_timelines(documents: DataFrame, key: str = "media_id") -> DataFrame:
    """The same rows of all three lists, with kind, the list's name. A document is parsed once: a filter by its code would be
    worked out below the lists, with a parse of its own."""
    lists = F.array(*[F.struct(F.lit(kind).alias("kind"), F.when(F.col("code").isNull(), F.col(kind)).alias("xs")) for kind in LISTS])
    rows = _read(documents).select(key, F.explode(lists).alias("l")).select(key, "l.kind", F.posexplode("l.xs").alias("p", "x"))
    return _items(rows, "kind", key)


def _items(rows: DataFrame, *keys: str) -> DataFrame:
    number = lambda *names: F.coalesce(*[F.trim(F.col(f"x.{n}")).try_cast("double") for n in names])
    whole = lambda *names: F.coalesce(*[F.trim(F.col(f"x.{n}")).try_cast("double").cast("long") for n in names])
    start = F.coalesce(number("start"), F.lit(0.0))
    ms = lambda c: F.round(c * 1000).cast("long")
    return rows.select(
        *keys, F.col("p").cast("long").alias("place"), F.coalesce("x.id", "x.index", F.lit("")).alias("id"), ms(start).alias("start_ms"), ms(F.coalesce(number("end"), start)).alias("end_ms"),
        F.coalesce("x.text", "x.word", F.lit("")).alias("text"), number("confidence", "probability").alias("confidence"), whole("word_start", "wordStart").alias("word_start"), whole("word_end", "wordEnd").alias("word_end"),
    )


def read_translations(lines: DataFrame) -> DataFrame:
    """(media_id, unit_id, text) of JSON lines; the id is a string and stands under unit_id, unitID or id, a
    missing text is empty; a line that is no JSON has neither."""
    j = F.from_json("line", "unit_id string, unitID string, id string, text string", {"caseSensitive": "true"})
    return lines.select("media_id", F.coalesce(j["unit_id"], j["unitID"], j["id"]).alias("unit_id"), F.coalesce(j["text"], F.lit("")).alias("text"))


def event_lines(lines: DataFrame) -> DataFrame:
    """Events of lines with the prefix; other lines and malformed events go. Works on streams as on tables."""
    events = lines.where(F.col("value").startswith(EVENT))
    j = F.from_json(F.substring(F.col("value"), len(EVENT) + 1, 1 << 30), "event_id long, job_id long, stage string, fraction double")
    return events.select(j.alias("j")).where("j.event_id is not null").select("j.*")


def progress_updates(lines: DataFrame) -> DataFrame:
    """(event_id, job_id, stage, progress, elapsed, eta) of the event lines that tell a fraction of a known stage, which is
    clamped to 0 and 1: the job's progress over all stages, and the stage's seconds so far and to come. elapsed is the
    event's own; else that of a column `since` of the line, where there is one; else null. eta is the event's own or null.
    Other lines, and events without a fraction or a stage, go. Works on streams as on tables."""
    j = F.from_json(F.substring("value", len(EVENT) + 1, 1 << 30), "event_id long, job_id long, stage string, fraction double, elapsed double, eta double")
    since = F.col("since").cast("double") if "since" in lines.columns else F.lit(None).cast("double")
    rows = lines.where(F.col("value").startswith(EVENT)).select(j.alias("j"), since.alias("since"))
    fraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(~F.isnan("j.fraction"), F.col("j.fraction"))))
    rows = rows.where(F.col("j.fraction").isNotNull() & ~F.isnan("j.fraction"))
    progress = overall_progress(F.col("j.stage"), fraction)
    return rows.select("j.event_id", "j.job_id", "j.stage", progress.alias("progress"), F.coalesce("j.elapsed", "since").alias("elapsed"), F.col("j.eta").alias("eta")).where("progress is not null")
