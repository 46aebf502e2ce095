"""Units, their order and neighbours, translations and cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cue_times, ends_sentence, srt_time
from ..functions.texts import caption, is_blank, strip
from .issues import keys_of

GAP_MS, LONGEST_MS, MOST_BYTES = 800, 15_000, 50 << 20


def hard_breaks(words: DataFrame) -> DataFrame:
    """Islands of words between sentence ends and pauses: (media_id, island, n_words, start_ms, end_ms)."""
    order = Window.partitionBy("media_id").orderBy("word_idx")
    gap = F.col("start_ms") - F.lag("end_ms").over(order)
    new = F.when((gap >= GAP_MS) | ends_sentence(F.lag("text").over(order)), 1).otherwise(0)
    marked = words.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    return marked.groupBy("media_id", "island").agg(
        F.count("*").alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def with_context(units: DataFrame) -> DataFrame:
    order = Window.partitionBy("media_id").orderBy("unit_id")
    return units.select("media_id", "unit_id", "text", F.lag("text").over(order).alias("preceding"), F.lead("text").over(order).alias("following"))


def order_units(units: DataFrame) -> DataFrame:
    """Place by start, then by input position; whether that differs from the input's order."""
    at = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "unit_id")) - 1
    return units.select("media_id", "unit_id", at.cast("long").alias("place")).withColumn("moved", F.col("place") != F.col("unit_id"))


def next_valid_start(units: DataFrame, media_end: str = "media_end_ms") -> DataFrame:
    """Start of the next unit whose start isn't negative, at most the media's end."""
    # from the end on, since a frame that runs to the end is made anew for each row
    after = Window.partitionBy("media_id").orderBy(F.desc("unit_id")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col("start_ms") >= 0, F.col("start_ms")), ignorenulls=True).over(after)
    return units.select("media_id", "unit_id", F.least(F.coalesce(start, F.col(media_end)), F.col(media_end)).alias("next_start_ms"))


def match_translations(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Issues of each unit's translation: missing, empty, orphan, duplicate; of several the last counts. A unit's
    identifier that others have too, or that is null, is an issue as well."""
    key = ["media_id", "unit_id"]
    last = translations.groupBy(key).agg(F.max_by("text", "ord").alias("translated"), F.count("*").alias("n"))
    both = units.groupBy(key).agg(F.count("*").alias("known")).join(last, key, "full_outer")
    issues = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "missingTranslation"), F.when(caption(F.col("translated")) == "", "emptyTranslation"),
        F.when(F.col("known").isNull(), "orphanTranslation"), F.when(F.col("n") > 1, "duplicateTranslation"),
        F.when((F.col("known") > 1) | (F.col("unit_id").isNull() & F.col("known").isNotNull()), "duplicateUnitIdentifier"),
    ))
    return both.select(*key, F.explode(issues).alias("issue"))


def cues(segments: DataFrame) -> DataFrame:
    """Cues as subtitle files have them: (keys, ordinal, cue_index, timing, text). The whole text, in as many
    lines of 40 characters as it needs."""
    lines = F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0))
    timing = F.concat(srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")))
    n = F.col("seg_idx") + 1
    return segments.select(*keys_of(segments), n.alias("ordinal"), n.alias("cue_index"), timing.alias("timing"), F.array_join(lines, "\n").alias("text"))


def srt_documents(cues: DataFrame) -> DataFrame:
    """One subtitle document for each output (a media, or a media and a language), cues in order."""
    block = F.concat_ws("\n", F.col("cue_index").cast("string"), "timing", "text")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", block.alias("block"))))
    return cues.groupBy(*keys_of(cues)).agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n"), F.lit("\n")).alias("document"))


def _blocks(document: Column, own: bool = False) -> Column:
    """The blocks with something in them; blanks at the end of their last line stay. own: see parse_srt."""
    plain = document if own else F.regexp_replace(F.regexp_replace(document, "\r\n", "\n"), "\r", "\n")
    return F.filter(F.transform(F.split(plain, "\n\n"), lambda b: F.regexp_replace(b, r"(?U)^\s+|\n+\z", "")), lambda b: b != "")


def parse_srt(documents: DataFrame, own: bool = False) -> DataFrame:
    """(keys, ordinal, cue_index, timing, text, n_lines) of subtitle documents: line 1 is the index (null where it is no
    number), line 2 the timing, the rest text, with its blanks; n_lines is without blanks at the block's end. own: documents of
    srt_documents, whose line ends are \\n alone, so that \\r is text, and every cue comes back as it was written."""
    out = documents.select(*keys_of(documents), F.posexplode(_blocks(F.col("document").cast("string"), own)).alias("p", "b"))
    parts, bare = F.split("b", "\n"), F.split(strip(F.col("b")), "\n")
    number = F.when(F.get(bare, F.lit(0)).rlike(r"^[\p{Zs}\t]*[+-]?[0-9]+[\p{Zs}\t]*$"), F.trim(F.get(bare, F.lit(0))).try_cast("long"))
    return out.select(
        *keys_of(documents), (F.col("p") + 1).cast("long").alias("ordinal"), number.alias("cue_index"), F.get(parts, F.lit(1)).alias("timing"),
        F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "\n").alias("text"), F.size(bare).alias("n_lines"),
    )


def first_fault(documents: DataFrame) -> DataFrame:
    """(keys, ordinal, fault): why a subtitle document, text or bytes, isn't valid. Of the document (ordinal is null):
    emptyFile, unexpectedlyLarge (over 50 MiB), invalidUTF8, noCues. Else of the first block that breaks a rule, by the
    rules' order: cueMissingText (fewer than three lines), invalidNumbering, invalidTimestamps (not two times that run
    forward, or a start before the last end; adjacent cues may touch). A null document is empty."""
    keys = keys_of(documents)
    raw = F.col("document").cast("binary")
    size = F.coalesce(F.octet_length(raw), F.lit(0))
    whole = F.when(size == 0, "emptyFile").when(size > MOST_BYTES, "unexpectedlyLarge").when(~F.is_valid_utf8(raw.cast("string")), "invalidUTF8")
    whole = whole.when(F.size(_blocks(F.make_valid_utf8(raw.cast("string")))) == 0, "noCues")
    judged = documents.withColumn("whole", whole)
    order = Window.partitionBy(*keys).orderBy("ordinal")
    rows = parse_srt(judged.where("whole is null")).withColumn("at", cue_times(F.col("timing"))).withColumn("last", F.lag("at.end").over(order))
    s, e = F.col("at.start"), F.col("at.end")
    fault = (
        F.when(F.col("n_lines") < 3, "cueMissingText").when(~F.col("cue_index").eqNullSafe(F.col("ordinal")), "invalidNumbering")
        .when(~F.coalesce((e > s) & (s >= F.coalesce("last", F.lit(0))), F.lit(False)), "invalidTimestamps").when(is_blank(F.col("text")), "emptyCueText")
    )
    faults = rows.withColumn("fault", fault).where("fault is not null").groupBy(*keys).agg(F.min(F.struct("ordinal", "fault")).alias("x")).select(*keys, "x.*")
    return faults.unionByName(judged.where("whole is not null").select(*keys, F.lit(None).cast("long").alias("ordinal"), F.col("whole").alias("fault")))
