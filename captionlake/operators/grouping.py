"""Rules that look at what was kept so far: folds, kept inside short islands of rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import scan
from ..functions.scalars import ends_sentence
from ..functions.texts import duplicate_key, graphemes, strip
from .cleaning import judge_segments
from .speech import trim_decoder_loops

MOST_UNITS, LONGEST_MS, GAP_MS, MOST_CHARS = 6, 20_000, 1000, 600
WANTED_UNITS, WANTED_MS = 3, 12_000


def sanitize(judged: DataFrame) -> DataFrame:
    """(media_id, seg_idx, start_ms, reason) of segments that earlier rules keep: empty (or without a text), duplicate of the last
    kept segment that it overlaps, fully_overlapped, or null with the moved start.

    A segment that starts at or after every earlier end is kept whatever came before, so it begins an island; only what is
    inside an island is folded. One shuffle, by media."""
    rows = judged.where("reason is null").withColumn("key", F.coalesce(duplicate_key(F.col("text")), F.lit("")))
    order = Window.partitionBy("media_id").orderBy("seg_idx")
    told = F.col("key") != ""
    earlier = F.max(F.when(told, F.col("end_ms"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = told & (earlier.isNull() | ((F.col("start_ms") >= earlier) & (F.col("end_ms") > F.col("start_ms"))))
    cut = rows.withColumn("island", F.count_if(F.coalesce(fresh, F.lit(False))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = {f.dataType.simpleString() for f in rows.select("start_ms", "end_ms").schema}
    time = "bigint" if kinds <= {"int", "bigint"} else "double"
    ms = lambda c: F.col(c).cast(time).alias(c)
    islands = cut.groupBy("media_id", "island").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "key", ms("start_ms"), ms("end_ms")))).alias("us"))

    def step(s, u):
        moved = F.greatest(u["start_ms"], s["reach"])
        same = u["key"].eqNullSafe(s["last"]) & (u["start_ms"] < s["reach"])
        reason = F.when(u["key"] == "", "empty_or_decoder_loop").when(same, "duplicate").when(u["end_ms"] <= moved, "fully_overlapped")
        start = F.when((u["key"] == "") | same, u["start_ms"]).otherwise(moved)
        state = F.when(reason.isNotNull(), s).otherwise(F.struct(u["key"].alias("last"), u["end_ms"].alias("reach")))
        return F.struct(state.alias("s"), F.struct(u["seg_idx"].alias("seg_idx"), start.alias("start_ms"), reason.alias("reason")).alias("o"))

    nothing = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast(time).alias("reach"))
    place = rows.schema["seg_idx"].dataType.simpleString()
    out = scan(F.col("us"), nothing, step, f"struct<seg_idx:{place},start_ms:{time},reason:string>")
    return islands.select("media_id", F.explode(out).alias("x")).select("media_id", "x.seg_idx", "x.start_ms", "x.reason")


def sanitize_segments(segments: DataFrame) -> DataFrame:
    """A trace of the whole cleaning, a row for each segment: (media_id, seg_idx, text, start_ms, end_ms, trimmed, adjusted,
    reason, output_index). Segments are judged by their times and metrics, repeated phrases are cut out of the texts of
    those that stay (by stamped words, where segments have words), then come duplicates and overlaps. reason is null for what stays, which output_index numbers from 0;
    trimmed and adjusted (a start was moved, or nothing was left of the time) tell of segments that go as well."""
    key = ["media_id", "seg_idx"]
    judged = judge_segments(segments)
    kept = judged.where("reason is null")
    stamps = ["words"] if "words" in segments.columns else []
    texts = trim_decoder_loops(kept.select(*key, "text", "avg_logprob", *stamps))
    told = kept.select(*key, F.col("start_ms").alias("s0"), "end_ms").join(texts, key)
    done = sanitize(told.select(*key, F.col("s0").alias("start_ms"), "end_ms", "text", F.lit(None).cast("string").alias("reason")))
    adjusted = F.col("reason").eqNullSafe("fully_overlapped") | (F.col("reason").isNull() & (F.col("start_ms") > F.col("s0")))
    columns = [*key, "text", "start_ms", "end_ms", "trimmed", "adjusted", "reason"]
    none = F.lit(False)
    every = told.join(done, key).withColumn("adjusted", adjusted).select(columns).unionByName(judged.where("reason is not null").withColumns({"trimmed": none, "adjusted": none}).select(columns))
    place = F.count_if(F.col("reason").isNull()).over(Window.partitionBy("media_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return every.withColumn("output_index", F.when(F.col("reason").isNull(), place))


def trace_report(trace: DataFrame) -> DataFrame:
    """(media_id, n_input, n_output, n_removed, by_reason, overlaps_adjusted, loops_trimmed, quality_warning) of traces:
    by_reason maps each reason to the segments that went for it; a warning if as many as 5 and a twentieth went."""
    n = trace.groupBy("media_id", "reason").agg(F.count("*").alias("n"), F.count_if("adjusted").alias("adjusted"), F.count_if("trimmed").alias("trimmed"))
    gone = F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0))
    by_reason = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    return n.groupBy("media_id").agg(
        F.sum("n").alias("n_input"), (F.sum("n") - gone).alias("n_output"), gone.alias("n_removed"), by_reason.alias("by_reason"), F.sum("adjusted").alias("overlaps_adjusted"), F.sum("trimmed").alias("loops_trimmed"),
        (gone >= F.greatest(F.lit(5), F.ceil(F.sum("n") * 5 / 100))).alias("quality_warning"),
    )


def group_units(units: DataFrame) -> DataFrame:
    """(media_id, unit_id, group_id): units grouped for translation. A gap below 0 or over a second and a change
    of known speakers always part; inside such an island a group closes before the unit that would make it too
    many units, too long in time or text, or once it is long enough and ends a sentence."""
    order = Window.partitionBy("media_id").orderBy("unit_id")
    gap = F.col("start_ms") - F.lag("end_ms").over(order)
    parts = F.coalesce((gap < 0) | (gap > GAP_MS), F.lit(False)) | F.coalesce(F.lag("speaker").over(order) != F.col("speaker"), F.lit(False))
    text = strip(F.col("text"))
    cut = units.withColumns({"parts": parts.cast("int"), "n": graphemes(text).cast("long"), "sep": F.when(F.col("lang").isin("ja", "zh"), 0).otherwise(1), "done": F.coalesce(F.right(text, F.lit(1)).isin(*".!?。！？…"), F.lit(False))})
    islands = cut.withColumn("island", F.sum("parts").over(order)).groupBy("media_id", "island").agg(
        F.array_sort(F.collect_list(F.struct("unit_id", "start_ms", "end_ms", "n", "sep", "done"))).alias("us")
    )
    zero = F.lit(0).cast("bigint")

    def step(g, u):
        total = g["n"] + u["n"] + F.when((g["n"] > 0) & (u["n"] > 0), u["sep"]).otherwise(0)
        enough = ((g["k"] >= WANTED_UNITS) | (g["e"] - g["s"] >= WANTED_MS)) & g["done"]
        joins = (g["k"] > 0) & (g["k"] < MOST_UNITS) & (u["end_ms"] - g["s"] <= LONGEST_MS) & (total <= MOST_CHARS) & ~enough
        own = lambda grown, new: F.when(joins, grown).otherwise(new)
        state = F.struct(own(g["k"] + 1, F.lit(1)).alias("k"), own(g["s"], u["start_ms"]).alias("s"), u["end_ms"].alias("e"), own(total, u["n"]).alias("n"), u["done"].alias("done"))
        return F.struct(state.alias("s"), (~F.coalesce(joins, F.lit(False))).alias("o"))

    nothing = F.struct(F.lit(0).alias("k"), zero.alias("s"), zero.alias("e"), zero.alias("n"), F.lit(False).alias("done"))
    state = scan(F.col("us"), nothing, step, "boolean")
    flat = islands.select("media_id", F.explode(F.arrays_zip("us.unit_id", state.alias("first"))).alias("x")).select("media_id", F.col("x.unit_id").alias("unit_id"), F.col("x.first").alias("first"))
    return flat.select("media_id", "unit_id", (F.sum(F.col("first").cast("long")).over(order) - 1).alias("group_id"))


def apply_translator(units: DataFrame, translate: Callable[[list[str]], list[str]], batch: int = 50) -> DataFrame:
    """(media_id, unit_id, translated, problem): a user's function over batches of texts. Where a batch fails or
    gives another number of texts, each text is tried alone; what still fails is null with a problem."""

    def run(frames):
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                got, why = _tried(translate, part.text.tolist())
                if why:
                    singles = [_tried(translate, [t]) for t in part.text]
                    got, why = [g[0] if not w else None for g, w in singles], [w for _, w in singles]
                yield part.assign(translated=got, problem=why)[["media_id", "unit_id", "translated", "problem"]]

    return units.select("media_id", "unit_id", "text").mapInPandas(run, "media_id long, unit_id long, translated string, problem string")


def _tried(translate, texts: list[str]):
    """The function's texts and None, or None and what went wrong. Errors become rows: one text must not stop a job."""
    try:
        got = list(translate(texts))
    except Exception as e:
        return None, type(e).__name__
    return (got, None) if len(got) == len(texts) else (None, "countMismatch")


def split_units(words: DataFrame, gap_ms: int = 800, longest_ms: int = 15_000) -> DataFrame:
    """(media_id, word_idx, unit_id): units end at a sentence end, before a pause, and after the word with which
    they last longest_ms. Sentence ends and pauses make islands; only the length is folded, inside an island."""
    order = Window.partitionBy("media_id").orderBy("word_idx")
    pause = F.col("start_ms") - F.lag("end_ms").over(order) >= gap_ms
    parts = F.coalesce(pause | ends_sentence(F.lag("text").over(order)), F.lit(False)).cast("int")
    islands = words.withColumn("parts", parts).withColumn("island", F.sum("parts").over(order)).groupBy("media_id", "island").agg(
        F.array_sort(F.collect_list(F.struct("word_idx", "start_ms", "end_ms"))).alias("ws")
    )

    def step(u, w):
        full = u["e"] - u["s"] >= longest_ms
        return F.struct(F.struct(F.when(full, w["start_ms"]).otherwise(u["s"]).alias("s"), w["end_ms"].alias("e")).alias("s"), full.alias("o"))

    none = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(longest_ms).cast("bigint").alias("e"))
    state = scan(F.col("ws"), none, step, "boolean")
    flat = islands.select("media_id", F.explode(F.arrays_zip("ws.word_idx", state.alias("first"))).alias("x")).select("media_id", F.col("x.word_idx").alias("word_idx"), F.col("x.first").alias("first"))
    return flat.select("media_id", "word_idx", (F.sum(F.col("first").cast("long")).over(order) - 1).alias("unit_id"))


def throttled(updates: DataFrame, least: float = 0.002) -> DataFrame:
    """Updates of each run to show: the first, the last, whole ones, and each that is `least` further than the last shown.
    Runs stand sorted, one behind another, and a task reads them as they come; what it holds is the last shown one."""
    run, nan = ["job_id", "run_id"], float("nan")
    order = Window.partitionBy(*run).orderBy(F.asc_nulls_last("event_id"))
    rows = updates.select(*run, "event_id", "fraction")
    kinds = rows.schema

    def fold(batches):
        now = shown = None
        for b in batches:
            keep = []
            for job, one, f, final in zip(*(b.column(c).to_pylist() for c in (*run, "fraction", "final"))):
                f = nan if f is None else f
                new = (job, one) != now
                keep.append(new or final or f >= 1 or f - shown >= least)
                if keep[-1]:
                    now, shown = (job, one), f
            yield b.filter(pa.array(keep, pa.bool_())).select(kinds.names)

    told = rows.withColumn("final", F.lead(F.lit(True)).over(order).isNull())
    return told.sortWithinPartitions(*run, F.asc_nulls_last("event_id")).mapInArrow(fold, kinds)
