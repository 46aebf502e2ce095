"""Recogniser output: its words, and phrases that a decoder repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.loops import longest_loop
from ..functions.texts import case_folded, has_cjk, safe_number, strip, token_key

LOW_LOGPROB, LEAST_TIMES, LEAST_UNITS, LEAST_STAMPS = -1.0, 4, 8, 4
EDGE = "\u0000"  # stands before each unit of a marked text


def read_segments(lines: DataFrame) -> DataFrame:
    """(media_id, seg_idx, is_object, start, end, text, avg_logprob, compression_ratio, no_speech_prob, words) of JSON rows. A
    row that is no JSON object stays, with nulls, so that it can be counted; a number may be a string; what is no finite
    number is null; a word without text has an empty one."""
    word = "struct<word:string,start:string,end:string,probability:string>"
    j = F.from_json("line", f"start string, end string, text string, avg_logprob string, compression_ratio string, no_speech_prob string, words array<{word}>")
    number = lambda c: safe_number(j[c]).alias(c)
    words = F.transform(
        F.filter(j["words"], lambda w: w.isNotNull()),
        lambda w: F.struct(F.coalesce(w["word"], F.lit("")).alias("text"), safe_number(w["start"]).alias("start"), safe_number(w["end"]).alias("end"), safe_number(w["probability"]).alias("probability")),
    )
    is_object = F.coalesce(F.get_json_object("line", "$").startswith("{"), F.lit(False))
    return lines.select("media_id", "seg_idx", is_object.alias("is_object"), number("start"), number("end"), j["text"].alias("text"), number("avg_logprob"), number("compression_ratio"), number("no_speech_prob"), words.alias("words"))


def words_tell(text: Column, start: Column, end: Column, words: Column) -> Column:
    """Whether words, an array of (text, start, end, probability), are together the text and lie in order from start to end.
    Never null: what isn't known doesn't tell."""
    told = F.aggregate(words, F.lit(""), lambda a, w: F.concat(a, w["text"]))
    state = F.struct(F.lit(True).alias("good"), start.cast("double").alias("last"))

    def step(acc, w):
        good = acc["good"] & (w["start"] >= acc["last"]) & (w["end"] > w["start"]) & (w["end"] <= end) & (w["text"] != "")
        return F.struct(F.coalesce(good, F.lit(False)).alias("good"), w["end"].alias("last"))

    sound = F.aggregate(words, state, step, lambda acc: acc["good"])
    return F.coalesce((F.size(words) > 0) & (strip(told) == text) & sound, F.lit(False))


def usable_words(text: Column, start: Column, end: Column, words: Column) -> Column:
    """The words of a cleaned segment, if they tell it (see words_tell); else one word that spans the segment, without a
    probability. words: array of (text, start, end, probability)."""
    single = F.struct(text.alias("text"), start.cast("double").alias("start"), end.cast("double").alias("end"), F.lit(None).cast("double").alias("probability"))
    return F.when(words_tell(text, start, end, words), words).otherwise(F.array(single))


def marked_stamps(text: Column, words: Column) -> Column:
    """The stripped text with EDGE between the words that were stamped, white space before a word being taken to the one
    before it; null unless the words, put together and stripped, are the text and 4 or more have something to show. words:
    array of structs with a text. A null word, or a text that holds EDGE, gives null too."""
    told = F.transform(words, lambda w: w["text"])
    good = (strip(F.array_join(told, "")) == text) & ~F.exists(told, lambda w: w.isNull()) & ~F.contains(text, F.lit(EDGE))
    marked = F.regexp_replace(F.concat(F.lit(EDGE), F.array_join(told, EDGE)), r"(?U)\x00(?=[\s\x00]*\x00)", "")
    marked = F.regexp_replace(F.regexp_replace(marked, r"(?U)\x00(\s+)", "$1\u0000"), r"(?U)^\s*\x00|[\s\x00]+$", "")
    return F.when(good & (F.size(F.split(marked, EDGE)) >= LEAST_STAMPS), marked)


def trim_decoder_loops(segments: DataFrame) -> DataFrame:
    """(media_id, seg_idx, text, trimmed) of segments with text and avg_logprob: a phrase of at most 8 words (16 units in
    texts of under 4 words) that stands 4 times or more in a row, 8 units or more in all, is cut out of texts whose
    avg_logprob is under -1. Units are the stamped words of a column `words`, where there is one and it tells the whole text
    (see marked_stamps); else words, or graphemes where a text of under 4 words has Chinese, Japanese or Korean characters.
    The most repetitions win, then the most units, the earliest start, the shortest phrase. What is left
    without a letter or digit is empty. Texts with a higher, null or NaN avg_logprob are only stripped.

    A text is done where it stands, without a shuffle; its loop is found by functions/loops.py."""
    key = ["media_id", "seg_idx"]
    text = strip(F.col("text"))
    marked = marked_stamps(text, F.col("words")) if "words" in segments.columns else F.lit(None).cast("string")
    low = F.col("avg_logprob") < LOW_LOGPROB
    rows = segments.select(*key, text.alias("text"), low.alias("low"), F.when(low, marked).alias("marked"))
    parts = lambda c: F.regexp_extract_all(c, F.lit(r"(?sU)\S+\s*"), F.lit(0))  # noqa: E731 words with the white space after them
    clusters = lambda c: F.regexp_extract_all(c, F.lit(r"(?s)\X"), F.lit(0))
    open_ = rows.withColumn("ws", F.when(F.col("low"), parts(F.col("text")))).withColumn("few", F.size("ws") < 4)
    open_ = open_.withColumns({"graph": F.col("marked").isNull() & F.col("few") & has_cjk(F.col("text")), "shown": F.when(F.col("low"), F.coalesce("marked", "text"))})
    taken = lambda c, ws: F.when(F.col("marked").isNotNull(), F.split(c, EDGE)).when(F.col("graph"), clusters(c)).otherwise(ws)
    open_ = open_.withColumn("us", taken(F.col("shown"), F.col("ws")))
    open_ = open_.withColumn("folded", case_folded(F.when(F.size("us") >= LEAST_UNITS, F.col("shown"))))
    open_ = open_.withColumn("keys", F.transform(taken(F.col("folded"), parts(F.col("folded"))), token_key))
    open_ = open_.withColumn("loop", longest_loop(F.col("keys"), F.when(F.col("few"), 16).otherwise(8), LEAST_TIMES, LEAST_UNITS))
    cut = open_.select(*key, "text", "graph", F.col("loop").isNotNull().alias("trimmed"), *[F.when(F.col("loop").isNotNull(), F.array_join(F.slice("us", F.lit(1), F.col(n)), "")).alias(c) for c, n in (("head", "loop.first"), ("upto", "loop.till"))])
    cut = cut.withColumn("body", F.when(F.col("graph"), F.col("upto")).otherwise(F.regexp_replace("upto", r"(?U)\s+$", "")))
    tail = F.expr("substring(text, length(body) + 1)")
    touch = F.col("head").rlike(r"(?U)\s$") & tail.rlike(r"(?U)^\s")
    cut = cut.withColumn("left", strip(F.concat("head", F.when(touch, F.regexp_replace(tail, r"(?U)^\s+", "")).otherwise(tail))))
    return cut.select(*key, F.when(~F.col("trimmed"), F.col("text")).when(F.col("left").rlike(r"[\p{L}\p{N}]"), F.col("left")).otherwise("").alias("text"), "trimmed")
