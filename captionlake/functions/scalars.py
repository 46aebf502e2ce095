"""Column functions of subtitle text and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import bound

# How whole jobs divide into stages (start and end of each stage's share).
STAGE_SHARE = {"check": (0.0, 0.05), "audio": (0.05, 0.15), "speech": (0.15, 0.78), "translate": (0.78, 0.95), "save": (0.95, 0.99)}
# Characters a line, characters a second, least seconds, by language.
PROFILES = [
    ("en", 42, 20.0, 0.833), ("ru", 42, 17.0, 0.833), ("de", 42, 17.0, 0.833), ("es", 42, 17.0, 0.833), ("it", 42, 17.0, 0.833),
    ("fr", 42, 17.0, 0.833), ("ja", 13, 4.0, 0.5), ("zh", 16, 9.0, 0.833), ("ko", 16, 12.0, 0.833), ("hi", 42, 22.0, 0.833),
]


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of a number of milliseconds, at least 0."""
    v = F.greatest(ms.cast("long"), F.lit(0))
    part = lambda d, m: F.lpad(((v / d).cast("long") % m if m else (v / d).cast("long")).cast("string"), 2, "0")
    hours = (v / 3600000).cast("long")
    long_hours = F.when(hours < 100, F.lpad(hours.cast("string"), 2, "0")).otherwise(hours.cast("string"))
    return F.concat(long_hours, F.lit(":"), part(60000, 60), F.lit(":"), part(1000, 60), F.lit(","), F.lpad((v % 1000).cast("string"), 3, "0"))


def rounded_ms(seconds: Column, half_even: bool) -> Column:
    """Seconds to whole milliseconds, at least 0: halves to the even neighbour, as the writer of transcripts does, or away
    from 0, as the writer of subtitles does. Null, NaN and infinite seconds give null."""
    ms = (F.bround if half_even else F.round)(seconds * 1000)
    plain = seconds.cast("double")
    return F.when(~F.isnan(plain) & (F.abs(plain) < float("inf")), F.greatest(ms.cast("long"), F.lit(0)))


def srt_ms(text: Column) -> Column:
    """Milliseconds of hours:minutes:seconds,milliseconds, blanks around them aside; null where it doesn't parse: minutes and
    seconds under 60, three characters of milliseconds, hours that a long of milliseconds can hold."""
    whole = r"([+-]?[0-9]+)"
    plain = F.regexp_replace(text, r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")

    def told(parts):
        n = lambda i: F.get(parts, F.lit(i)).try_cast("long")
        small = lambda v: v.between(0, 59)
        ms = lambda h, m, s, f: F.when(h.between(-2_000_000_000, 2_000_000_000) & small(m) & small(s) & f.between(0, 999), h * 3600000 + m * 60000 + s * 1000 + f)
        return F.when(F.length(F.get(parts, F.lit(3))) == 3, ms(n(0), n(1), n(2), n(3)))

    # each step once: written as plain columns, every number would parse the text anew for every use
    parts = bound(plain, lambda t: F.split(F.when(t.rlike(rf"^{whole}:{whole}:{whole},[+-]?[0-9]{{2,3}}$"), t), "[:,]"))
    return bound(parts, told)


def cue_times(timing: Column) -> Column:
    """(start, end) in milliseconds of `start --> end`; both null where there are more or fewer parts."""

    def told(ends):
        two = F.size(ends) == 2
        return F.struct(F.when(two, srt_ms(F.get(ends, F.lit(0)))).alias("start"), F.when(two, srt_ms(F.get(ends, F.lit(1)))).alias("end"))

    return bound(F.split(timing, " --> "), told)


def duration(seconds: Column) -> Column:
    """m:ss or h:mm:ss, or - for what is negative or not finite."""
    s = F.round(seconds).cast("long")
    ss, mm = F.lpad((s % 60).cast("string"), 2, "0"), ((s / 60).cast("long") % 60).cast("string")
    h = (s / 3600).cast("long")
    good = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    return F.when(good, F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), F.lpad(mm, 2, "0"), F.lit(":"), ss)).otherwise(F.concat(mm, F.lit(":"), ss))).otherwise("-")


# Quotes and brackets that may follow a sentence mark.
CLOSERS = "\"'”’»)\\]}）］｝」』】"


def ends_sentence(text: Column) -> Column:
    """Ends with a sentence mark, closing quotes and brackets aside."""
    return text.rlike(f"(?U)[.!?。！？।॥][{CLOSERS}]*\\s*$")


def output_name(path: Column, lang: Column) -> Column:
    """<stem>.<lang>.srt beside the media."""
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit("."), lang, F.lit(".srt"))


def overall_progress(stage: Column, fraction: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, (lo, hi) in STAGE_SHARE.items():
        out = F.when(stage == name, lo + (hi - lo) * fraction).otherwise(out)
    return out


def remaining(elapsed: Column, fraction: Column) -> Column:
    """elapsed * (1 - fraction) / fraction; null at the start."""
    return F.when(fraction > 0, elapsed * (1 - fraction) / fraction)
