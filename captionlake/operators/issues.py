"""Issues of outputs: one shape, one place where a code's severity is set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "struct<severity:string,code:string,actual:double,limit:double>"
# The codes that ask for a review; all others are errors. lineTooLong is either, by its line.
WARNINGS = ("sourceUnitsOutOfOrder", "timingWindowInsufficient", "timingCapacityExceeded", "cueTooShort", "cueTooLong", "readingSpeedExceeded")


def severity(code: Column) -> Column:
    return F.when(code.isin(*WARNINGS), "warning").otherwise("error")


def issue(code: str, actual=None, limit=None, warns: Column | None = None) -> Column:
    """An issue with what was found and what is allowed, in seconds, characters or counts; warns: where it is a warning."""
    level = F.when(warns, "warning").otherwise("error") if warns is not None else severity(F.lit(code))
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(level.alias("severity"), F.lit(code).alias("code"), number(actual).alias("actual"), number(limit).alias("limit"))


def those(*found: Column) -> Column:
    """The issues that are there, of columns that are null where one isn't."""
    return F.array_compact(F.array(*[f.cast(ISSUE) for f in found]))


def keys_of(rows: DataFrame) -> list[str]:
    """What an output is of: a media, and a language where the rows have one."""
    return ["media_id", "lang"] if "lang" in rows.columns else ["media_id"]
