"""Folds over arrays that give a value for each element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(xs: Column, state: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What step tells of each element, in order: step(state, x) is a struct (s, o) of the next state and the value for x, of
    the SQL type `kind`. Null for a null array, empty for an empty one.

    An array that grows by one is copied anew each time, so values are gathered in blocks as long as the square root of the
    array, and these in an array of blocks."""
    side = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / side).cast("int")), lambda k: F.slice(xs, k * side + 1, side))
    more = lambda s, out, value: F.struct(s.alias("s"), F.concat(out, F.array(value)).alias("out"))

    def within(acc, block):
        none = F.struct(acc["s"].alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(block, none, lambda a, x: bound(step(a["s"], x), lambda r: more(r["s"], a["out"], r["o"])))

    none = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    told = F.aggregate(blocks, none, lambda acc, block: bound(within(acc, block), lambda r: more(r["s"], acc["out"], r["out"])), lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(xs) == 0, F.array().cast(f"array<{kind}>")).when(xs.isNotNull(), told)
