"""Phrases that stand several times in a row, found in Arrow batches: all texts of a batch are one array of units."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, StructField, StructType

LOOP = StructType([StructField("first", IntegerType()), StructField("till", IntegerType())])


def longest_loop(keys: Column | str, most: Column | str, least_times: int, least_units: int) -> Column:
    """(first, till) of the units of an array of strings that are a phrase of at most `most` units, `least_times` times or
    more in a row, `least_units` or more in all, in which some unit isn't empty; null where there is none. The most
    repetitions win, then the most units, the earliest start, the shortest phrase.

    A run of units that equal the ones `p` further on, found by the next unit that doesn't, is the repetition of a phrase of
    p."""

    @arrow_udf(LOOP)
    def of_batch(keys: pa.Array, most: pa.Array) -> pa.Array:
        number = lambda x: pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        counts, bound = number(pc.list_value_length(keys)), number(most)
        units = keys.flatten()
        code, size = number(units.dictionary_encode().indices), len(units)
        text, at = np.repeat(np.arange(len(counts)), counts), np.arange(size)
        onward = lambda marks: np.minimum.accumulate(np.where(marks, at, size)[::-1])[::-1]  # noqa: E731 the next mark
        spoken = onward(pc.fill_null(pc.not_equal(units, ""), False).to_numpy(zero_copy_only=False))
        found = [np.zeros((0, 5), np.int64)]
        for p in range(1, int(min(bound.max(initial=0), size)) + 1):
            same = np.zeros(size, bool)
            same[: size - p] = (code[p:] == code[: size - p]) & (text[p:] == text[: size - p])
            times = (onward(~same) - at) // p + 1
            loop = np.flatnonzero((times >= least_times) & (times * p >= least_units) & (spoken < at + p) & (p <= bound[text]))
            found.append(np.stack([text[loop], times[loop], times[loop] * p, -loop, np.full(len(loop), -p)], axis=1))
        every = np.concatenate(found)
        every = every[np.lexsort(every.T[::-1])]
        best = every[np.flatnonzero(np.diff(every[:, 0], append=-1))]
        first, till = np.zeros(len(counts), np.int32), np.zeros(len(counts), np.int32)
        none = np.ones(len(counts), bool)
        of = best[:, 0]
        first[of] = -best[:, 3] - (np.cumsum(counts) - counts)[of]
        till[of] = first[of] + best[:, 2]
        none[of] = False
        return pa.StructArray.from_arrays([pa.array(first), pa.array(till)], ["first", "till"], mask=pa.array(none))

    return of_batch(keys, most)
