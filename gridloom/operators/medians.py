"""Exact medians per group: in place where a group fits a task, by radix selection where it does not."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import materialise

#: Rows of a group that one task may sort; the ranks of a larger one are narrowed digit by digit.
TASK_ROWS = 1_000_000
#: Bits of a digit of the 64-bit keys.
DIGIT = 16

_SIGN = np.uint64(1 << 63)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(right[key])
    return same


def median_by(df: DataFrame, keys: list[str], bands: list[str], task_rows: int = TASK_ROWS, keep: bool = False) -> DataFrame:
    """Exact median of each band per group, NULLs ignored; an even count averages the two middle values.

    Rows are counted per group first, which combines before anything is sent. Groups of up to ``task_rows`` rows are placed
    by group, because a median cannot be combined from partial results that are smaller than the values; the larger
    ones are solved by ``_radix_medians``, which never brings a group together. Both ways are exact. ``keep`` writes the
    needed columns down first, so that a selective input is read and filtered once; without it the count reads the keys.
    """
    needed = df.select(*keys, *bands)
    needed = materialise(needed, "median-rows") if keep else needed
    sizes = needed.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > task_rows)
    large = materialise(sizes.select(*keys), "large-groups")
    if large.isEmpty():
        return _median_in_place(needed, keys, bands)
    others = needed.join(large, null_safe(needed, large, keys), "left_anti")
    return _median_in_place(others, keys, bands).unionByName(_radix_medians(needed, large, keys, bands))


def _median_in_place(df: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Medians of groups that fit a task: one shuffle and one sort by group, shared by all bands.

    A window is used because the plain aggregate would build and serialise every group's values twice.
    """
    group = Window.partitionBy(*keys)
    return df.select(*keys, *[F.median(band).over(group).alias(band) for band in bands]).dropDuplicates(keys)


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of the values: -inf, numbers, inf, NaN; both zeros are one."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def key_values(keys: np.ndarray) -> np.ndarray:
    """The values of ``ordered_keys``."""
    return np.where(keys & _SIGN, keys & ~_SIGN, ~keys).view(np.float64)


def _keyed(batches):
    for batch in batches:
        keys = ordered_keys(batch.column("_value").to_numpy(zero_copy_only=False).astype(np.float64))
        yield pa.RecordBatch.from_arrays([batch.column("_group"), batch.column("_band"), pa.array(keys.view(np.int64))], ["_group", "_band", "_key"])


def _valued(batches):
    for batch in batches:
        keys = batch.column("_prefix").to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("_group"), batch.column("_band"), batch.column("_high"), pa.array(key_values(keys))], ["_group", "_band", "_high", "_value"])


def select_ranks(keyed: DataFrame) -> DataFrame:
    """The two middle values ``(_group, _band, _high, _value)`` of each group's keys ``(_group, _band, _key)``.

    Radix selection: a histogram of the keys' first digit, combined before it is sent, tells the digit that holds a rank;
    the next round looks at the keys with this digit only, and so on. A histogram has at most ``2 ** DIGIT`` rows a
    group and task, whatever the number of values, and equal values end in one digit like any others.
    """
    group = ["_group", "_band"]
    prefix = F.lit(0).cast("long")
    rest, state = keyed.withColumn("_prefix", prefix), None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftrightunsigned("_key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))
        if state is not None:
            wanted = state.select(*group, F.col("_prefix").alias("_wanted")).distinct()
            seen = F.shiftrightunsigned("_key", shift + DIGIT)
            rest = rest.drop("_prefix").join(wanted, group).where(seen == F.col("_wanted")).withColumnRenamed("_wanted", "_prefix")
            rest = materialise(rest, "median-rest")
        counts = rest.groupBy(*group, "_prefix", digit.alias("_digit")).agg(F.count("*").alias("_n"))
        line = Window.partitionBy(*group, "_prefix").orderBy("_digit")
        placed = counts.withColumn("_to", F.sum("_n").over(line)).withColumn("_from", F.col("_to") - F.col("_n"))
        if state is None:
            total = F.sum("_n").over(Window.partitionBy(*group))
            ranks = F.array(F.struct(F.lit(False).alias("_high"), F.floor((total + 1) / 2).alias("_rank")), F.struct(F.lit(True).alias("_high"), (F.floor(total / 2) + 1).alias("_rank")))
            hit = placed.withColumn("_ranks", ranks).select("*", F.inline("_ranks")).drop("_ranks")
        else:
            hit = placed.join(state, [*group, "_prefix"])
        hit = hit.where((F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_to")))
        longer = F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_digit"))
        state = materialise(hit.select(*group, "_high", longer.alias("_prefix"), (F.col("_rank") - F.col("_from")).alias("_rank")), "median-ranks")
    return state.drop("_rank").mapInArrow(_valued, "_group long, _band int, _high boolean, _value double")


def _radix_medians(rows: DataFrame, large: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Medians of the ``large`` groups by radix selection over order-preserving keys of their values."""
    groups = materialise(large.withColumn("_group", F.monotonically_increasing_id()), "large-group-ids")
    pairs = [F.struct(F.lit(n).alias("_band"), F.col(b).cast("double").alias("_value")) for n, b in enumerate(bands)]
    own = rows.join(groups, null_safe(rows, groups, keys)).select("_group", F.inline(F.array(*pairs))).where("_value IS NOT NULL")
    keyed = materialise(own.mapInArrow(_keyed, "_group long, _band int, _key long"), "median-keys")
    ends = select_ranks(keyed).groupBy("_group", "_band").agg(
        F.max(F.when(~F.col("_high"), F.col("_value"))).alias("_a"), F.max(F.when(F.col("_high"), F.col("_value"))).alias("_b")
    )
    # The same form as the built-in median: equal ends as they are, else half of each.
    mean = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * 0.5 + F.col("_b") * 0.5)
    wide = ends.groupBy("_group").agg(*[F.max(F.when(F.col("_band") == n, mean)).alias(b) for n, b in enumerate(bands)])
    # A group without values of a band has NULL there, and so has one without any.
    return groups.join(wide, "_group", "left").select(*keys, *bands)
