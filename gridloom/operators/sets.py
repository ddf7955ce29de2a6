"""Missing keys, missing attributes, set operations between listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.attrs import REQUIRED_ATTRS


def missing_outputs(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected rows without a found one; both sides are reduced to distinct keys before they meet."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def missing_attrs(attrs: Column, required: tuple[str, ...] = REQUIRED_ATTRS) -> Column:
    """Required keys a map lacks, sorted."""
    wanted = F.array(*[F.lit(key) for key in required])
    return F.array_sort(F.array_except(wanted, F.map_keys(attrs)))


def family_union(families: dict[str, DataFrame]) -> DataFrame:
    """Rows of all families with the family's name; columns are matched by name."""
    named = [df.withColumn("family", F.lit(name)) for name, df in families.items()]
    return reduce(DataFrame.unionByName, named)


def set_difference(required: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct required rows that are not present."""
    return required.subtract(present.select(*required.columns).distinct())
