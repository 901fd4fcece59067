"""Keyed surfaces, multisets and sets of two states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surface_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, symbol, signature) twice to (file, symbol, violation): missing, changed or added; files only in after do not count."""
    b, a = before.withColumnRenamed("signature", "old"), after.withColumnRenamed("signature", "new")
    rows = b.withColumn("was", F.lit(True)).join(a.withColumn("is", F.lit(True)), ["file", "symbol"], "full_outer")
    rows = rows.where(~F.col("old").eqNullSafe(F.col("new")) | F.col("was").isNull() | F.col("is").isNull()).join(before.select("file").distinct(), "file", "left_semi")
    return rows.select("file", "symbol", F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").otherwise("changed").alias("violation"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left beyond those of right, with their number; counts are taken first, so nothing is expanded."""
    keys = left.columns
    n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys, "left")
    return n.withColumn("surplus", F.col("n") - F.coalesce("m", F.lit(0))).where("surplus > 0").select(*keys, "surplus")


def same_multiset(left: DataFrame, right: DataFrame) -> bool:
    return multiset_difference(left, right).isEmpty() and multiset_difference(right, left).isEmpty()


def is_superset(left: DataFrame, right: DataFrame) -> bool:
    """Whether left holds every row of right."""
    return right.join(left.distinct(), left.columns, "left_anti").isEmpty()
