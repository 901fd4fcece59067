"""Frozen spans: replaced by numbered marks that must come back complete and in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = r"/\*__FROZEN_(\d+)__\*/"


def mark(i: Column) -> Column:
    return F.concat(F.lit("/*__FROZEN_"), i.cast("string"), F.lit("__*/"))


def mask(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """rows with masked_text and spans: matches of pattern, in order, each replaced by its numbered mark."""
    cut = rows.select("*", F.explode(F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")))).alias("_x"))
    parts = F.transform("_x.gaps", lambda g, i: F.when(i == 0, g).otherwise(F.concat(mark(i - 1), g)))
    return cut.select(*rows.columns, F.array_join(parts, "").alias("masked_text"), F.col("_x.hits").alias("spans"))


def unmask(masked: Column, spans: Column) -> Column:
    """The text with its spans back; null unless every mark is there once, in order."""
    found = F.regexp_extract_all(masked, F.lit(MARK), F.lit(1))
    wanted = F.transform(spans, lambda s, i: i.cast("string"))
    parts = F.transform(F.arrays_zip(F.split(masked, MARK, -1).alias("g"), spans.alias("s")), lambda p: F.concat(p["g"], F.coalesce(p["s"], F.lit(""))))
    return F.when(F.array_join(found, ",") == F.array_join(wanted, ","), F.array_join(parts, ""))
