"""First-failure cascades, reasons to categories, and attempts up to the first stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a reason begins and its category, in order, for whole files and for single symbols.
CATEGORIES = {
    "file": [
        ("sentinel", "sentinel"), ("symbol", "symbol-set"), ("declaration", "declaration"), ("no canonical", "loc"), ("project lint", "style"),
        ("documentation", "docs"), ("API", "api"), ("tests", "tests"), ("compile", "tests"), ("rust shadow", "tests"), ("invalid syntax", "syntax"),
        ("invalid schema", "schema"), ("model error", "backend"), ("abstained", "abstained"), ("duplicate", "duplicate"),
    ],
    "symbol": [
        ("no canonical", "loc"), ("project lint", "style"), ("documentation", "docs"), ("API", "api"), ("tests", "tests"), ("invalid syntax", "syntax"),
        ("invalid schema", "schema"), ("declaration", "declaration"), ("duplicate", "duplicate"), ("model error", "backend"), ("abstained", "abstained"),
    ],
}


def first_failure(gates: dict[str, Column]) -> Column:
    """Name of the first gate that fails, in order; null if none does."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(gates.items()):
        out = F.when(failed, name).otherwise(out)
    return out


def reason_category(reason: Column, contract: str) -> Column:
    """Category of the first beginning that a reason has, else other."""
    out = F.lit("other")
    for prefix, category in reversed(CATEGORIES[contract]):
        out = F.when(reason.startswith(prefix), category).otherwise(out)
    return out


def sql_category(contract: str, reason: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({reason}, '{p}') THEN '{c}'" for p, c in CATEGORIES[contract]) + " ELSE 'other' END"


def consumed(attempts: DataFrame, key: str, order: str, stops: Column, most: int) -> DataFrame:
    """The attempts up to and with the first that stops, at most so many; the cap is the feature."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.count_if(stops).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return attempts.withColumns({"_stops": before, "_k": F.row_number().over(w)}).where((F.coalesce("_stops", F.lit(0)) == 0) & (F.col("_k") <= most)).drop("_stops", "_k")
