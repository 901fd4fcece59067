"""Contracts of replies, transactions, order texts and sales rows; rails that keep candidates out; guarded stock moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.candidates import parents

#: Limits of a reply and of a transaction.
REPLY_CHARS, REPLY_BYTES, SITES, HELPER_CHARS = 32_000, 96 * 1024, 16, 32_000


def reply(text: Column) -> Column:
    """A reply without its code fence, as JSON text; null where it abstains or is no JSON object within the limits."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    fits = (F.length(bare) <= REPLY_CHARS) & (F.octet_length(bare) <= REPLY_BYTES)
    return F.when(fits & bare.startswith("{") & F.get_json_object(bare, "$").isNotNull(), bare)


def occurs(text: Column, part: Column) -> Column:
    """How often a part stands in a text, without overlaps; 0 for an empty part."""
    return F.when(part == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, part))) / F.greatest(F.length(part), F.lit(1))).cast("int"))


def helper_fault(helper: Column) -> Column:
    """Why a transaction's helper cannot stand: too long, not one function, public or generic; null if it can."""
    head = F.substring_index(helper, "{", 1)
    return (
        F.when(F.coalesce(helper, F.lit("")) == "", "abstained").when(F.length(helper) > HELPER_CHARS, "helper")
        .when(F.size(F.regexp_extract_all(helper, F.lit(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s"), F.lit(0))) != 1, "one function")
        .when(head.rlike(r"\bpub\b"), "private").when(head.rlike(r"\bfn\s+\w+\s*<"), "generic")
    )


def transaction_fault(sites: DataFrame, files: DataFrame, most: int | None = SITES) -> DataFrame:
    """sites (tx, path, region, anchor, helper), files (path, text) to (tx, fault): the first rule a transaction breaks, or null.

    most: sites that a transaction may have, null for any number. A path may be given whole, or by a name that only one file has; region and anchor stand in the file exactly once.
    """
    name = F.substring_index("path", "/", -1)
    known = files.select(F.col("path").alias("full"), name.alias("name"), "text")
    lone = known.join(known.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("name"), "name", "left_semi")
    exact = known.select(F.col("full").alias("path"), F.col("text").alias("t1"))
    short = lone.select(F.col("name").alias("path"), F.col("text").alias("t2"))
    text = F.coalesce("t1", "t2")
    rows = sites.join(exact, "path", "left").join(short, "path", "left")
    rows = rows.withColumns({"n": occurs(text, F.col("region")), "m": occurs(text, F.col("anchor")), "bad": helper_fault(F.col("helper"))})
    once = lambda c: F.bool_and(F.coalesce(F.col(c) == 1, F.lit(False)))
    found = rows.groupBy("tx").agg(F.count(F.lit(1)).alias("sites"), F.min("bad").alias("bad"), F.bool_or(text.isNull()).alias("lost"), once("n").alias("once"), once("m").alias("anchored"))
    return found.select("tx", F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("sites") > F.lit(most), "sites").when(F.col("lost"), "path").when(~F.col("once"), "region").when(~F.col("anchored"), "anchor").alias("fault"))


def off_rails(candidates: DataFrame, folders: DataFrame, literals: DataFrame) -> DataFrame:
    """candidates (path, name) outside blocked folders that share no beginning of six letters with a literal (value); equi-joins on every parent folder."""
    hit = candidates.select("path", F.explode(parents(F.col("path"))).alias("folder")).join(folders, "folder", "left_semi").select("path").distinct()
    starts = literals.where(F.length("value") >= 6).select(F.substring("value", 1, 6).alias("start")).distinct()
    rows = candidates.join(hit, "path", "left_anti").withColumn("start", F.when(F.length("name") >= 6, F.substring("name", 1, 6)))
    return rows.join(starts, "start", "left_anti").select("path", "name")


def order_lines(text: Column) -> Column:
    """Array of (sku, qty) of an order's text, blank lines and comments left out; null if any line is broken."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    broken = F.exists(rows, lambda x: ~x.rlike(r"^[^,]+,\s*0*[1-9][0-9]*$"))
    return F.when(~broken, F.transform(rows, lambda x: F.struct(F.upper(F.trim(F.substring_index(x, ",", 1))).alias("sku"), F.trim(F.substring_index(x, ",", -1)).cast("long").alias("qty"))))


def row_faults(row_date: Column, category: Column, region: Column, amount: Column, regions: list[str]) -> Column:
    """Faults of a sales row, in order of its fields."""
    return F.array_compact(F.array(F.when(~F.coalesce(row_date.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"), F.lit(False)), "date"), F.when(F.coalesce(category, F.lit("")) == "", "category"), F.when(~F.coalesce(region.isin(regions), F.lit(False)), "region"), F.when(amount.isNull() | F.isnan(amount), "amount")))


def render(template: Column, values: Column) -> Column:
    """A template with {{name}} filled from a map; null if a name is missing or a brace stays open; values are not scanned again."""
    names = F.regexp_extract_all(template, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1))
    gaps = F.split(template, r"\{\{\s*\w+\s*\}\}", -1)
    open_ = F.exists(gaps, lambda g: F.contains(g, F.lit("{{")) | F.contains(g, F.lit("}}")))
    lost = F.exists(names, lambda n: F.try_element_at(values, n).isNull())
    parts = F.transform(F.arrays_zip(gaps.alias("g"), names.alias("n")), lambda p: F.concat(p["g"], F.coalesce(F.try_element_at(values, p["n"]), F.lit(""))))
    return F.when(~open_ & ~lost, F.array_join(parts, ""))


def guarded_moves(moves: DataFrame) -> DataFrame:
    """moves (sku, seq, kind IN, OUT, REL, ADJ or WR, qty) to (sku, on_hand, allocated, refused): each move holds against the state before it.

    The guards depend on order, so a stock number's moves are folded together; its moves have to fit in a row.
    """
    zero = F.lit(0).cast("long")

    def fold(s: Column, m: Column) -> Column:
        kind, q, free = m["kind"], m["qty"], s["on_hand"] - s["allocated"]
        to = lambda on_hand, allocated, refused: F.struct(on_hand.alias("on_hand"), allocated.alias("allocated"), refused.alias("refused"))
        return (
            F.when((kind == "IN") & (q > 0), to(s["on_hand"] + q, s["allocated"], s["refused"]))
            .when((kind == "OUT") & (q > 0) & (q <= free), to(s["on_hand"], s["allocated"] + q, s["refused"]))
            .when((kind == "REL") & (q > 0) & (q <= s["allocated"]), to(s["on_hand"], s["allocated"] - q, s["refused"]))
            .when((kind == "ADJ") & (s["on_hand"] + q >= s["allocated"]), to(s["on_hand"] + q, s["allocated"], s["refused"]))
            .when((kind == "WR") & (q > 0) & (q <= free), to(s["on_hand"] - q, s["allocated"], s["refused"]))
            .otherwise(to(s["on_hand"], s["allocated"], s["refused"] + 1))
        )

    rows = moves.groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", F.col("qty").cast("long").alias("qty")))).alias("m"))
    start = F.struct(zero.alias("on_hand"), zero.alias("allocated"), zero.alias("refused"))
    return rows.select("sku", F.aggregate("m", start, fold).alias("s")).select("sku", "s.on_hand", "s.allocated", "s.refused")
