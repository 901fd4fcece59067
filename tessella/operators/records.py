"""What gates, transactions, comparisons of runs and training leave behind as records: counted, merged, normalised, checked."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Results of a mutation run and what they are called, how many entries count, and what starts and ends feedback on an interface.
STATUSES = {"CaughtMutant": "Caught", "MissedMutant": "Missed", "TimeoutMutant": "Timeout"}
MUTANTS_CAP, SHOWN = 150, 6
FEEDBACK_HEAD = [
    "Your previous rewrite CHANGED THE PUBLIC API. That is forbidden and is",
    "why it was rejected — no test was even run. Exact violations:",
]
FEEDBACK_TAIL = [
    "Fix them ALL in the next attempt:",
    "  * every symbol listed under `missing=` must exist again with its",
    "    original name AND its original signature (parameter names, order,",
    "    and default values are all part of the API);",
    "  * every symbol under `changed=` must get its original signature back;",
    "  * every symbol under `added=` is a new public name you introduced —",
    "    delete it or rename it with a leading underscore (`_helper`).",
    "Names are given as `symbol`, `Class.method` or `Type::method`.",
]
#: Multiplier, increment and start of the generator of test cases, and how many cases are made.
CASE_A, CASE_C, CASE_SEED, CASES = 6364136223846793005, 1442695040888963407, 0x5EEDFACE, 48


def feedback(violations: Column) -> Column:
    """What is said about an array of violations, the first SHOWN of them by name; empty without any."""
    shown = F.transform(F.slice(violations, 1, SHOWN), lambda v: F.concat(F.lit("  - "), v))
    lines = F.concat(F.array(*[F.lit(x) for x in FEEDBACK_HEAD]), shown, F.array(*[F.lit(x) for x in FEEDBACK_TAIL]))
    return F.when(F.size(violations) > 0, F.array_join(lines, "\n")).otherwise("")


def outside(names: Column, group: Column) -> Column:
    """Violated names that a group does not hold, neither whole nor by their last part; none left means that only the group's own surface changed."""
    last = lambda n: F.element_at(F.split(n, r"\."), -1)
    simple = F.transform(group, last)
    return F.filter(names, lambda n: ~F.array_contains(group, n) & ~F.array_contains(simple, last(n)))


def transaction_totals(attempts: DataFrame) -> DataFrame:
    """attempts (tx, category, accepted, loc) to one row: groups, calls, proposed (neither a failed model nor an abstention), accepted, accepted_loc."""
    proposed = ~F.col("category").isin("backend", "abstained")
    return attempts.agg(
        F.countDistinct("tx").alias("groups"), F.count(F.lit(1)).alias("calls"), F.count_if(proposed).alias("proposed"),
        F.count_if("accepted").alias("accepted"), F.coalesce(F.sum(F.when(F.col("accepted"), F.col("loc"))), F.lit(0)).alias("accepted_loc"),
    )


def statuses(outcomes: DataFrame) -> DataFrame:
    """outcomes (run, seq, name, summary) to (run, name, status): of the first MUTANTS_CAP entries of a run those that name a mutant and have a known result, the last entry of a name. The cap is the contract."""
    w = Window.partitionBy("run").orderBy("seq")
    rows = outcomes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= MUTANTS_CAP)
    known = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])
    rows = rows.withColumn("status", F.try_element_at(known, F.col("summary"))).where("name is not null and status is not null")
    return rows.groupBy("run", "name").agg(F.max_by("status", "k").alias("status"))


def kill_verdict(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, status) twice to one row: measured, dropped (killed before, not after), ok. Nothing measured vetoes where there was something before."""
    known = list(STATUSES.values())
    both = before.where(F.col("status").isin(known)).withColumnRenamed("status", "b").join(after.where(F.col("status").isin(known)).withColumnRenamed("status", "a"), "name")
    totals = both.agg(F.count(F.lit(1)).alias("measured"), F.count_if((F.col("b") == "Caught") & (F.col("a") != "Caught")).alias("dropped"))
    had = before.agg((F.count(F.lit(1)) > 0).alias("had"))
    return totals.join(F.broadcast(had), F.lit(True)).select("measured", "dropped", ((F.col("dropped") == 0) & ((F.col("measured") > 0) | ~F.col("had"))).alias("ok"))


def merged_reports(reports: DataFrame) -> DataFrame:
    """reports (key, verified, skipped, mismatches, nondeterministic) of many processes to a row a key, with exercised: verified at all."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("verified", "skipped", "mismatches", "nondeterministic")]
    return reports.groupBy("key").agg(*sums).withColumn("exercised", F.col("verified") > 0)


def alike(a: Column, b: Column, kind: str) -> Column:
    """Whether two values of a kind are equal: true, false, or null where it cannot be told.

    Numbers compare across whole and decimal, a missing number equals a missing number; text, flags and nulls compare as they are; "opaque" is never told.
    """
    if kind == "opaque":
        return F.when(a.isNull() & b.isNull(), True)
    if kind == "number":
        return (a.cast("double").eqNullSafe(b.cast("double"))) | (F.isnan(a.cast("double")) & F.isnan(b.cast("double")))
    return a.eqNullSafe(b)


def all_alike(parts: list[Column]) -> Column:
    """False if any part is, else null if any cannot be told, else true."""
    return reduce(lambda x, y: F.when(~F.coalesce(x, F.lit(True)) | ~F.coalesce(y, F.lit(True)), False).when(x.isNull() | y.isNull(), None).otherwise(True), parts)


def mismatches(before: DataFrame, after: DataFrame, examples: int = 3) -> DataFrame:
    """Calls (fn, call, error, result, items, arguments) of two versions to (fn, kind, n, examples): the first thing in which a call differs.

    Kinds in order: exception, result, iterator-length, iterator-item, argument-mutation. examples are the first calls of a kind; their number is the contract.
    """
    pairs = before.alias("b").join(after.alias("a"), ["fn", "call"])
    differ = lambda c: ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    sizes = ~F.size("b.items").eqNullSafe(F.size("a.items"))
    kind = F.when(differ("error"), "exception").when(differ("result"), "result").when(sizes, "iterator-length").when(differ("items"), "iterator-item").when(differ("arguments"), "argument-mutation")
    rows = pairs.select("fn", "call", kind.alias("kind")).where("kind is not null")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("fn", "kind").orderBy("call")))
    return first.groupBy("fn", "kind").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= examples, F.col("call")))).alias("examples"))


def retained(events: DataFrame) -> DataFrame:
    """events (layer, accepted, rolled_back) to how many a layer accepted and how many of these stayed."""
    return events.groupBy("layer").agg(F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & ~F.col("rolled_back")).alias("retained"))


def removed_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, symbol) of before that after no longer has."""
    return before.select("file", "symbol").distinct().join(after.select("file", "symbol"), ["file", "symbol"], "left_anti")


def checked_total(rows: DataFrame, reported: Column, counted: Column) -> DataFrame:
    """rows as they are; reading them fails where a reported total is not what was counted again."""
    return rows.where(F.assert_true(reported.eqNullSafe(counted), F.concat(F.lit("reported "), reported.cast("string"), F.lit(", counted "), counted.cast("string"))).isNull())


def cached(requests: DataFrame) -> DataFrame:
    """requests (seq, content) with digest and hit: whether the same content was asked for before."""
    digest = F.sha2("content", 256)
    return requests.select("seq", digest.alias("digest")).withColumn("hit", F.row_number().over(Window.partitionBy("digest").orderBy("seq")) > 1)


def too_few(counts: DataFrame, least: dict[str, int]) -> DataFrame:
    """counts (name, n) to (name, n, least) of the settings that are not met; what is not counted has 0."""
    wanted = counts.sparkSession.createDataFrame(list(least.items()), "name string, least long")
    return wanted.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), "least").where("n < least")


def cases(values: list[list[str]], limit: int = CASES) -> list[tuple[str, ...]]:
    """Arguments to try: every combination where these are at most limit, else the first of each and combinations drawn without repeats."""
    if not values:
        return []
    total = reduce(lambda n, v: n * len(v), values, 1)
    if total <= limit:
        return list(itertools.product(*values))
    found, state = [tuple(v[0] for v in values)], CASE_SEED
    known = set(found)
    while len(found) < limit:
        pick = []
        for v in values:
            state = (state * CASE_A + CASE_C) % (1 << 64)
            pick.append(v[(state >> 33) % len(v)])
        if tuple(pick) not in known:
            known.add(tuple(pick))
            found.append(tuple(pick))
    return found


def culprits(items: list, passes: Callable[[list], bool]) -> list:
    """Items without which a check passes, found by halves: a half that fails alone is searched on, and what fails only together is kept whole."""
    if not items or passes(items):
        return []
    if len(items) == 1:
        return items
    half = len(items) // 2
    found = culprits(items[:half], passes) + culprits(items[half:], passes)
    return found or items
