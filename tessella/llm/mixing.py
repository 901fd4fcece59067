"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Sizes are numbers of words. Sources, in code point order with null last, get weights in turn; each source's target is its
share of all words, but at most CAP times its own size: what is above goes to the others by weight, until none is above.
A document of source s is then wanted target_s / size_s times: the whole part for sure, the fraction with that
probability. Fractions are rounded dependently. In a chunk of about CHUNK documents, the largest open one is paired with
the pooled mass (probability times words) of those still open: mass moves one way or the other, at random such that each
probability stays the same on average, until the document is 0 or 1 or the pool is all 0 or all 1; a pool's members shift
together. So the chunk's mass is kept exactly, and one document is left over, mostly its smallest. Chunks are folded side
by side; what they leave is dealt to chunks and folded again, in a tree, until each source has one document left, which
is drawn by its probability. A source's words differ from its target by less than the size of that one document. Draws
are hashes of ids, so reruns agree on any cluster.

Defined results: null and blank texts have size 0 and are taken as often as the whole part says; rows that repeat doc_id,
source and size are one unit and share one decision; a source of size 0 has target 0; an empty table gives an empty
result; other columns are ignored, or kept by mix, whatever they are called. A source that holds
most rows is dealt over chunks by hash; only per-source sums are ordered, by ranges, and only totals reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACES, scratch, settle, unused

WEIGHTS, CAP, CHUNK, SEED, EPS = (5, 2, 1), 3, 128, 20260101, 1e-12


def units(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size and m, the number of rows that agree in all three."""
    n = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), "")).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))


def _placed(sources: DataFrame) -> DataFrame:
    """source, source_size and place from 0 in the order of sources: sorted by ranges, and each range numbered from where the one before ended."""
    rows = sources.orderBy(F.col("source").asc_nulls_last()).select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    rows = settle(rows, "mix-ranges")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("part", "first", before.alias("before")), "part").select("source", "source_size", (F.col("row") - F.col("first") + F.col("before")).alias("place"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size and target of each source of units."""
    rows = _placed(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")))
    rows = settle(rows.select("source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int")).alias("weight")), "mix-sources")
    most = cap * F.col("source_size")
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level > most
        r = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, most)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("free"), F.count_if(above).alias("n")).first()
        if not r["free"]:
            return rows.select("source", "source_size", most.cast("double").alias("target"))
        if r["n"] == full:
            return rows.select("source", "source_size", F.least(F.col("weight") * level, most.cast("double")).alias("target"))
        level, full = (r["all"] - (r["capped"] or 0.0)) / r["free"], r["n"]


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chance(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(9007199254740881)) / F.lit(9007199254740881.0)


def _fold(items: Column, words: Column, mass: Column, kind: str, level: int) -> Column:
    """Pair each document, largest first, with the pool of the later ones; struct of the one left over and an array of those decided.

    State: words and mass of the pool, and scale, shift: a member's probability is scale * p + shift by now.
    """
    item = f"struct<light:bigint,h:bigint,doc_id:{kind},size:bigint,m:bigint,p:double>"
    start = F.struct(words.alias("words"), mass.alias("mass"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"), F.lit(None).cast(item).alias("rest"), F.expr(f"cast(array() as array<struct<doc_id:{kind},size:bigint,m:bigint,more:int>>)").alias("done"))

    def step(a: Column, t: Column) -> Column:
        w = (t["size"] * t["m"]).cast("double")
        p = F.least(F.greatest(a["scale"] * t["p"] + a["shift"], F.lit(0.0)), F.lit(1.0))
        room = F.struct(p.alias("p"), F.greatest(a["words"] - w, F.lit(0.0)).alias("words"), F.greatest(a["mass"] - w * p, F.lit(0.0)).alias("mass"))

        def moved(v: Column) -> Column:
            spare = F.greatest(v["words"] - v["mass"], F.lit(0.0))
            up, down = (1 - v["p"]) * w, v["p"] * w
            rise, fall = F.least(up, v["mass"]), F.least(down, spare)

            def to(mass: Column, scale: Column, shift: Column, more: int | None, left: Column | None = None) -> Column:
                rest = a["rest"] if left is None else F.struct(t["light"].alias("light"), t["h"].alias("h"), t["doc_id"].alias("doc_id"), t["size"].alias("size"), t["m"].alias("m"), left.alias("p"))
                done = a["done"] if more is None else F.concat(a["done"], F.array(F.struct(t["doc_id"].alias("doc_id"), t["size"].alias("size"), t["m"].alias("m"), F.lit(more).alias("more"))))
                return F.struct(v["words"].alias("words"), mass.alias("mass"), scale.alias("scale"), shift.alias("shift"), rest.alias("rest"), done.alias("done"))

            none, one = F.lit(0.0), F.lit(1.0)
            lower, higher = 1 - up / v["mass"], down / spare
            return (
                F.when(v["p"] < EPS, to(v["mass"], a["scale"], a["shift"], 0))
                .when(v["p"] > 1 - EPS, to(v["mass"], a["scale"], a["shift"], 1))
                .when(v["words"] <= 0, to(none, none, none, None, v["p"]))
                .when(_chance(t["doc_id"], t["size"], F.lit(SEED + level)) * (rise + fall) < fall,
                      F.when(up < v["mass"], to(v["mass"] - up, a["scale"] * lower, a["shift"] * lower, 1)).otherwise(to(none, none, none, None, v["p"] + v["mass"] / w)))
                .otherwise(F.when(down < spare, to(v["mass"] + down, a["scale"] * (1 - higher), a["shift"] * (1 - higher) + higher, 0)).otherwise(to(v["words"], none, one, None, v["p"] - spare / w)))
            )

        return _let(room, moved)

    return F.aggregate(items, start, step)


def rounded(open_units: DataFrame) -> DataFrame:
    """Units (source, doc_id, size, m, p) with 0 < p < 1 and size > 0 to (source, doc_id, size, m, more): 1 if the fraction rounds up."""
    kind, (found, level) = dict(open_units.dtypes)["doc_id"], (None, 0)
    w = (F.col("size") * F.col("m")).cast("double")
    while True:
        counts = open_units.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
        dealt = open_units.join(counts, F.col("source").eqNullSafe(F.col("s"))).withColumn("h", F.xxhash64("doc_id", "size", F.lit(SEED - 1 - level)))
        chunk = dealt.groupBy("source", "chunks", F.pmod("h", "chunks").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct((-F.col("size") * F.col("m")).alias("light"), "h", "doc_id", "size", "m", "p"))).alias("items"), F.sum(w).alias("w"), F.sum(w * F.col("p")).alias("mass"))
        folded = settle(chunk.select("source", "chunks", _fold(F.col("items"), F.col("w"), F.col("mass"), kind, level).alias("f")).select("source", "chunks", "f.rest", "f.done"), "mix-level")
        fields = ["source", "x.doc_id", "x.size", "x.m"]
        part = folded.select("source", F.explode("done").alias("x")).select(*fields, "x.more")
        last = folded.where("chunks = 1 and rest is not null").select("source", F.col("rest").alias("x"))
        part = part.unionByName(last.select(*fields, (_chance(F.col("x.doc_id"), F.col("x.size"), F.lit(SEED)) < F.col("x.p")).cast("int").alias("more")))
        found = part if found is None else found.unionByName(part)
        open_units = folded.where("chunks > 1 and rest is not null").select("source", F.col("rest").alias("x")).select(*fields, "x.p")
        level += 1
        if open_units.isEmpty():
            return found


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per unit: doc_id, source, size, m, source_size, target, copies (how often the mix takes each of its rows)."""
    with scratch():
        sized = settle(units(docs, doc_id, source, text), "mix-units")
        goal = targets(sized, weights, cap)
        often = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        whole = settle(goal.withColumns({"whole": F.floor(often).cast("int"), "p": often - F.floor(often)}), "mix-targets")
        named = whole.select(F.col("source").alias("s"), "source_size", "target", "whole", "p")
        joined = sized.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        open_ = (F.col("p") > 0) & (F.col("size") > 0)
        more = rounded(settle(joined.where(open_).select("source", "doc_id", "size", "m", "p"), "mix-open"))
        more = more.join(named, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "m", "source_size", "target", (F.col("whole") + F.col("more")).alias("copies"))
        found = joined.where(~open_).select("doc_id", "source", "size", "m", "source_size", "target", F.col("whole").alias("copies")).unionByName(more)
        return settle(found, "mix-copies", keep=True)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents, each as many times as the mix takes it."""
    d, s, n, c, copy = unused(docs, "d", "s", "n", "c", "copy")
    taken = copies(docs, weights, cap, doc_id, source, text).where("copies > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n), F.col("copies").alias(c))
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), "")).cast("long")
    match = F.col(doc_id).eqNullSafe(F.col(d)) & F.col(source).eqNullSafe(F.col(s)) & (words == F.col(n))
    return docs.join(taken, match).select(*[docs[f"`{x}`"] for x in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col(c))).alias(copy)).drop(copy)
