"""Benchmark analytics: validity, weighted reductions, cohorts, medians, matched comparison, funnels, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.catalog import register
from tessella.functions.business import percent
from tessella.functions.text import token_count, words
from tessella.sources.tables import table


def cents(c: str | Column) -> Column:
    return F.round(F.col(c) * 100 if isinstance(c, str) else c * 100).cast("long")


def long(c: Column) -> Column:
    return c.cast("long")


@register("tokens_by_source", r"""
SELECT source, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'))) AS BIGINT) AS tokens,
 CAST(sum(n_chars) AS BIGINT) AS chars, bool_and(length(text) = n_chars) AS all_measured FROM documents GROUP BY source""")
def tokens_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(token_count(F.col("text"))).alias("tokens"), F.sum("n_chars").alias("chars"), F.bool_and(F.length("text") == F.col("n_chars")).alias("all_measured"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as benchmark runs: size before and after in cents, by market segment; open orders do not count as valid."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("before"), F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("reduced"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    valid = (F.col("o_orderstatus") != "O") & (F.col("before") > 0)
    return rows.select("o_orderkey", F.col("c_mktsegment").alias("cohort"), valid.alias("valid"), "before", F.when(valid, F.col("reduced")).otherwise(F.col("before")).alias("final"))


RUNS = """WITH li AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS before, sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS reduced FROM lineitem GROUP BY 1),
runs AS (SELECT o_orderkey, c_mktsegment AS cohort, o_orderstatus <> 'O' AND before > 0 AS valid, CAST(before AS BIGINT) AS before,
 CAST(CASE WHEN o_orderstatus <> 'O' AND before > 0 THEN reduced ELSE before END AS BIGINT) AS final
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN li ON o_orderkey = l_orderkey)
"""


@register("run_rows", RUNS + "SELECT *, CASE WHEN before = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (before - final) / before END AS pct FROM runs")
def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).withColumn("pct", percent(F.col("before"), F.col("final")))


@register("weighted_reduction_by_segment", RUNS + """SELECT cohort, count(*) AS projects, count_if(valid) AS valid, CAST(sum(before) AS BIGINT) AS before, CAST(sum(final) AS BIGINT) AS final,
 CASE WHEN sum(before) = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * CAST(sum(before) - sum(final) AS BIGINT) / CAST(sum(before) AS BIGINT) END AS pct FROM runs GROUP BY GROUPING SETS ((cohort), ())""")
def weighted_reduction_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).rollup("cohort").agg(F.count(F.lit(1)).alias("projects"), F.count_if("valid").alias("valid"), F.sum("before").alias("before"), F.sum("final").alias("final"))
    return rows.withColumn("pct", percent(F.col("before"), F.col("final")))


@register("median_and_counts", RUNS + """SELECT cohort, CAST(median(100.0::DOUBLE * (before - final) / before) AS DOUBLE) AS median_pct, count_if(before > final) AS reduced,
 count_if(NOT valid) AS unmeasured, count(*) > 0 AND bool_and(valid) AS all_valid FROM runs WHERE before > 0 GROUP BY cohort""")
def median_and_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).where("before > 0")
    return rows.groupBy("cohort").agg(F.median(percent(F.col("before"), F.col("final"))).alias("median_pct"), F.count_if(F.col("before") > F.col("final")).alias("reduced"), F.count_if(~F.col("valid")).alias("unmeasured"), ((F.count(F.lit(1)) > 0) & F.bool_and("valid")).alias("all_valid"))


@register("matched_compare", """WITH s AS (SELECT l_partkey, l_returnflag, count(*) AS n, max(l_linestatus) AS audit, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2),
b AS (SELECT * FROM s WHERE l_returnflag = 'A'), a AS (SELECT * FROM s WHERE l_returnflag = 'R')
SELECT b.l_partkey AS project, b.q AS before, a.q AS after, b.n = a.n AND b.audit IS NOT DISTINCT FROM a.audit AS comparable, CASE WHEN b.n = a.n AND b.audit IS NOT DISTINCT FROM a.audit THEN a.q - b.q END AS delta FROM b JOIN a USING (l_partkey)""")
def matched_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_linestatus").alias("audit"), F.sum(long(F.round("l_quantity"))).alias("q"))
    side = lambda flag, name: s.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("project"), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "audit", "q")])
    same = (F.col("b_n") == F.col("a_n")) & F.col("b_audit").eqNullSafe(F.col("a_audit"))
    return side("A", "b").join(side("R", "a"), "project").select("project", F.col("b_q").alias("before"), F.col("a_q").alias("after"), same.alias("comparable"), F.when(same, F.col("a_q") - F.col("b_q")).alias("delta"))


#: Shapes a text may show, in order; several may apply, and a text of none is "other".
SHAPES = [("symbols", "[#$%&*]{2}"), ("table", r"\|"), ("mail", "@"), ("number", "[0-9]{3}"), ("list", r"\n- "), ("question", r"\?"), ("short", "^.{0,200}$")]


@register("census_multilabel", "WITH t AS (SELECT n_chars, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in SHAPES) + """], lambda x: x IS NOT NULL) AS tags FROM documents),
u AS (SELECT n_chars, unnest(CASE WHEN len(tags) = 0 THEN ['other'] ELSE tags END) AS shape FROM t), g AS (SELECT shape, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM u GROUP BY 1)
SELECT shape, docs, chars, row_number() OVER (ORDER BY chars DESC, shape) AS rank FROM g""")
def census_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), n) for n, p in SHAPES]))
    rows = table(spark, sf_dir, "documents").select("n_chars", F.explode(F.when(F.size(tags) == 0, F.array(F.lit("other"))).otherwise(tags)).alias("shape"))
    groups = rows.groupBy("shape").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    return groups.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("chars"), "shape")).cast("long"))


@register("funnel_pivot", "SELECT user_id, count(*) AS attempts, " + ", ".join(f"count_if(event_type = '{e}') AS n_{e}" for e in ("click", "view", "purchase", "signup", "error")) + " FROM events GROUP BY user_id")
def funnel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), *[F.count_if(F.col("event_type") == e).alias(f"n_{e}") for e in ("click", "view", "purchase", "signup", "error")])


@register("best_cell", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def best_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_type", "event_id", "value")


@register("layer_yield", """SELECT event_id, user_id, v AS size, lag(v) OVER w - v AS saved, v < lag(v) OVER w AS committed FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def layer_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = Window.partitionBy("user_id").orderBy("ts", "event_id"), cents("value")
    return table(spark, sf_dir, "events").select("event_id", "user_id", v.alias("size"), (F.lag(v).over(w) - v).alias("saved"), (v < F.lag(v).over(w)).alias("committed"))


@register("rule_histogram", r"SELECT lang, w AS word, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(lower(text), '[ \t\n\v\f\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2")
def rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", F.explode(words(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@register("test_share", "SELECT source, CAST(sum(n_chars) FILTER (WHERE lang = 'en') AS BIGINT) AS inside, CAST(sum(n_chars) AS BIGINT) AS total, coalesce(CAST(sum(n_chars) FILTER (WHERE lang = 'en') AS DOUBLE), 0) / sum(n_chars) AS share FROM documents GROUP BY source")
def test_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.sum(F.when(F.col("lang") == "en", F.col("n_chars")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(inside.alias("inside"), F.sum("n_chars").alias("total"), (F.coalesce(inside.cast("double"), F.lit(0.0)) / F.sum("n_chars")).alias("share"))


@register("promotion", """WITH g AS (SELECT user_id, count_if(event_id % 2 = 0) AS base_calls, count_if(event_id % 2 = 1) AS new_calls, CAST(coalesce(sum(CAST(round(value) AS BIGINT)) FILTER (WHERE event_id % 2 = 0), 0) AS BIGINT) AS base_loc,
 CAST(coalesce(sum(CAST(round(value) AS BIGINT)) FILTER (WHERE event_id % 2 = 1), 0) AS BIGINT) AS new_loc, count_if(event_id % 2 = 1 AND value < 1) = 0 AS no_loss FROM events GROUP BY 1)
SELECT user_id, base_calls, new_calls, base_loc, new_loc, no_loss, base_calls = new_calls AND base_calls > 0 AND new_loc * base_calls >= base_loc * new_calls AS promoted FROM g""")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, v = F.col("event_id") % 2 == 1, long(F.round("value"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(~new).alias("base_calls"), F.count_if(new).alias("new_calls"), F.coalesce(F.sum(F.when(~new, v)), F.lit(0)).alias("base_loc"), F.coalesce(F.sum(F.when(new, v)), F.lit(0)).alias("new_loc"), (F.count_if(new & (F.col("value") < 1)) == 0).alias("no_loss"))
    ahead = F.col("new_loc") * F.col("base_calls") >= F.col("base_loc") * F.col("new_calls")
    return rows.withColumn("promoted", (F.col("base_calls") == F.col("new_calls")) & (F.col("base_calls") > 0) & ahead)
