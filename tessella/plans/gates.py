"""Gate cascades, attempts and checkpoints over recorded outcomes; set and multiset comparisons of two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.catalog import register
from tessella.functions.text import tokens, words
from tessella.operators.compare import multiset_difference, surface_changes
from tessella.operators.funnel import CATEGORIES, consumed, first_failure, reason_category, sql_category
from tessella.sources.tables import table

#: Reasons recorded for the event types of the tables, to classify.
REASONS = {"view": "no canonical reduction", "click": "tests failed", "error": "model error: timeout", "purchase": "accepted", "signup": "API changed"}


def reason(c: Column) -> Column:
    return F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), c), F.lit("; "), F.col("props"))


SQL_REASON = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASONS.items()) + " END || '; ' || props"


@register("reason_category", f"SELECT event_id, {sql_category('file', SQL_REASON)} AS file_category, {sql_category('symbol', SQL_REASON)} AS symbol_category FROM events")
def reason_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reason(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", *[reason_category(r, contract).alias(f"{contract}_category") for contract in CATEGORIES])


GATES = [("unchanged", "before = after"), ("syntax", "l_returnflag = 'N' AND l_linenumber = 7"), ("loc", "after > before"), ("docs", "l_linestatus = 'O' AND l_tax > 0.07"), ("api", "l_quantity > 45"), ("tests", "l_discount > 0.08")]


@register("gate_cascade", "WITH t AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS before, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS after FROM lineitem), g AS (SELECT *, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in GATES) + " END AS failed FROM t) SELECT l_returnflag, coalesce(failed, 'accepted') AS verdict, count(*) AS n, CAST(sum(CASE WHEN failed IS NULL THEN before - after ELSE 0 END) AS BIGINT) AS saved FROM g GROUP BY 1, 2")
def gate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda e: F.round(F.expr(e) * 100).cast("long")
    rows = table(spark, sf_dir, "lineitem").withColumns({"before": c("l_extendedprice"), "after": c("l_extendedprice * (1 - l_discount)")})
    rows = rows.withColumn("failed", first_failure({n: F.expr(e) for n, e in GATES}))
    return rows.groupBy("l_returnflag", F.coalesce("failed", F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("failed").isNull(), F.col("before") - F.col("after")).otherwise(0)).alias("saved"))


@register("attempts_consumed", """WITH t AS (SELECT *, sum(CASE WHEN length(text) < 200 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, count(*) AS attempts, count_if(length(text) < 200) > 0 AS accepted FROM t WHERE coalesce(stops, 0) = 0 AND k <= 3 GROUP BY conv_id""")
def attempts_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consumed(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") < 200, most=3)
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("attempts"), (F.count_if(F.length("text") < 200) > 0).alias("accepted"))


@register("duplicate_attempts", "SELECT role, count_if(rn > 1) AS duplicates, count(*) AS n FROM (SELECT role, row_number() OVER (PARTITION BY conv_id, role, length(text) % 10 ORDER BY turn) AS rn FROM conversations) GROUP BY role")
def duplicate_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id", "role", F.length("text") % 10).orderBy("turn")
    return table(spark, sf_dir, "conversations").select("role", F.row_number().over(w).alias("rn")).groupBy("role").agg(F.count_if(F.col("rn") > 1).alias("duplicates"), F.count(F.lit(1)).alias("n"))


@register("feedback_chain", "SELECT conv_id, turn, lag(role) OVER w AS feedback, min(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS first_accepted FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def feedback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w.orderBy("turn")).alias("feedback"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w).alias("first_accepted"))


@register("audit_checkpoints", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS restored_to, event_type = 'error' AS rolled_back FROM events")
def audit_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(mark, ignorenulls=True).over(w).alias("restored_to"), (F.col("event_type") == "error").alias("rolled_back"))


@register("surface_diff", """WITH b AS (SELECT p_brand AS file, p_partkey AS symbol, p_type AS signature FROM part WHERE p_size <= 40), a AS (SELECT p_brand AS file, CASE WHEN p_partkey % 17 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS symbol, CASE WHEN p_partkey % 7 = 0 THEN upper(p_type) || '!' ELSE p_type END AS signature FROM part WHERE p_size >= 5)
SELECT coalesce(b.file, a.file) AS file, coalesce(b.symbol, a.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'missing' WHEN b.symbol IS NULL THEN 'added' ELSE 'changed' END AS violation
FROM b FULL JOIN a ON b.file = a.file AND b.symbol = a.symbol WHERE (b.signature IS DISTINCT FROM a.signature) AND coalesce(b.file, a.file) IN (SELECT file FROM b)""")
def surface_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, t = F.col("p_partkey"), F.col("p_type")
    before = p.where("p_size <= 40").select(F.col("p_brand").alias("file"), k.alias("symbol"), t.alias("signature"))
    after = p.where("p_size >= 5").select(F.col("p_brand").alias("file"), F.when(k % 17 == 0, k + 1000000).otherwise(k).alias("symbol"), F.when(k % 7 == 0, F.concat(F.upper(t), F.lit("!"))).otherwise(t).alias("signature"))
    return surface_changes(before, after)


@register("multiset_diff", r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS token FROM documents), b AS (SELECT token FROM t WHERE lang = 'fr'), a AS (SELECT token FROM t WHERE lang = 'es')
SELECT token, count(*) AS surplus FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY token""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(tokens(F.col("text"))).alias("token"))
    return multiset_difference(rows.where("lang = 'fr'").drop("lang"), rows.where("lang = 'es'").drop("lang"))


@register("docs_preserved", r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents)
SELECT b.doc_id, list_sort(b.w) = list_sort(a.w) AS docs_multiset_ok, b.w = a.w AS docs_layout_ok FROM t b JOIN t a ON a.doc_id = b.doc_id + 1""")
def docs_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", words(F.lower("text")).alias("w"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return rows.join(after, "doc_id").select("doc_id", (F.array_sort("w") == F.array_sort("v")).alias("docs_multiset_ok"), (F.col("w") == F.col("v")).alias("docs_layout_ok"))


@register("tx_all_or_nothing", """WITH t AS (SELECT l_orderkey, l_quantity <= 48 AS ok, CAST(l_quantity AS BIGINT) AS q FROM lineitem), g AS (SELECT *, bool_and(ok) OVER (PARTITION BY l_orderkey) AS all_ok FROM t)
SELECT l_orderkey AS tx, count(*) AS sites, bool_and(ok) AS accepted, CAST(sum(CASE WHEN all_ok THEN q ELSE 0 END) AS BIGINT) AS accepted_loc FROM g GROUP BY l_orderkey""")
def tx_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("l_quantity") <= 48
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg(F.count(F.lit(1)).alias("sites"), F.bool_and(ok).alias("accepted"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return rows.select("tx", "sites", "accepted", F.when(F.col("accepted"), F.col("q")).otherwise(0).alias("accepted_loc"))


@register("kill_superset", """WITH b AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'Caught' ELSE 'Missed' END AS s FROM labels), a AS (SELECT doc_id, CASE WHEN toxic = 0 THEN 'Caught' ELSE 'Timeout' END AS s FROM labels WHERE doc_id % 10 <> 3), m AS (SELECT doc_id, b.s AS bs, a.s AS as_ FROM b JOIN a USING (doc_id))
SELECT doc_id AS mutant_id, as_ AS status_after FROM m WHERE bs = 'Caught' AND as_ <> 'Caught'""")
def kill_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    killed = rows.where("quality = 1").select(F.col("doc_id").alias("mutant_id"))
    after = rows.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("mutant_id"), F.when(F.col("toxic") == 0, "Caught").otherwise("Timeout").alias("status_after"))
    return after.join(killed, "mutant_id", "left_semi").where("status_after <> 'Caught'")


@register("file_drift", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'gone' ELSE 'new' END AS drift FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def file_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", F.lit(True).alias("a"))
    end = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("b")).distinct()
    return start.join(end, "doc_id", "full_outer").where("a is null or b is null").select("doc_id", F.when(F.col("b").isNull(), "gone").otherwise("new").alias("drift"))


#: Documents whose hashes are put together at a time.
RANGE = 4096


@register("content_hashes", f"WITH r AS (SELECT source, doc_id // {RANGE} AS part, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL), d AS (SELECT source, count(DISTINCT sha256(text)) AS distinct_files FROM documents GROUP BY 1) SELECT source, sha256(string_agg(h, '' ORDER BY part)) AS tree_sha256, any_value(distinct_files) AS distinct_files FROM r JOIN d USING (source) GROUP BY source")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of a source's documents in order: ranges of ids are hashed first, so that no task holds all hashes of a source."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), ""), 256)
    parts = rows.groupBy("source", F.floor(F.col("doc_id") / RANGE).alias("part")).agg(joined("doc_id").alias("h"))
    distinct = rows.groupBy("source").agg(F.countDistinct("h").alias("distinct_files"))
    return parts.groupBy("source").agg(joined("part").alias("tree_sha256")).join(distinct, "source")
