"""Stock, purchasing and finance reports over parts, orders and line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.catalog import register
from tessella.functions import business as b
from tessella.sources.tables import table

#: A stock view of parts: on hand, level to reorder at, most to hold.
STOCK = "SELECT p_partkey AS sku, p_name AS name, p_brand AS area, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey * 7 % 500 - 20 AS BIGINT) END AS on_hand, CAST(p_size AS BIGINT) AS reorder, CAST(p_size * 9 AS BIGINT) AS most, CAST(round(p_retailprice * 100) AS BIGINT) AS cost FROM part"


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    on_hand = F.when(k % 11 != 0, k * 7 % 500 - 20)
    return table(spark, sf_dir, "part").select(k.alias("sku"), F.col("p_name").alias("name"), F.col("p_brand").alias("area"), on_hand.alias("on_hand"), F.col("p_size").cast("long").alias("reorder"), (F.col("p_size") * 9).cast("long").alias("most"), F.round(F.col("p_retailprice") * 100).cast("long").alias("cost"))


FLAG = "CASE WHEN on_hand IS NULL THEN 'UNKNOWN' WHEN on_hand <= 0 THEN 'STOCKOUT' WHEN on_hand <= reorder THEN 'LOW' WHEN on_hand <= 400 THEN 'NORMAL' ELSE 'OVERSTOCK' END"


@register("stock_flags", f"SELECT sku, {FLAG} AS flag, CASE {FLAG} WHEN 'STOCKOUT' THEN 1 WHEN 'LOW' THEN 2 WHEN 'NORMAL' THEN 5 ELSE 9 END AS priority FROM ({STOCK})")
def stock_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stock(spark, sf_dir).withColumn("flag", b.stock_flag(F.col("on_hand"), F.col("reorder")))
    return rows.select("sku", "flag", b.priority(F.col("flag")).alias("priority"))


@register("tally_by_flag", f"SELECT {FLAG} AS flag, count(*) AS n FROM ({STOCK}) GROUP BY 1")
def tally_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock_flags(spark, sf_dir).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@register("restock_plan", f"SELECT sku, most - on_hand + 6 AS quantity, on_hand <= reorder AS low FROM ({STOCK}) WHERE most - on_hand + 6 > 0")
def restock_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stock(spark, sf_dir).select("sku", b.restock_quantity(F.col("on_hand"), F.col("most")).alias("quantity"), (F.col("on_hand") <= F.col("reorder")).alias("low"))
    return rows.where("quantity is not null")


TIER = "CASE WHEN l_quantity >= 100 THEN 0 WHEN l_quantity >= 50 THEN 90 WHEN l_quantity >= 10 THEN 95 ELSE 100 END"


@register("valuate", f"SELECT p_brand AS area, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT) * CASE WHEN l_quantity >= 100 THEN 85 WHEN l_quantity >= 50 THEN 90 WHEN l_quantity >= 10 THEN 95 ELSE 100 END) AS BIGINT) AS value_e4, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def valuate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.round(100 * (1 - b.discount_tier(F.col("l_quantity")))).cast("long")
    value = F.col("l_quantity").cast("long") * F.round(F.col("p_retailprice") * 100).cast("long") * rate
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("area")).agg(F.sum(value).alias("value_e4"), F.count(F.lit(1)).alias("lines"))


@register("order_total", "WITH t AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice) AS BIGINT)) AS BIGINT) AS subtotal FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT l_orderkey, subtotal, subtotal + CASE WHEN subtotal < 250 THEN 4.5::DOUBLE ELSE 0::DOUBLE END AS total FROM t")
def order_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long") * F.round("p_retailprice").cast("long")).alias("subtotal"))
    return rows.withColumn("total", F.col("subtotal") + F.when(F.col("subtotal") < b.FREE_FROM, b.FREIGHT).otherwise(0.0))


@register("apply_order", f"WITH l AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem), c AS (SELECT l_orderkey, bool_and(coalesce(q <= on_hand, false)) AS ok FROM l LEFT JOIN ({STOCK}) s ON sku = l_partkey GROUP BY 1) SELECT l_partkey AS sku, CAST(sum(q) AS BIGINT) AS allocated FROM l JOIN c USING (l_orderkey) WHERE ok GROUP BY 1")
def apply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of an order or none; each line is held against stock on its own."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("sku"), F.col("l_quantity").cast("long").alias("q"))
    checked = lines.join(stock(spark, sf_dir).select("sku", "on_hand"), "sku", "left").groupBy("l_orderkey").agg(F.bool_and(F.coalesce(F.col("q") <= F.col("on_hand"), F.lit(False))).alias("ok"))
    return lines.join(checked.where("ok"), "l_orderkey", "left_semi").groupBy("sku").agg(F.sum("q").alias("allocated"))


@register("reconcile", f"WITH c AS (SELECT l_partkey AS sku, max(CAST(l_quantity AS BIGINT)) AS counted FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT sku, on_hand, coalesce(counted, on_hand) - on_hand AS delta FROM ({STOCK}) LEFT JOIN c USING (sku) WHERE coalesce(counted, on_hand) <> on_hand")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("sku")).agg(F.max(F.col("l_quantity").cast("long")).alias("counted"))
    delta = F.coalesce("counted", "on_hand") - F.col("on_hand")
    return stock(spark, sf_dir).join(counts, "sku", "left").select("sku", "on_hand", delta.alias("delta")).where("delta <> 0")


@register("busiest_area", "SELECT p_brand AS area, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS moved FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING sum(CAST(l_quantity AS BIGINT)) > -1 ORDER BY moved DESC, area LIMIT 1")
def busiest_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("area")).agg(F.sum(F.col("l_quantity").cast("long")).alias("moved")).where("moved > -1").orderBy(F.desc("moved"), "area").limit(1)


@register("move_log", "WITH m AS (SELECT l_partkey AS sku, l_orderkey, l_linenumber, sum(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END * CAST(l_quantity AS BIGINT)) AS moved FROM lineitem GROUP BY ALL) SELECT sku, l_orderkey, l_linenumber, CAST(sum(moved) OVER (PARTITION BY sku ORDER BY l_orderkey, l_linenumber) AS BIGINT) AS balance FROM m")
def move_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).otherwise(-1)
    moves = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("sku"), "l_orderkey", "l_linenumber").agg(F.sum(sign * F.col("l_quantity").cast("long")).alias("moved"))
    w = Window.partitionBy("sku").orderBy("l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return moves.select("sku", "l_orderkey", "l_linenumber", F.sum("moved").over(w).alias("balance"))


@register("stock_report", f"SELECT sku, replace(name, ',', ';') || ',' || CAST(coalesce(on_hand, 0) AS VARCHAR) || ',' || {FLAG} AS line FROM ({STOCK})")
def stock_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("name", F.lit(","), F.lit(";"))
    return stock(spark, sf_dir).select("sku", F.concat_ws(",", name, F.coalesce("on_hand", F.lit(0)).cast("string"), b.stock_flag(F.col("on_hand"), F.col("reorder"))).alias("line"))


def amount(c: str = "o_totalprice") -> Column:
    return F.round(F.col(c) * 100).cast("long")


REGION = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))


@register("monthly_dense", "SELECT m AS month, (m + 2) // 3 AS quarter, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM range(1, 13) r(m) LEFT JOIN (SELECT month(o_orderdate) AS m, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) <> 2 GROUP BY 1) USING (m)")
def monthly_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months, those without orders as zeros."""
    got = table(spark, sf_dir, "orders").where((F.year("o_orderdate") == 1997) & (F.month("o_orderdate") != 2)).groupBy(F.month("o_orderdate").cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount()).alias("total"))
    return spark.range(1, 13).withColumnRenamed("id", "month").join(got, "month", "left").select("month", b.quarter(F.col("month")).cast("long").alias("quarter"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


@register("region_summary", f"SELECT r_name AS region, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM {REGION} GROUP BY 1")
def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount()).alias("total"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("category_pivot", f"SELECT r_name AS region, {', '.join(f'''CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE c_mktsegment = '{s}'), 0) AS BIGINT) AS {s.lower()}''' for s in SEGMENTS)} FROM {REGION} GROUP BY 1")
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales(spark, sf_dir).groupBy(F.col("r_name").alias("region")).pivot("c_mktsegment", SEGMENTS).agg(F.sum(amount())).na.fill(0)
    return rows.select("region", *[F.col(s).alias(s.lower()) for s in SEGMENTS])


@register("category_first_seen", "SELECT o_orderpriority AS category, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total, row_number() OVER (ORDER BY min(o_orderkey)) AS place FROM orders GROUP BY 1")
def category_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount()).alias("total"), F.min("o_orderkey").alias("first"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("first")).cast("long")).drop("first")


@register("top_expenses", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' ORDER BY amount DESC, o_orderkey LIMIT 5")
def top_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderdate between timestamp_ntz '1996-01-01' and timestamp_ntz '1997-12-31'")
    return rows.select("o_orderkey", amount().alias("amount")).orderBy(F.desc("amount"), "o_orderkey").limit(5)


@register("aging_status", "SELECT CASE WHEN d <= 0 THEN 'paid' WHEN d <= 15 THEN 'due' WHEN d <= 45 THEN 'overdue' ELSE 'collections' END AS status, count(*) AS n FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) - 30 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
def aging_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(b.age_status(F.datediff("l_shipdate", "o_orderdate") - 30).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("credit_debit", "SELECT c_mktsegment AS segment, count_if(c_acctbal >= 0) AS credits, count_if(c_acctbal < 0) AS debits, CAST(coalesce(sum(CAST(round(c_acctbal * 100) AS BIGINT)) FILTER (WHERE c_acctbal >= 0), 0) AS BIGINT) AS credit, CAST(coalesce(sum(CAST(round(c_acctbal * 100) AS BIGINT)) FILTER (WHERE c_acctbal < 0), 0) AS BIGINT) AS debit FROM customer GROUP BY 1")
def credit_debit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, plus = amount("c_acctbal"), F.col("c_acctbal") >= 0
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_if(plus).alias("credits"), F.count_if(~plus).alias("debits"), F.coalesce(F.sum(F.when(plus, v)), F.lit(0)).alias("credit"), F.coalesce(F.sum(F.when(~plus, v)), F.lit(0)).alias("debit"))
