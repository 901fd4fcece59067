"""Records of gates, transactions, runs and training, read off the events, order lines, parts and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import register
from tessella.functions import business as b
from tessella.functions import text as t
from tessella.operators import candidates, records
from tessella.sources.tables import table


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


QUOTED = lambda lines: "'" + "\n".join(lines).replace("'", "''") + "'"


@register("api_feedback", f"""WITH v AS (SELECT p_brand AS file, list_transform(list_sort(list(p_partkey)), lambda k: 'missing=[''p' || k || ''']') AS v FROM part WHERE p_size > 20 GROUP BY 1)
SELECT b.file, CASE WHEN v.file IS NULL THEN '' ELSE {QUOTED(records.FEEDBACK_HEAD)} || chr(10) || array_to_string(list_transform(v[1:6], lambda x: '  - ' || x), chr(10)) || chr(10) || {QUOTED(records.FEEDBACK_TAIL)} END AS feedback FROM (SELECT DISTINCT p_brand AS file FROM part) b LEFT JOIN v USING (file)""")
def api_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("p_size") > 20, F.col("p_partkey"))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_sort(F.collect_list(key)).alias("k"))
    said = F.transform("k", lambda k: F.concat(F.lit("missing=['p"), k.cast("string"), F.lit("']")))
    return rows.select("file", records.feedback(said).alias("feedback"))


@register("api_clean", "SELECT o_orderkey AS id, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS clean FROM orders")
def api_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all violated names belong to the group: names are methods of it, of another, or its own."""
    k = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Box._f"), k)).when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Other._f"), k)).otherwise("size")
    left = records.outside(F.array(name, F.concat(F.lit("_f"), k)), F.array(F.concat(F.lit("Box._f"), k)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.size(left) == 0).alias("clean"))


@register("transaction_totals", "SELECT count(DISTINCT user_id) AS groups, count(*) AS calls, count_if(event_type NOT IN ('error', 'signup')) AS proposed, count_if(event_type = 'purchase') AS accepted, CAST(coalesce(sum(CAST(round(value) AS BIGINT)) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) AS accepted_loc FROM events")
def transaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "backend").when(F.col("event_type") == "signup", "abstained").otherwise("tests")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("tx"), kind.alias("category"), (F.col("event_type") == "purchase").alias("accepted"), F.round("value").cast("long").alias("loc"))
    return records.transaction_totals(rows)


OUTCOMES = {"click": "CaughtMutant", "view": "MissedMutant", "purchase": "TimeoutMutant", "signup": "Unviable"}


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of mutation runs, a user a run; an error names no mutant."""
    known = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    name = F.when(F.col("event_type") != "error", F.concat(F.lit("m"), F.col("event_id") % 40))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), name.alias("name"), F.try_element_at(known, F.col("event_type")).alias("summary"))


@register("mutant_statuses", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), f AS (SELECT user_id AS run, 'm' || event_id % 40 AS name, CASE event_type WHEN 'click' THEN 'Caught' WHEN 'view' THEN 'Missed' WHEN 'purchase' THEN 'Timeout' END AS status, k FROM e WHERE k <= {records.MUTANTS_CAP} AND event_type <> 'error')
SELECT run, name, status FROM f WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run, name ORDER BY k DESC) = 1""")
def mutant_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.statuses(outcomes(spark, sf_dir))


@register("kill_verdict", """WITH b AS (SELECT doc_id AS name, CASE WHEN quality = 1 THEN 'Caught' ELSE 'Missed' END AS b FROM labels), a AS (SELECT doc_id AS name, CASE WHEN toxic = 0 THEN 'Caught' ELSE 'Timeout' END AS a FROM labels)
SELECT count(*) AS measured, count_if(b = 'Caught' AND a <> 'Caught') AS dropped, count_if(b = 'Caught' AND a <> 'Caught') = 0 AND count(*) > 0 AS ok FROM a JOIN b USING (name)""")
def kill_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, name = table(spark, sf_dir, "labels"), F.col("doc_id").alias("name")
    before = rows.select(name, F.when(F.col("quality") == 1, "Caught").otherwise("Missed").alias("status"))
    return records.kill_verdict(before, rows.select(name, F.when(F.col("toxic") == 0, "Caught").otherwise("Timeout").alias("status")))


@register("merged_reports", "SELECT l_partkey AS key, count_if(l_returnflag = 'A') AS verified, count_if(l_returnflag = 'N') AS skipped, count_if(l_returnflag = 'R') AS mismatches, CAST(0 AS BIGINT) AS nondeterministic, count_if(l_returnflag = 'A') > 0 AS exercised FROM lineitem GROUP BY 1")
def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda f: (F.col("l_returnflag") == f).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), flag("A").alias("verified"), flag("N").alias("skipped"), flag("R").alias("mismatches"), F.lit(None).cast("long").alias("nondeterministic"))
    return records.merged_reports(rows)


@register("call_mismatches", """WITH p AS (SELECT o_custkey AS fn, o_orderkey AS call, CASE WHEN o_orderkey % 10 = 0 THEN 'exception' WHEN o_orderkey % 10 = 1 THEN 'result' WHEN o_orderkey % 10 = 2 THEN 'iterator-length' WHEN o_orderkey % 10 = 3 THEN 'iterator-item' WHEN o_orderkey % 10 = 4 THEN 'argument-mutation' END AS kind FROM orders)
SELECT fn, kind, count(*) AS n, list_sort(list(call))[1:3] AS examples FROM p WHERE kind IS NOT NULL GROUP BY 1, 2""")
def call_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a function a customer, called once an order; the second differs by the order's last digit."""
    k, d = F.col("o_orderkey"), F.col("o_orderkey") % 10
    base = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fn"), k.alias("call"))
    first = base.withColumns({"error": F.lit(None).cast("string"), "result": F.lit(1), "items": F.array(F.lit(1), F.lit(2)), "arguments": F.lit("x")})
    d = F.col("call") % 10
    second = base.withColumns({
        "error": F.when(d == 0, "ValueError"), "result": F.when(d <= 1, 2).otherwise(1), "arguments": F.when(d == 4, "y").otherwise("x"),
        "items": F.when(d == 2, F.array(F.lit(1))).when(d == 3, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2))),
    })
    return records.mismatches(first, second)


@register("values_alike", "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN false WHEN l_linenumber = 3 THEN NULL ELSE true END AS alike FROM lineitem")
def values_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole against decimal numbers, not a number against itself, nulls, and values that cannot be compared."""
    q, r = F.col("l_quantity"), F.col("l_returnflag")
    opaque = F.when(F.col("l_linenumber") == 3, "a")
    parts = [records.alike(q.cast("long"), q, "number"), records.alike(F.lit(float("nan")), F.lit(float("nan")), "number"), records.alike(r, F.when(r == "R", "Q").otherwise(r), "text"), records.alike(opaque, opaque, "opaque")]
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), records.all_alike(parts).alias("alike"))


@register("retained_counts", "SELECT event_type AS layer, count_if(value > 10) AS accepted, count_if(value > 10 AND user_id % 3 <> 0) AS retained FROM events GROUP BY 1")
def retained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.retained(table(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), (F.col("value") > 10).alias("accepted"), (F.col("user_id") % 3 == 0).alias("rolled_back")))


@register("removed_symbols", "SELECT DISTINCT l_orderkey AS file, l_partkey AS symbol FROM lineitem WHERE l_returnflag = 'R' AND (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_returnflag <> 'R')")
def removed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("symbol"), "l_returnflag")
    return records.removed_symbols(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"))


@register("checked_totals", "SELECT l_orderkey AS file, count(*) AS total FROM lineitem GROUP BY 1")
def checked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.count(F.lit(1)).alias("total"), F.count("l_linenumber").alias("again"))
    return records.checked_total(rows, F.col("total"), F.col("again")).select("file", "total")


@register("cache_hits", "SELECT doc_id AS seq, sha256(text) AS digest, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS hit FROM documents")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.cached(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("content")))


LEAST = {"crates": 40, "pairs": 50, "eval": 5, "train": 1_000_000_000}


@register("settings_not_met", f"WITH n AS (SELECT 'crates' AS name, count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'pairs', count(*) FROM labels WHERE quality = 1 UNION ALL SELECT 'eval', count(*) FROM benchmark), l(name, least) AS (VALUES {', '.join(f'({k!r}, {v})' for k, v in LEAST.items())}) SELECT name, coalesce(n, 0) AS n, CAST(least AS BIGINT) AS least FROM l LEFT JOIN n USING (name) WHERE coalesce(n, 0) < least")
def settings_not_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    counts = read("documents").agg(F.countDistinct("source").alias("n")).select(F.lit("crates").alias("name"), "n")
    counts = counts.unionByName(read("labels").where("quality = 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("pairs").alias("name"), "n"))
    return records.too_few(counts.unionByName(read("benchmark").agg(F.count(F.lit(1)).alias("n")).select(F.lit("eval").alias("name"), "n")), LEAST)


@register("promoted_files", """WITH s AS (SELECT l_orderkey AS path, l_partkey % 50 AS root, l_quantity < 45 AS eligible FROM lineitem) SELECT 'd/m' || path || '.py' AS path FROM s GROUP BY s.path HAVING bool_and(eligible) AND count(DISTINCT root) = 1 AND s.path % 7 <> 0""")
def promoted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files whose symbols are the lines; groups by the part's number, modules of every seventh order are named elsewhere."""
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("d/m"), k, F.lit(".py")).alias("path"), F.concat_ws("::", k, "l_linenumber").alias("node"), (F.col("l_quantity") < 45).alias("eligible"), (F.col("l_partkey") % 50).alias("root"))
    live = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.concat(F.lit("m"), F.col("o_orderkey")).alias("stem"))
    return candidates.promoted(rows.drop("root"), rows.select("root", F.col("node").alias("member")), live)


@register("covered_groups", "SELECT a.l_partkey AS grp, bool_or(b.l_linenumber IS NOT NULL) AS covered FROM lineitem a LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber BETWEEN a.l_linenumber AND a.l_linenumber + 1 GROUP BY 1")
def covered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two lines an order line, grouped by part; lines returned in state A ran."""
    rows = table(spark, sf_dir, "lineitem")
    spans = rows.select(F.col("l_partkey").alias("grp"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 2).alias("end"))
    return candidates.covered(spans, rows.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct(), width=2)


@register("ranked_groups", "SELECT p_partkey AS name, row_number() OVER (ORDER BY CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE 2 END, p_size DESC, p_brand, p_partkey) AS id FROM part")
def ranked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = F.when(F.col("p_size") % 3 == 0, False).when(F.col("p_size") % 3 == 2, True)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("grp"), covered.alias("covered"), F.col("p_size").alias("loc"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("name"))
    return candidates.ranked(rows).select("name", "id")


@register("ledger_rows", "SELECT p_partkey AS sku, p_partkey || ' ' || lpad(CAST(p_size * 13 - 20 AS VARCHAR), 6, ' ') || ' ' || CASE WHEN p_size * 13 - 20 <= 0 THEN 'E' WHEN p_size * 13 - 20 <= 20 THEN 'L' WHEN p_size * 13 - 20 <= 500 THEN 'N' ELSE 'H' END AS line FROM part")
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_hand = F.col("p_size") * 13 - 20
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), b.ledger_row(F.col("p_partkey").cast("string"), on_hand).alias("line"))


@register("order_quantities", "SELECT p_partkey AS sku, CASE WHEN d <= 0 THEN 0 ELSE CAST(floor(sqrt(2.0::DOUBLE * d * 8.0::DOUBLE / 0.22::DOUBLE)) AS BIGINT) END AS quantity, CASE WHEN d = 0 THEN 0.0::DOUBLE ELSE p_size * 52.0::DOUBLE / d END AS weeks FROM (SELECT p_partkey, p_size, p_partkey % 97 - 1 AS d FROM part)")
def order_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    demand = F.col("p_partkey") % 97 - 1
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), b.order_quantity(demand).alias("quantity"), b.weeks_of_cover(F.col("p_size"), demand).alias("weeks"))


@register("normal_rows", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'missing date' WHEN o_orderkey % 5 = 1 THEN 'bad date 2016-13-01' WHEN o_orderkey % 7 = 0 THEN 'missing category' WHEN o_orderkey % 11 = 0 THEN 'amount must be finite' END AS error,
 CASE WHEN error IS NULL THEN CASE WHEN o_orderkey % 3 = 0 THEN 'NA' ELSE 'EMEA' END END AS region, CASE WHEN error IS NULL THEN -CAST(o_orderkey AS DOUBLE) END AS amount FROM orders""")
def normal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.when(k % 5 == 1, "2016-13-01").when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    amount = F.when(k % 11 == 0, "much").otherwise(F.concat(F.lit("($"), F.format_number(k, 0), F.lit(")")))
    row = b.normal_row(day, F.when(k % 7 != 0, F.col("o_orderpriority")), F.when(k % 3 != 0, "EMEA"), amount, F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), row.alias("r")).select("id", "r.error", "r.region", "r.amount")


@register("checked_sums", "SELECT c_mktsegment AS segment, CAST(sum(CAST(round(c_acctbal) AS BIGINT)) AS DOUBLE) AS total FROM customer GROUP BY 1")
def checked_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(b.checked_sum(F.round("c_acctbal"), "c_acctbal").alias("total"))


@register("parsed_csv", """SELECT p_partkey AS id, p_name AS a, CASE WHEN p_size % 2 = 0 THEN p_brand || ', "' || p_type || '"' ELSE '' END AS b FROM part""")
def parsed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two rows a part, quoted and with a field too many, or with a field missing, blank lines and carriage returns between."""
    quoted = t.csv_row(F.col("p_name"), F.concat(F.col("p_brand"), F.lit(', "'), F.col("p_type"), F.lit('"')), F.lit("beyond"))
    text = F.concat(F.lit("a,b\r\n \t\r\n"), F.when(F.col("p_size") % 2 == 0, quoted).otherwise(F.col("p_name")), F.lit("\r\n\n"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(t.csv_rows_of(text)).alias("r"))
    return rows.select("id", F.col("r")["a"].alias("a"), F.col("r")["b"].alias("b"))


@register("text_tables", """WITH s AS (SELECT n_regionkey AS id, list([n_name, CAST(n_nationkey AS VARCHAR), repeat('x', n_nationkey % 3)] ORDER BY n_nationkey) AS r, greatest(6, max(length(n_name))) AS w, greatest(3, max(length(CAST(n_nationkey AS VARCHAR)))) AS v, greatest(4, max(n_nationkey % 3)) AS u FROM nation GROUP BY 1)
SELECT id, rpad('Nation', CAST(w AS INTEGER), ' ') || '  ' || rpad('Key', CAST(v AS INTEGER), ' ') || '  Mark' || chr(10) || repeat('-', w) || '  ' || repeat('-', v) || '  ' || repeat('-', u) || chr(10) ||
 array_to_string(list_transform(r, lambda x: rpad(x[1], CAST(w AS INTEGER), ' ') || '  ' || lpad(x[2], CAST(v AS INTEGER), ' ') || '  ' || x[3]), chr(10)) AS shown FROM s""")
def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string"), F.repeat(F.lit("x"), F.col("n_nationkey") % 3)).alias("c"))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(cells)).alias("r"))
    return rows.select("id", t.table_text(["Nation", "Key", "Mark"], F.transform("r", lambda x: x["c"])).alias("shown"))


@register("expense_report", """WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END AS v FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment AS segment, o_orderpriority AS category, count(*) AS n, count_if(v >= 0) AS charges, count_if(v < 0) AS refunds, CAST(sum(v) AS BIGINT) AS net FROM o GROUP BY GROUPING SETS ((c_mktsegment), (c_mktsegment, o_orderpriority))""")
def expense_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges, refunds and net of each segment, whole (no category) and by category."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    v = cents("o_totalprice") * F.when(F.col("o_orderkey") % 4 == 0, -1).otherwise(1)
    segment, category = F.col("c_mktsegment"), F.col("o_orderpriority")
    found = rows.withColumn("v", v).groupingSets([[segment], [segment, category]], segment, category).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") >= 0).alias("charges"), F.count_if(F.col("v") < 0).alias("refunds"), F.sum("v").alias("net"))
    return found.select(segment.alias("segment"), category.alias("category"), "n", "charges", "refunds", "net")
