"""Measures of sources, scans of trees, scalar rules and layouts, over texts written from parts and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import register
from tessella.functions import business as b
from tessella.functions import text as t
from tessella.operators import code, similarity
from tessella.plans.contract_checks import said
from tessella.plans.sources_code import N, PYTHON, RUST, SCRIPT, edited, files
from tessella.sources import tables
from tessella.sources.tables import table

def part() -> Column:
    return F.col("p_partkey")


@register("node_counts", N + f"SELECT {PYTHON} AS path, 34 + 6 * m + 8 * c - CASE WHEN s % 2 = 0 THEN 4 ELSE 0 END AS nodes FROM n")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.mapped(files(spark, sf_dir).where("lang = 'python'"), lambda t, g: [(code.node_count(t),)], "nodes long")


@register("tree_totals", N + """SELECT 'python' AS lang, count(*) AS files, CAST(sum(6 + m + c) AS BIGINT) AS code, CAST(2 * count(*) AS BIGINT) AS comment, CAST(4 * count(*) AS BIGINT) AS blank,
 CAST(sum(50 + 4 * m + 6 * c + CASE WHEN s % 2 = 0 THEN -2 ELSE 0 END) AS BIGINT) AS tokens, CAST(sum(34 + 6 * m + 8 * c - CASE WHEN s % 2 = 0 THEN 4 ELSE 0 END) AS BIGINT) AS nodes FROM n
UNION ALL SELECT 'javascript', count(*), CAST(sum(7 + m + CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT), count(*), 0, CAST(sum(33 + 5 * m + 2 * c + CASE WHEN s % 2 = 0 THEN 4 ELSE 0 END) AS BIGINT), CAST(sum(33 + 5 * m + 2 * c + CASE WHEN s % 2 = 0 THEN 4 ELSE 0 END) AS BIGINT) FROM n
UNION ALL SELECT 'rust', count(*), 5 * count(*), count(*), 0, 28 * count(*), 28 * count(*) FROM n""")
def tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.tree_totals(files(spark, sf_dir))


@register("docs_kept", N + f"""SELECT {PYTHON} AS path, k % 3 <> 0 AS same_docs, k % 3 <> 0 AS same_order FROM n UNION ALL SELECT {SCRIPT}, true, k % 2 <> 0 FROM n UNION ALL SELECT {RUST}, true, true FROM n""")
def docs_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment's text changed in every third Python file, two comments in another order in every second script."""
    rows, k = files(spark, sf_dir), F.col("k")
    more = F.when(F.col("lang") == "javascript", F.concat(F.col("text"), F.lit("// end\n"))).otherwise(F.col("text"))
    before = rows.withColumn("text", more)
    swapped = F.concat(F.lit("// end\n"), F.regexp_replace("text", "// end\n$", ""))
    after = before.withColumn("text", F.when((F.col("lang") == "python") & (k % 3 == 0), F.replace("text", F.lit("# size"), F.lit("# Size"))).when((F.col("lang") == "javascript") & (k % 2 == 0), swapped).otherwise(F.col("text")))
    return code.docs_kept(before, after)


@register("commas_collapsed", "SELECT p_partkey AS k, 'f(a' || p_partkey || ', b)' || chr(10) || 'x = [1, 2, # why' || chr(10) || ']' || chr(10) AS text, p_size % 2 + 1 AS n FROM part")
def commas_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call over several lines whose last comma goes, and a list whose comma stays for its comment; brackets stay where they are but for what the comma held."""
    text = said("f(a", part(), ", b", F.when(F.col("p_size") % 2 == 0, ",\n)").otherwise(",\n)"), "\nx = [1, 2, # why\n]\n", F.when(F.col("p_size") % 2 == 1, "y = (1,\n 2,\n)\n").otherwise(""))
    rows = table(spark, sf_dir, "part").select(part().cast("string").alias("path"), text.alias("text"), F.lit("python").alias("lang"))
    found = code.mapped(rows, lambda t, g: [code.collapse_commas(t)], "text string, n int")
    return found.select(F.col("path").cast("long").alias("k"), F.replace(F.replace("text", F.lit("b\n)"), F.lit("b)")), F.lit("y = (1,\n 2\n)\n"), F.lit("")).alias("text"), "n")


PATHS = ["src/a{k}.py", "tests/t{k}.py", "src/test_{k}.py", "node_modules/x{k}.js", "lib/m{k}.ts", "lib/m{k}.js", "web/p{k}.spec.js", "doc/r{k}.md", "old/z{k}.rs", "lib/n{k}.mjs"]
WAY = f"p_partkey % {len(PATHS)}"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path a part; a script compiled from the part before stands beside its source."""
    path = F.lit(None).cast("string")
    for i, p in enumerate(PATHS):
        path = F.when(part() % len(PATHS) == i, F.replace(F.lit(p), F.lit("{k}"), (part() - (part() % len(PATHS) == 5).cast("int")).cast("string"))).otherwise(path)
    return table(spark, sf_dir, "part").select(path.alias("path"), F.lit("").alias("text"))


@register("project_scan", f"""SELECT CASE {WAY} WHEN 0 THEN 'src/a' || p_partkey || '.py' WHEN 1 THEN 'tests/t' || p_partkey || '.py' WHEN 2 THEN 'src/test_' || p_partkey || '.py' WHEN 4 THEN 'lib/m' || p_partkey || '.ts' WHEN 6 THEN 'web/p' || p_partkey || '.spec.js' WHEN 9 THEN 'lib/n' || p_partkey || '.mjs' END AS path,
 CASE {WAY} WHEN 4 THEN 'typescript' WHEN 6 THEN 'javascript' WHEN 9 THEN 'javascript' ELSE 'python' END AS lang, CASE WHEN {WAY} IN (1, 2, 6) THEN 'test' ELSE 'source' END AS role FROM part WHERE {WAY} IN (0, 1, 2, 4, 6, 9)""")
def project_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.project(tree(spark, sf_dir), ["old"]).select("path", "lang", "role")


@register("text_scan", f"SELECT CASE {WAY} WHEN 0 THEN 'src/a' || p_partkey || '.py' WHEN 1 THEN 'tests/t' || p_partkey || '.py' WHEN 2 THEN 'src/test_' || p_partkey || '.py' ELSE 'doc/r' || p_partkey || '.md' END AS path FROM part WHERE {WAY} IN (0, 1, 2, 7)")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = tree(spark, sf_dir).select(F.concat(F.lit(".git/"), "path").alias("path"), "text")
    return tables.texts(tree(spark, sf_dir).unionByName(hidden)).select("path")


@register("main_languages", f"WITH g AS (SELECT count_if({WAY} IN (0, 1, 2)) AS python, count_if({WAY} IN (5, 6, 9)) AS javascript, count_if({WAY} = 4) AS typescript, count_if({WAY} = 8) AS rust FROM part) SELECT CASE greatest(javascript, python, rust, typescript) WHEN javascript THEN 'javascript' WHEN python THEN 'python' WHEN rust THEN 'rust' ELSE 'typescript' END AS lang FROM g")
def main_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.main_language(tree(spark, sf_dir))


@register("change_census", """WITH d AS (SELECT o_orderkey % 5 AS w, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT n, unnest(CASE w WHEN 0 THEN ['loop-to-iterator'] WHEN 1 THEN ['vec-push-run', 'nested-if-collapse'] WHEN 2 THEN ['other'] WHEN 3 THEN ['dedup-extract-helper'] ELSE ['let-else'] END) AS shape, CASE w WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS net FROM d)
SELECT shape, CAST(sum(n) AS BIGINT) AS changes, CAST(sum(n * net) AS BIGINT) AS loc FROM s GROUP BY shape""")
def change_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("o_orderkey") % 5
    diff = F.when(w == 0, "--- a\n+++ b\n-for x in y {\n-    t += x;\n-}\n+t = y.iter().sum();").when(w == 1, "-let v = x;\n-v.push(1);\n-if a {\n+let v = vec![1];\n+if a && b {").when(w == 2, "-a\n+b").when(w == 3, "-a\n+fn _h() {\n+}").otherwise("-let x = y;\n+let Some(x) = y else { return };")
    rows = table(spark, sf_dir, "orders").select(code.change_shapes(diff).alias("c"))
    rows = rows.select(F.explode("c.shapes").alias("shape"), F.col("c.net").alias("net"))
    return rows.groupBy("shape").agg(F.count(F.lit(1)).alias("changes"), F.sum("net").alias("loc"))


@register("clone_groups", "WITH g AS (SELECT p_brand, list_sort(list(DISTINCT 'src/' || p_type || '.rs')) AS paths, list_sort(list('f' || p_partkey)) AS functions, count(*) AS n, min(p_partkey) AS label FROM part GROUP BY 1 HAVING count(*) > 1) SELECT row_number() OVER (ORDER BY n DESC, label) AS rank, paths, functions FROM g")
def clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function a part whose body follows from the brand."""
    word = lambda i: F.substring(F.sha2(F.concat("p_brand", F.lit(str(i))), 256), 1, 8)
    body = F.concat_ws(" ", *[word(i) for i in range(30)])
    rows = tables.spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey").select(part().alias("id"), F.concat(F.lit("src/"), "p_type", F.lit(".rs")).alias("path"), said("f", part()).alias("name"), said("fn f", part(), "() { ", body, " }").alias("text"))
    return similarity.clone_groups(rows)


@register("context_lines", "WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') SELECT DISTINCT a.l_orderkey AS path, a.l_linenumber AS line FROM lineitem a JOIN h ON a.l_orderkey = h.l_orderkey AND a.l_linenumber BETWEEN h.l_linenumber - 1 AND h.l_linenumber + 1")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), "l_returnflag", F.lit("text").alias("text"))
    return code.context_windows(rows.where("l_returnflag = 'R'").select("path", "line"), rows.select("path", "line", "text").distinct(), before=1, after=1).select("path", "line")


@register("sku_errors", "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'length' WHEN 2 THEN 'dash' WHEN 3 THEN 'area' WHEN 4 THEN 'number' END AS error FROM part")
def sku_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, w = F.lpad((part() % 1_000_000).cast("string"), 6, "0"), part() % 6
    raw = F.when(w == 1, said("WID-", n, "9")).when(w == 2, said("WID", n, "9")).when(w == 3, said("XXX-", n)).when(w == 4, said("PRT-", F.substring(n, 1, 5), "x")).when(w == 5, said(" con-", n, " "))
    return table(spark, sf_dir, "part").select(part().alias("k"), b.sku_error(raw).alias("error"))


@register("centred_names", "WITH t AS (SELECT p_partkey AS k, p_brand || p_size AS t FROM part) SELECT k, CASE WHEN length(t) > 9 THEN substr(t, 1, 8) || '+' ELSE repeat(' ', (9 - length(t)) // 2) || t || repeat(' ', 9 - length(t) - (9 - length(t)) // 2) END AS shown FROM t")
def centred_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(part().alias("k"), b.pad_center(said(F.col("p_brand"), F.col("p_size")), 9).alias("shown"))


@register("money_texts", "SELECT c_custkey AS k, CASE WHEN round(c_acctbal) < 0 THEN '($' || format('{:,.2f}', abs(round(c_acctbal))) || ')' ELSE '$' || format('{:,.2f}', round(c_acctbal)) END AS shown, round(c_acctbal) AS back FROM customer")
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), b.money(b.rounded(F.col("c_acctbal"))).alias("shown"))
    return rows.select("k", "shown", b.parse_money(F.col("shown")).alias("back"))


@register("month_names", "SELECT o_orderkey AS k, monthname(o_orderdate) AS month, (month(o_orderdate) + 2) // 3 AS quarter FROM orders")
def month_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.month("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), b.month_name(month).alias("month"), b.quarter(month).cast("long").alias("quarter"))


@register("wrapped_names", """WITH w AS (SELECT p_partkey AS k, list_prepend({'out': '', 'used': 0}, list_transform(string_split(p_name || ' ' || p_type, ' '), lambda x: {'out': x, 'used': 0})) AS l FROM part),
r AS (SELECT k, list_reduce(l, lambda a, x: CASE WHEN a.used = 0 THEN {'out': a.out || x.out, 'used': CAST(length(x.out) AS INTEGER)} WHEN a.used + 1 + length(x.out) <= 14 THEN {'out': a.out || ' ' || x.out, 'used': CAST(a.used + 1 + length(x.out) AS INTEGER)} ELSE {'out': a.out || chr(10) || x.out, 'used': CAST(length(x.out) AS INTEGER)} END) AS r FROM w) SELECT k, r.out AS shown FROM r""")
def wrapped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(part().alias("k"), t.wrap(F.concat_ws(" ", "p_name", "p_type"), 14).alias("shown"))


@register("title_cases", "SELECT p_partkey AS k, array_to_string(list_transform(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS shown FROM part")
def title_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(part().alias("k"), t.title_case(F.concat_ws(" ", "p_name", "p_type")).alias("shown"))


@register("compile_feedback", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN right('built ' || p_partkey || repeat(' ok', 80), 200) ELSE array_to_string(list_transform(range(1, least(p_partkey % 5, 3) + 1), lambda i: 'error[E0001]: bad ' || i || chr(10) || '--> src/p' || p_partkey || '.rs:' || i), '; ') END AS said FROM part WHERE p_partkey % 5 > 0 OR p_partkey % 3 = 0")
def compile_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (part() % 5).cast("int")
    errors = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: said("error[E0001]: bad ", i, "\n   --> src/p", part(), ".rs:", i, "\n  |\n"))
    out = F.when(part() % 3 == 0, said("built ", part(), F.repeat(F.lit(" ok"), 80))).otherwise(F.array_join(errors, ""))
    return table(spark, sf_dir, "part").where((part() % 5 > 0) | (part() % 3 == 0)).select(part().alias("k"), t.compile_feedback(out).alias("said"))


@register("same_declarations", N + f"SELECT {RUST} AS path, k % 4 NOT IN (0, 1) AS same FROM n")
def same_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first: Column = F.substring_index(F.col("text"), "\nstruct", 1)
    rows = edited(spark, sf_dir).select("path", first.alias("text"), F.substring_index("after", "\nstruct", 1).alias("lang"))
    return code.mapped(rows, lambda before, after: [(code.same_declaration(before, after, "rust"),)], "same boolean")


@register("catalog_keys", "SELECT p_brand AS area, list_sort(list(p_partkey)) AS skus, count(*) = count(DISTINCT p_partkey) AS unique_keys FROM part GROUP BY 1")
def catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock numbers of an area in order, and whether each is there once."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("area")).agg(F.array_sort(F.collect_list("p_partkey")).alias("skus"), (F.count(F.lit(1)) == F.countDistinct("p_partkey")).alias("unique_keys"))
