"""Code analysis over sources written from parts: each part gives a file, whose symbols, lines and faults follow from its numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import register
from tessella.operators import candidates, code
from tessella.operators.compare import surface_changes
from tessella.sources.tables import spread, table

#: k: part, s: size, m: lines in a body, c: whether the private function is called. Both engines run this text.
NUMBERS = "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, CAST(p_size % 5 AS BIGINT) AS m, CASE WHEN p_partkey % 3 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS c FROM {part}"
PYTHON, SCRIPT, RUST = "'pkg/part' || k || '.py'", "'web/part' || k || '.js'", "'src/part' || k || '.rs'"
#: (path, lang, text) of a part, lines joined by |.
SOURCES = [
    (PYTHON, "python", "'import os|||def _part' || k || '(x):|' || repeat('    print(x)|', CAST(m AS INT)) || '    return x|||def use' || k || '(a, b=' || s || ', *, c: int = 2) -> int:|    \"\"\"Part ' || k || '.\"\"\"|    # size ' || s || '|' || CASE WHEN c = 1 THEN '    a = _part' || k || '(a)|' ELSE '' END || CASE WHEN s % 2 = 0 THEN '    return a|    b = a|' ELSE '    y = a + b|    return y|' END"),
    (SCRIPT, "javascript", "'// part ' || k || '|export function add' || k || '(a) {|' || repeat('  log(a);|', CAST(m AS INT)) || '  if (a) { return ' || s || '; }|  return a;|}|function local' || k || '() {|  return ' || CASE WHEN c = 1 THEN 'local' || k || '()' ELSE '1' END || ';|}|' || CASE WHEN s % 2 = 0 THEN 'local' || k || '();|' ELSE '' END"),
    (RUST, "rust", "'pub fn run' || k || '(x: u8) -> u8 {|    let y = ' || s || ';|    y|}|struct Unit' || k || ';|/* size ' || s || ' */|'"),
]
FILES = " UNION ALL ".join(f"SELECT k, {p} AS path, '{g}' AS lang, replace({t}, '|', chr(10)) AS text FROM n" for p, g, t in SOURCES)
N = "WITH n AS (" + NUMBERS.format(part="part") + ") "


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = FILES.replace("{", "{{").replace("}", "}}")  # braces of the sources stand for themselves
    return spark.sql(f"WITH n AS ({NUMBERS}) {text}", part=spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"))


@register("symbol_spans", N + f"""SELECT {PYTHON} AS path, 3 AS start, 5 + m AS "end", '_part' || k AS name FROM n UNION ALL SELECT {PYTHON}, 7 + m, 12 + m + c, 'use' || k FROM n
UNION ALL SELECT {SCRIPT}, 1, 5 + m, 'add' || k FROM n UNION ALL SELECT {SCRIPT}, 5 + m, 8 + m, 'local' || k FROM n UNION ALL SELECT {RUST}, 0, 4, 'run' || k FROM n UNION ALL SELECT {RUST}, 4, 5, 'Unit' || k FROM n""")
def symbol_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbol_spans(files(spark, sf_dir))


SURFACE = f"""SELECT {PYTHON} AS file, 'use' || k AS symbol, 'def(a, b=' || s || ', *, c: int=2)->int' AS signature FROM n
UNION ALL SELECT {SCRIPT}, 'add' || k, 'export function add' || k || '(a)' FROM n UNION ALL SELECT {RUST}, 'run' || k, 'pub fn run' || k || '(x: u8) -> u8' FROM n"""


@register("api_surface", N + SURFACE)
def api_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.api_surface(files(spark, sf_dir))


@register("api_changes", N + f"""SELECT {PYTHON} AS file, 'use' || k AS symbol, 'changed' AS violation FROM n WHERE k % 5 = 0 UNION ALL SELECT {PYTHON}, 'extra' || k, 'added' FROM n WHERE k % 7 = 0
UNION ALL SELECT {RUST}, 'run' || k, 'missing' FROM n WHERE k % 11 = 0""")
def api_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, k = files(spark, sf_dir), F.col("k")
    python = F.when(k % 5 == 0, F.replace("text", F.lit(", b="), F.lit(", b=9"))).otherwise(F.col("text"))
    python = F.concat(python, F.when(k % 7 == 0, F.concat(F.lit("\n\ndef extra"), k.cast("string"), F.lit("():\n    pass\n"))).otherwise(""))
    rust = F.when(k % 11 == 0, F.replace("text", F.lit("pub fn"), F.lit("fn"))).otherwise(F.col("text"))
    after = before.withColumn("text", F.when(F.col("lang") == "python", python).when(F.col("lang") == "rust", rust).otherwise(F.col("text")))
    return surface_changes(code.api_surface(before), code.api_surface(after))


@register("doc_multiset", N + f"""SELECT {PYTHON} AS path, 'comment' AS kind, '# size ' || s AS text, 1 AS n FROM n UNION ALL SELECT {PYTHON}, 'docstring', 'Part ' || k || '.', 1 FROM n
UNION ALL SELECT {SCRIPT}, 'comment', '// part ' || k, 1 FROM n UNION ALL SELECT {RUST}, 'comment', '/* size ' || s || ' */', 1 FROM n""")
def doc_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.doc_rows(files(spark, sf_dir)).groupBy("path", "kind", "text").agg(F.count(F.lit(1)).cast("int").alias("n"))


DEAD = f"SELECT {PYTHON} AS path, '_part' || k AS name, 4 AS first, 5 + m AS last FROM n WHERE c = 0 UNION ALL SELECT {SCRIPT}, 'local' || k, 6 + m, 8 + m FROM n WHERE s % 2 = 1"


@register("dead_functions", N + DEAD)
def dead_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.dead_functions(files(spark, sf_dir))


@register("lines_without_dead", N + f"""SELECT {PYTHON} AS path, 15 + m + c - 2 - CASE WHEN c = 0 THEN 4 + m ELSE 0 END AS n_lines FROM n
UNION ALL SELECT {SCRIPT}, 9 + m + CASE WHEN s % 2 = 0 THEN 1 ELSE -3 END FROM n UNION ALL SELECT {RUST}, 7 FROM n""")
def lines_without_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    kept = code.without_dead(rows, code.dead_functions(rows).select("path", "first", "last"))
    return kept.select("path", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@register("unreachable_lines", N + f"SELECT {PYTHON} AS path, CAST(12 + m + c AS INT) AS line FROM n WHERE s % 2 = 0")
def unreachable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.mapped(files(spark, sf_dir).where("lang = 'python'"), lambda t, g: [(x,) for x in code.unreachable(t)], "line int")


@register("python_loc", N + f"SELECT {PYTHON} AS path, CAST(6 + m + c AS INT) AS code, 2 AS comment, 4 AS blank FROM n")
def python_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.mapped(files(spark, sf_dir).where("lang = 'python'"), lambda t, g: [code.line_counts(t)], "code int, comment int, blank int")


@register("rewrites", N + f"""SELECT {PYTHON} AS path, 'inline-return-temp' AS rule, 1 AS n FROM n WHERE s % 2 = 1 OR c = 1
UNION ALL SELECT {SCRIPT}, 'conditional-return', 1 FROM n UNION ALL SELECT {RUST}, 'inline-single-use-binding', 1 FROM n""")
def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.mapped(files(spark, sf_dir), lambda t, g: [(r,) for r in code.shorten(t, g)[1]], "rule string").groupBy("path", "rule").agg(F.count(F.lit(1)).cast("int").alias("n"))


@register("function_symbols", N + f"""SELECT {PYTHON} AS path, '_part' || k AS name, true AS private FROM n UNION ALL SELECT {PYTHON}, 'use' || k, false FROM n
UNION ALL SELECT {SCRIPT}, 'add' || k, false FROM n UNION ALL SELECT {SCRIPT}, 'local' || k, true FROM n UNION ALL SELECT {RUST}, 'run' || k, false FROM n""")
def function_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.mapped(files(spark, sf_dir), lambda t, g: [s[:2] for s in code.symbols(t, g)], "name string, private boolean")


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with after: Rust with a parameter's type changed, a function gone, one made public or only the body changed, by the part's number."""
    k, t = F.col("k"), F.col("text")
    swap = lambda a, b: F.replace(t, F.lit(a), F.lit(b))
    rust = F.when(k % 4 == 0, swap("x: u8", "x: u16")).when(k % 4 == 1, swap("fn run", "fn walk")).when(k % 4 == 2, F.concat(t, F.lit("pub fn more() {}\n"))).otherwise(swap("let y", "let  y"))
    return files(spark, sf_dir).where("lang = 'rust'").withColumn("after", rust)


@register("symbol_drift", N + f"SELECT {RUST} AS path, CASE k % 4 WHEN 0 THEN 'declaration changed: run' || k WHEN 1 THEN 'symbol vanished: run' || k WHEN 2 THEN 'new public item: more' ELSE '' END AS reason FROM n")
def symbol_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark, sf_dir).select("path", F.col("text"), F.col("after").alias("lang"))
    return code.mapped(rows, lambda before, after: [(code.drift(before, after, "rust"),)], "reason string")


@register("changed_functions", N + f"SELECT {RUST} AS path, 'run' || k AS name, true AS comparable FROM n WHERE k % 4 = 0")
def changed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark, sf_dir).select("path", F.col("text"), F.col("after").alias("lang"))
    return code.mapped(rows, lambda before, after: code.changed_functions(before, after, "rust"), "name string, comparable boolean")


@register("line_changes", N + f"""SELECT {RUST} AS path, CASE WHEN k % 4 = 2 THEN 'insert' ELSE 'replace' END AS kind, CASE k % 4 WHEN 2 THEN 6 WHEN 3 THEN 1 ELSE 0 END AS first, CASE k % 4 WHEN 2 THEN 6 WHEN 3 THEN 2 ELSE 1 END AS last,
 CASE k % 4 WHEN 2 THEN 6 WHEN 3 THEN 1 ELSE 0 END AS first_after, CASE k % 4 WHEN 2 THEN 7 WHEN 3 THEN 2 ELSE 1 END AS last_after FROM n""")
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark, sf_dir).select("path", F.col("text"), F.col("after").alias("lang"))
    return code.mapped(rows, code.line_changes, "kind string, first int, last int, first_after int, last_after int")


NODE = "'lib' || {x} % 20 || '/m' || {x} || '.py::_f' || {x}"


@register("removable_groups", f"""WITH f AS (SELECT p_partkey AS k, p_partkey % 20 AS g, p_partkey // 20 AS i FROM part WHERE p_partkey % 20 <> 3),
c AS (SELECT f.k AS r, b.k AS m FROM f JOIN f b ON b.g = f.g AND b.i // 4 = f.i // 4 AND b.i >= f.i)
SELECT {NODE.format(x='r')} AS root, {NODE.format(x='m')} AS member FROM c WHERE r NOT IN (SELECT r FROM c WHERE m % 9 = 0)""")
def removable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one private function each: number i of a folder is called by number i + 1 within a run of four, every ninth part is named by a text, and one folder looks modules up."""
    k = F.col("p_partkey")
    g, i, text = k % 20, F.floor(k / 20), lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    before = F.when((i % 4 != 0) & (k > 20), text("    _f", (k - 20).cast("string"), "()\n")).otherwise("")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(text("lib", g.cast("string"), "/m", k.cast("string"), ".py").alias("path"), text("def _f", k.cast("string"), "():\n", before, "    return 1\n").alias("text"), F.lit("python").alias("lang"))
    live = table(spark, sf_dir, "part").where("p_partkey % 9 = 0").select(text("live/u", k.cast("string"), ".txt").alias("path"), text("see _f", k.cast("string"), "\n").alias("text"), F.lit("text").alias("lang"))
    loads = spark.sql("SELECT 'lib3/load.py' AS path, 'import pkgutil' AS text, 'python' AS lang")
    every = rows.unionByName(live).unionByName(loads)
    return candidates.groups(every).select("root", "member")
