"""Functions on literal rows with known results."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import business as b
from tessella.functions import text as t
from tessella.operators import code, compare, graph, masking, similarity
from tessella.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def s(x):
    return F.lit(x)


def test_values(spark):
    cases = [
        (t.token_count(s("a_b c-d é日 !")), 6), (t.slug(s("  Crème Brûlée -- Straße! ")), "creme-brulee-strasse"), (t.title_case(s("hELLO\nwORLD x")), "Hello\nWorld X"),
        (t.longest_line(s("ab\ncd\ne")), "ab"), (t.longest_line(s("")), ""), (t.wrap(s("aa bb cc dddd"), 5), "aa bb\ncc\ndddd"), (t.wrap(s("a  b"), 0), "a  b"),
        (t.csv_field(s('a"b,c')), '"a""b,c"'), (t.csv_field(s("ab")), "ab"), (t.reverse_words(s(" a b  c ")), "c b a"), (t.is_blank(s(" \t\n")), True),
        (t.indent_lines(s("a\n\nb"), 2), "  a\n\n  b"), (t.total_syllables(s("make the idea")), 1 + 1 + 2), (t.sentences(s("A. B!? C")), 2), (t.reading_seconds(s(10), 0), 0),
        (t.compile_feedback(s("error[E0308]: mismatched\n  --> src/a.rs:1:5\nnote")), "error[E0308]: mismatched\n--> src/a.rs:1:5"), (t.compile_feedback(s("x" * 300)), "x" * 200),
        (b.sku_error(s(" wid-000101 ")), None), (b.sku_error(s("WID000101")), "length"), (b.sku_error(s("WID-00010A")), "number"), (b.sku_error(s("XXX-000101")), "area"),
        (b.stock_flag(s(None).cast("int"), s(12)), "UNKNOWN"), (b.stock_flag(s(400), s(12)), "NORMAL"), (b.stock_flag(s(401), s(12)), "OVERSTOCK"),
        (b.priority(s(" low ")), 2), (b.priority(s("odd")), 9), (b.discount_tier(s(50)), 0.10), (b.pad_center(s("abc"), 6), " abc  "), (b.pad_center(s("abcdef"), 4), "abc+"),
        (b.pad_left(s("abcdef"), 3), "abcdef"), (b.age_status(s(45)), "overdue"), (b.month_name(s(12)), "December"), (b.quarter(s(4)), 2), (b.money(s(-1234.5)), "($1,234.50)"),
        (b.parse_money(s("($1,034.05)")), -1034.05), (b.percent(s(0), s(0)), 0.0), (b.percent(s(200), s(150)), 25.0),
    ]
    found = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [(i, found[i]) for i in range(len(cases))] == [(i, w) for i, (_, w) in enumerate(cases)]


def test_c_like_lines(spark):
    source = "// a\n\nx; /* y\n/* b\nc */ d;\n/* e */ f;\n/* g */\nend\n"
    assert tuple(value(spark, t.c_like_lines(s(source)))) == (4, 3, 2)


def test_masks_come_back_only_whole(spark):
    rows = masking.mask(spark.createDataFrame([("a<p>x</p>b<p>y</p>",), ("none",), ("",)], "text string"), "text", "<p>[^<]*</p>")
    assert rows.where(~masking.unmask(F.col("masked_text"), F.col("spans")).eqNullSafe(F.col("text"))).count() == 0
    torn = rows.where("text like 'a%'").select(masking.unmask(F.replace("masked_text", F.lit("FROZEN_0"), F.lit("FROZEN_1")), F.col("spans")).alias("v"))
    assert torn.first()["v"] is None


def test_multisets(spark):
    left, right = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(map(tuple, compare.multiset_difference(left, right).collect())) == [(1, 1), (2, 1)]
    assert compare.same_multiset(left, left) and not compare.same_multiset(left, right)
    assert compare.is_superset(left, left.limit(1)) and not compare.is_superset(left, right)


def test_similarity_against_all_pairs(spark):
    import random

    random.seed(5)
    base = [f"w{random.randrange(99)}" for _ in range(40)]
    texts = [" ".join(w if random.random() > 0.03 else "z" for w in base) for _ in range(12)] + ["a b", "a b", "", "!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {(r.a, r.b) for r in similarity.similar_pairs(similarity.shingle_rows(docs, "id", "text"), "id").collect()}

    def runs(x):
        w = x.replace("!", " ! ").split()
        return {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))} if w else set()

    sets = [runs(x) for x in texts]
    wanted = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    assert found == wanted
    labels = {r.node: r.label for r in similarity.components(spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 5)], "a int, b int")).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 4}


def test_closures_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3)], "src int, dst int")
    closed = graph.closures(spark.createDataFrame([(3,), (4,)], "node int"), edges)
    assert sorted(map(tuple, closed.collect())) == [(3, 1), (3, 2), (3, 3), (3, 4), (4, 4)]
    assert {r.root for r in graph.removable(closed, spark.createDataFrame([(2,)], "node int")).collect()} == {4}


def test_project_scan(spark, tmp_path):
    for path in ("src/a.py", "src/test_a.py", "src/b.ts", "src/b.js", "tests/c.rs", "node_modules/d.js", "gen/e.py", "README.md", "package.json"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    tree = tables.files(spark, str(tmp_path))
    rows = {(r.path, r.lang, r.role) for r in tables.project(tree, ["gen"]).collect()}
    assert rows == {("src/a.py", "python", "source"), ("src/test_a.py", "python", "test"), ("src/b.ts", "typescript", "source"), ("tests/c.rs", "rust", "test")}
    assert tables.main_language(tree).first()["lang"] in ("javascript", "typescript")


def test_json_lines_keep_broken_rows(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n')
    rows = tables.json_lines(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("a", T.LongType())])).collect()
    assert sorted((r.a, r.raw) for r in rows if r.a) == [(1, None)] and [r.raw for r in rows if r.a is None] == ["not json"]


def test_manifest_and_markdown(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[[crate]]\nname = "b"\nloc = 3\n[[crate]]\nname = "a"\n')
    rows = tables.manifest(spark, str(tmp_path / "m.toml"), "crate", "name string, loc long")
    assert tables.markdown(rows, "name") == "| name | loc |\n|---|---|\n| a |  |\n| b | 3 |"


@pytest.mark.parametrize(
    "before, after, rules",
    [
        ("def f(x):\n    if x is None:\n        return True\n    return False\n", "def f(x):\n    return x is None\n", ["bool-return"]),
        ("def f(x):\n    if x:\n        return 1\n    else:\n        return 2\n", "def f(x):\n    return 1 if x else 2\n", ["conditional-return"]),
        ("def f(x):\n    y = x + 1\n    return y\n", "def f(x):\n    return x + 1\n", ["inline-return-temp"]),
        ("from a import b\nfrom a import c\n", "from a import b, c\n", ["merge-from-imports"]),
        ("if a:\n    if b:\n        c()\n", "if a and b:\n    c()\n", ["flatten-nested-if"]),
        ("x = 1  # kept\nif a:\n    if b:\n        c()\n", "x = 1  # kept\nif a and b:\n    c()\n", ["flatten-nested-if"]),
        ("def f(:\n", None, []),
    ],
)
def test_rewrites(before, after, rules):
    assert code.shorten(before) == (after or before, rules)


def test_commas_and_counts():
    assert code.collapse_commas("f(\n    a,\n    b,\n)\ng(1,)\nh(\n    c,  # why\n)\n") == ("f(\n    a,\n    b\n)\ng(1,)\nh(\n    c,  # why\n)\n", 1)
    assert code.line_counts('"""Doc."""\n\n# c\nx = """a\n\nb"""\n') == (2, 2, 2)
    assert code.node_count("x = 1") > 1 and code.node_count("x =") == 0
    assert code.unreachable("def f():\n    return 1\n    a\n    b\n") == [3, 4]


def test_streaming_equals_batch(spark, sf_dir):
    from tessella.streaming import windows

    key = lambda rows: sorted((str(r.start)[:10], r.event_type, r.n, r.total) for r in rows.collect())
    assert key(windows.run_to_end(spark, sf_dir, "events")) == key(windows.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet")))


def test_maximal_sets_against_all_pairs(spark):
    import random

    random.seed(13)
    made = {i: frozenset(random.sample(range(9), random.randrange(1, 7))) for i in range(300)}
    made |= {1000: made[0], 1001: frozenset(range(100, 200)), 1002: frozenset(range(100, 199))}
    rows = spark.createDataFrame([(i, x) for i, m in made.items() for x in m], "root long, member long")
    found = sorted((r.root, r.size) for r in graph.maximal(rows).collect())
    assert found == sorted((i, len(m)) for i, m in made.items() if not any(m < o or (m == o and j < i) for j, o in made.items()))


def test_whole_queries_hold_what_the_cut_ones_leave_out(spark, sf_dir):
    from tessella import catalog, plans  # noqa: F401

    run = lambda name: catalog.QUERIES[name](spark, sf_dir)
    assert run("maximal_sets").where("root % 5 <> 0").count() > 0
    assert run("multiset_diff").where("surplus <= 2").count() > 0
    assert run("rule_histogram").where("n < 20").count() > 0


def test_block_comments_are_counted(spark, tmp_path):
    import duckdb

    from tessella import catalog, plans  # noqa: F401

    far = "/* " + "x" * 1_000_010 + " */\nend"
    texts = ["// a\n\nx; /* y\n/* b\nc */ d;\n/* e */ f;\n/* g */\nend\n", far, "/* a\n\n// b\n */\nx", "plain", "/*\nno end\n\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in catalog.QUERIES["loc_c_like"](spark, str(tmp_path)).collect())
    assert found == [(0, 4, 3, 2), (1, 1, 1, 0), (2, 1, 3, 1), (3, 1, 0, 0), (4, 0, 2, 2)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(catalog.ORACLES["loc_c_like"]).fetchall()) == found


def test_long_words_keep_their_end(spark):
    assert spark.range(1).select(F.length(t.title_case(F.repeat(s("a"), 1_000_005)))).first()[0] == 1_000_005
