"""What queries do at sizes that small tables do not show: classes instead of pairs, work dealt to tasks, odd values."""

from itertools import combinations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

from tessella.operators import similarity


def brute_groups(functions, k=8, percent=70):
    """Groups of ids by all pairs of functions (id, name, text)."""
    import re

    label = {}
    sets = {}
    for i, name, text in functions:
        t = re.findall(r"\w+|[^\s\w]", text[text.index("{") + 1 :])
        sets[i] = (name, {tuple(t[j : j + k]) for j in range(max(len(t) - k + 1, 1))})
        label[i] = i
    linked = set()
    for a, b in combinations(sorted(sets), 2):
        (x, s), (y, t) = sets[a], sets[b]
        if None not in (x, y) and x != y and 100 * len(s & t) >= percent * len(s | t):
            linked |= {a, b}
            old, new = sorted((label[a], label[b]), reverse=True)
            label = {i: new if v == old else v for i, v in label.items()}
    groups = {}
    for i in linked:
        groups.setdefault(label[i], []).append(i)
    return sorted((len(g), sorted(sets[i][0] for i in g)) for g in groups.values())


def test_clone_groups_of_copies(spark, monkeypatch):
    """Copies meet the join once, and the groups are those of all pairs: of one name and several, alone and similar to others."""
    body = lambda n, last="": "fn f() { " + " ".join(f"{n}w{i}" for i in range(40)) + last + " }"
    rows = [(i, "p", f"f{i}", body("a")) for i in range(30)] + [(30 + i, "p", "one", body("b")) for i in range(5)]  # many names; one name, not linked
    rows += [(40 + i, "q", "two", body("c")) for i in range(4)] + [(50, "q", "two", body("c", " x")), (51, "q", "three", body("c", " y"))]
    rows += [(60, "r", "four", body("d")), (61, "r", "four", body("d", " x")), (62, "r", None, body("d")), (63, "r", None, body("a"))]
    joined = []
    pairs = similarity.similar_pairs
    monkeypatch.setattr(similarity, "similar_pairs", lambda sets, key, percent=70: joined.append(sets.select(key).distinct().count()) or pairs(sets, key, percent))
    found = similarity.clone_groups(spark.createDataFrame(rows, "id long, path string, name string, text string")).collect()
    assert sorted((len(r.functions), list(r.functions)) for r in found) == brute_groups([(r[0], r[2], r[3]) for r in rows])
    assert joined == [7]  # a class each


def test_sources_are_dealt_to_tasks(spark, sf_dir, monkeypatch):
    """Parts come from one file; the work on their sources is dealt by their number, not by the file's size."""
    from tessella.plans import sources_code
    from tessella.sources import tables

    monkeypatch.setattr(tables, "PER_TASK", 50)
    parts = tables.table(spark, sf_dir, "part").count()
    found = sources_code.files(spark, sf_dir)
    used = found.where("lang = 'python'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= parts // 100 > 1 and found.count() == 3 * parts


def test_script_without_a_fit_is_read_once(monkeypatch):
    from tessella.operators import brace_rules

    read = []
    monkeypatch.setattr(brace_rules, "Tree", lambda *a, tree=brace_rules.Tree: read.append(a) or tree(*a))
    assert brace_rules.shorten("call(x);\n", "javascript") == ("call(x);\n", []) and len(read) == 1


def against_sql(spark, tmp_path, name, table, rows):
    """Rows of a query over one table, and those of its SQL, with floats as text."""
    import duckdb
    import pyarrow.parquet as pq

    from tessella import catalog, plans  # noqa: F401

    pq.write_table(rows, tmp_path / f"{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    wanted = con.sql(catalog.ORACLES[name])
    found = catalog.QUERIES[name](spark, str(tmp_path)).select(*wanted.columns).collect()
    return sorted(repr(tuple(r)) for r in found), sorted(map(repr, wanted.fetchall()))


def test_char_freq_of_odd_texts(spark, tmp_path):
    """Empty texts count; capitals whose small letter depends on the engine or on what stands around."""
    texts = ["", "", None, "aA", "İx", "ΑΣ", "Ᲊ\U00010d50", "\U0001f468", "\n\x00 "]
    found, wanted = against_sql(spark, tmp_path, "char_freq", "documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert found == wanted and "('', 2)" in found


def test_money_of_zeros_and_halves(spark, tmp_path):
    """Balances between -0.5 and 0 round to a zero that keeps its sign."""
    values = [-0.4, -0.49, -0.0, 0.0, 0.4, -0.5, 0.5, -0.51, 1.5, -1234.5, 1234567.89, None]
    found, wanted = against_sql(spark, tmp_path, "money_texts", "customer", pa.table({"c_custkey": list(range(len(values))), "c_acctbal": pa.array(values, pa.float64())}))
    assert found == wanted and "(0, '$-0.00', -0.0)" in found


def test_orders_of_more_lines_than_a_transaction_may_have(spark, tmp_path):
    """SQL judges an order's sites however many there are; the rule on their number stays with transactions."""
    import pyarrow.parquet as pq

    from tessella.operators import contracts

    pq.write_table(pa.table({"p_partkey": [1, 2]}), tmp_path / "part.parquet")
    lines = [(tx, 1 + i % 2, 6 if seventh and i == 3 else 0, flag) for tx, seventh, flag in ((6, True, "N"), (12, False, "N"), (18, False, "R"), (7, False, "N")) for i in range(17)]
    rows = pa.table({"l_orderkey": [r[0] for r in lines], "l_partkey": [r[1] for r in lines], "l_linenumber": [1 + r[2] for r in lines], "l_returnflag": [r[3] for r in lines], "l_linestatus": ["O"] * len(lines)})
    found, wanted = against_sql(spark, tmp_path, "transaction_faults", "lineitem", rows)
    assert found == wanted and "(6, 'path')" in found and "(12, None)" in found
    sites = spark.createDataFrame([(1, "a.rs", "one", "one", "fn h() {}")] * 17, "tx long, path string, region string, anchor string, helper string")
    assert contracts.transaction_fault(sites, spark.createDataFrame([("a.rs", "one")], "path string, text string")).collect() == [(1, "sites")]


def test_groups_parse_sources_once(spark, monkeypatch):
    from tessella.operators import candidates, graph

    kept = []
    monkeypatch.setattr(graph, "settled", lambda df, settled=graph.settled: kept.append(df.columns) or settled(df))
    files = spark.createDataFrame([("a.py", "def _f1():\n    return 1\n", "python"), ("b.py", "def _f2():\n    _f1()\n    return 1\n", "python")], "path string, text string, lang string")
    found = sorted(map(tuple, candidates.groups(files).collect()))
    assert found == [("a.py::_f1", "a.py::_f1"), ("a.py::_f1", "b.py::_f2"), ("b.py::_f2", "b.py::_f2")]
    assert any(c[:3] == ["path", "kind", "name"] for c in kept) and ["src", "dst"] in kept and ["owner", "dst"] in kept


def odd_documents():
    """Copies, near copies, rows of one key, texts of few or no tokens, null keys and texts, a vertical tab, letters beyond the first plane."""
    words = [f"w{i}" for i in range(60)]
    long = " ".join(words)
    rows = [(1, long), (2, long), (3, long), (4, long + " x"), (5, " ".join(words[:55])), (6, " ".join(words[30:])), (7, "a b c"), (8, "a b c"), (9, ""), (10, ""), (11, None), (None, long), (None, long)]
    rows += [(20, " ".join(words[:40])), (20, " ".join(words[33:])), (21, "z " + long), (30, long.replace(" ", "\x0b")), (31, long.replace(" ", "\x0b ")), (32, long.replace("w", "\U00010400")), (33, long.replace("w", "\U00010400") + " é_1"), (34, "!?"), (35, "! ?")]
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})


def test_jaccard_pairs_of_odd_documents(spark, tmp_path):
    """Rows that share a key are one set, as in SQL."""
    found, wanted = against_sql(spark, tmp_path, "jaccard_pairs", "documents", odd_documents())
    assert found == wanted and len(found) > 10


def test_jaccard_pairs_without_repeated_keys(spark, tmp_path, monkeypatch):
    """Sets reach the comparison once for a bin of pairs, copies not at all; many bins give the same rows as one."""
    monkeypatch.setattr(similarity, "BIN", 2)
    monkeypatch.setattr(similarity, "similar_pairs", None)  # takes a row a token
    docs = odd_documents()
    docs = docs.filter(pa.compute.fill_null(pa.compute.not_equal(docs["doc_id"], 20), True))
    found, wanted = against_sql(spark, tmp_path, "jaccard_pairs", "documents", docs)
    assert found == wanted and len(found) > 10


def test_dup_components_of_odd_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similarity, "similar_pairs", None)
    docs = odd_documents()
    docs = docs.filter(pa.compute.fill_null(pa.compute.not_equal(docs["doc_id"], 20), True))
    found, wanted = against_sql(spark, tmp_path, "dup_components", "documents", docs)
    assert found == wanted and len(found) > 2


def test_closures_send_few_rows_to_the_driver(spark, monkeypatch):
    """Edges and what is alive are broadcast only where few."""
    from tessella.operators import graph

    monkeypatch.setattr(graph, "FEW", 1)
    nodes, edges = spark.range(1, 9).toDF("node"), spark.range(2, 9).selectExpr("id as src", "id div 2 as dst")
    met = []
    monkeypatch.setattr(graph, "settled", lambda df, settled=graph.settled: met.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df))
    closed = graph.closures(nodes, edges)
    assert any("rightHint=(strategy=merge)" in plan for plan in met)
    left = graph.removable(closed, spark.createDataFrame([(5,), (9,)], "node long"))
    assert "strategy=merge" in left._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, left.groupBy("root").count().collect())) == [(3, 3), (4, 2), (6, 1), (7, 1), (8, 1)]
