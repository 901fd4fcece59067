"""Symbols, surfaces, edits and rails of source code, and the records that checks leave."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import candidates, clike, code, records


def test_tokens_know_texts_templates_and_patterns():
    source = "const r = /a{b/g, d = a / b / c, t = `x${ {a: `}`}.a }{`; // {\nfunction last() {}\n"
    found = clike.tokens(source, "javascript")
    assert [x.text for x in found if x.kind == "text"] == ["/a{b/g", "`x${ {a: `}`}.a }{`"] and [x.text for x in found if x.kind == "comment"] == ["// {"]
    assert [d[2] for d in clike.declarations(source, "javascript")] == ["last"]
    rust = "fn a<'x>(c: &'x str) -> char { let q = '{'; let s = r#\"}\"{\"#; '}' }\nimpl<T> Show for Box<T> { fn b() {} }\nfn open() { (\nmod m;\n"
    assert [d[2] for d in clike.declarations(rust, "rust")] == ["a", "Show for Box<T>", "m"]


def test_surfaces():
    rust = "pub struct P { pub a: Vec<(u8, u8)>, b: u8, pub c: u8 }\nimpl P { pub fn m(&self) -> u8 { 1 } fn n() {} }\nimpl Clone for P { fn clone(&self) {} }\nmod hid { pub fn z() {} }\npub mod vis { pub fn y() {} }\npub(crate) fn q() {}\npub const X: u8 = 1;\n"
    assert code.surface(rust, "rust") == [("P", "pub struct P"), ("P.a", "pub a: Vec<(u8, u8)>"), ("P.c", "pub c: u8"), ("P::m", "pub fn m(&self) -> u8"), ("vis", "pub mod vis"), ("vis::y", "pub fn y()"), ("X", "pub const X: u8")]
    script = "export { a, b as c };\nmodule.exports = { d, e: f };\nexports.g = 1;\nexport const h = 2;\nexport default function k(x) {}\n"
    assert [n for n, _ in code.surface(script, "javascript")] == ["h", "k", "a", "c", "d", "e", "g"]


def test_plain_private_functions():
    source = "def _a():\n    pass\ndef _b(x=1):\n    pass\ndef _c(x: int):\n    pass\n@d\ndef _d():\n    pass\ndef _e() -> int:\n    pass\ndef __f():\n    pass\ndef g():\n    pass\ndef _h(*, k=2):\n    pass\n"
    assert [n for n, _, _ in code.plain_private(source, "python")] == ["_a"]
    assert [n for n, _, _ in code.plain_private("function a() {\n}\nexport function b() {}\nasync function c() {}\nclass D {}\n", "javascript")] == ["a", "c"]


@pytest.mark.parametrize(
    "source, first, last, lines",
    [
        ("a = 1\n\n# head\n# more\n\ndef _f():\n    pass\n", 6, 7, [3, 4, 5, 6, 7]),
        ("# head\ndef _f():\n    pass\n", 2, 3, [1, 2, 3]),
        ("a = 1\n# of a\n\n\ndef _f():\n    pass\n", 5, 6, [3, 4, 5, 6]),
    ],
)
def test_kill_lines(source, first, last, lines):
    assert code.kill_lines(source, first, last) == lines


def test_dead_functions_are_cut(spark):
    files = [("p/__init__.py", "python", ""), ("p/a.py", "python", "def _gone():\n    return 1\n\n\ndef _kept():\n    return 2\n"), ("p/b.py", "python", "x = '_kept'\n"), ("q/c.py", "python", "def _alone():\n    pass\n"), ("setup.py", "python", "def _setup():\n    pass\n"), ("d.js", "javascript", "function lost() {\n  lost();\n}\nrun();\n")]
    rows = spark.createDataFrame(files, "path string, lang string, text string")
    found = code.dead_functions(rows)
    assert {(r.path, r.name) for r in found.collect()} == {("p/a.py", "_gone"), ("q/c.py", "_alone"), ("d.js", "lost")}
    assert {(r.path, r.name) for r in code.dead_functions(rows, packages_only=True).collect()} == {("p/a.py", "_gone")}
    texts = {r.path: r.text for r in code.without_dead(rows, found.select("path", "first", "last")).collect()}
    assert texts["p/a.py"] == "\n\ndef _kept():\n    return 2\n" and texts["d.js"] == "run();\n" and len(texts) == len(files)


def test_symbols_and_edits():
    source = "class A:\n    def f(self):\n        return 1\n\n\ndef _g(x):\n    return x\n"
    found = code.symbols(source, "python")
    assert [s[:2] for s in found] == [("A.f", False), ("_g", True)]
    _, _, start, end, text = found[0]
    new = code.spliced(source, start, end, text, "def f(self):\n    if self:\n        return 2\n")
    assert new == "class A:\n    def f(self):\n        if self:\n            return 2\n\n\ndef _g(x):\n    return x\n"
    assert code.spliced(source, start, end, text + "x", "y") is None and code.spliced(source, start, end, text, " \n") is None
    assert code.changed_functions(source, new, "python") == [("A.f", True)] and code.changed_functions(source, source.replace("return x", "return  x"), "python") == []
    assert code.changed_functions(source, new.replace("return 2", "print(2)"), "python") == [("A.f", False)]
    assert code.same_declaration("def f(a, b=1): return 1", "def f(a,b = 1):\n    return 2", "python") and not code.same_declaration("fn f(a: u8) {}", "fn f(a: u16) {}", "rust")
    assert code.line_changes("a\nb\nc", "a\nx\nc\nd") == [("replace", 1, 2, 1, 2), ("insert", 3, 3, 3, 4)]
    assert [code.drift("fn a() {}\nfn b() {}", after, "rust") for after in ("fn a() {}\nfn b() { 1 }", "fn a() {}", "fn a() {}\nfn b() {}\npub fn c() {}", "fn a() {}\nfn b(x: u8) {}", "fn a() {}\nfn b() {}\nfn c() {}", "")] == ["", "symbol vanished: b", "new public item: c", "declaration changed: b", "", "symbol set could not be extracted"]


def project(spark, files):
    return spark.createDataFrame([(p, x, "python" if p.endswith(".py") else "text") for p, x in files.items()], "path string, text string, lang string")


def names(rows):
    return {r.member.split("::")[1] for r in rows.collect()}


def test_rails(spark):
    files = project(spark, {
        "pkg/_main.py": "import pkgutil\n\n\ndef _load():\n    return pkgutil\n", "pkg/sub/_plugins.py": "def _dead_plugin():\n    return 1\n",
        "plain.py": "def _dead_plain():\n    return 2\n\n\ndef live():\n    return 3\n", "test_plain.py": "from plain import live\n",
        "scripts/run.py": "def _script():\n    pass\n", "tool.py": "def _entry():\n    pass\n", "src/cli/app.py": "def _cli():\n    pass\n", "lazy.py": "def __getattr__(n):\n    pass\ndef _lazy():\n    pass\n",
        "pyproject.toml": "[project]\nname = 'x'\n[project.scripts]\nx = 'tool:main'\n", "setup.cfg": "[options.entry_points]\nconsole_scripts =\n    y = cli.app:run\n",
        "marks.py": "@register\ndef _decorated():\n    return 1\n\n\nX = [1]\n_LIMIT = 3\n",
    })
    assert names(candidates.groups(files)) == {"_dead_plain", "_LIMIT"}
    assert names(candidates.groups(files, app=True)) == {"_dead_plain", "_LIMIT"}  # packaged: public names stay


def test_lookups_by_name_shut_methods_and_like_names(spark):
    files = project(spark, {"h.py": "class _Handlers:\n    def _sync(self):\n        return 1\n", "d.py": "def _handle_widgets(o):\n    return getattr(o, '_handler_registry', None)\n\n\ndef _other_one():\n    return 1\n"})
    assert names(candidates.groups(files)) == {"_Handlers", "_other_one"}


def test_groups_go_together(spark):
    files = project(spark, {"a.py": "def _inner():\n    return 1\n\n\ndef _outer():\n    return _inner()\n\n\ndef _used():\n    return 1\n", "b.py": "from a import _used\n"})
    found = {(r.root.split("::")[1], r.member.split("::")[1]) for r in candidates.groups(files).collect()}
    assert found == {("_outer", "_outer"), ("_inner", "_inner"), ("_inner", "_outer")}


def test_cases_of_arguments():
    assert records.cases([["a", "b"], ["1", "2"]]) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")] and records.cases([]) == []
    many = records.cases([[str(i) for i in range(10)]] * 3)
    assert len(many) == len(set(many)) == 48 and many[0] == ("0", "0", "0") and many == records.cases([[str(i) for i in range(10)]] * 3)


def test_disk_truth_fails_where_totals_differ(spark):
    rows = spark.createDataFrame([(1, 1), (2, 3)], "a long, b long")
    with pytest.raises(Exception, match="reported 2, counted 3"):
        records.checked_total(rows, F.col("a"), F.col("b")).collect()


@pytest.mark.parametrize("line", ['a,b', '', 'a,"b ""c"" d",e', '""""', '"a" "b",x"y,z"w', '"a\tb",', ',,', '"open', 'x"open,', '"",""', '"a""b"'])
def test_csv_line(spark, line):
    fields, current, quoted, i = [], "", False, 0
    while i < len(line):  # a plain reading, a character at a time
        c = line[i]
        if quoted and line[i : i + 2] == '""':
            current, i = current + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields, current = [*fields, current], ""
        else:
            current += c
        i += 1
    assert spark.range(1).select(t.csv_fields(F.lit(line))).first()[0] == (None if quoted else [*fields, current])


def test_numbers_follow_an_order(spark):
    rows = spark.range(1000).selectExpr("id", "id * 37 % 101 as v").repartition(7)
    found = candidates.numbered(rows, [F.desc("v"), "id"], "place").collect()
    assert [r.id for r in sorted(found, key=lambda r: r.place)] == sorted(range(1000), key=lambda i: (-(i * 37 % 101), i)) and {r.place for r in found} == set(range(1, 1001))


def test_json_lines_round_trip(spark, tmp_path):
    from tessella.sources import tables

    rows = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, name string, ok boolean")
    tables.write_split(rows, F.col("ok"), f"{tmp_path}/out")
    back = tables.json_lines(spark, f"{tmp_path}/out", rows.drop("ok").schema)
    assert {(r.id, r.name) for r in back.collect()} == {(1, "a"), (2, "b")}


def test_short_protected_texts_are_found(spark):
    from tessella.plans.curation import hits

    texts = ["one two three four five six seven eight nine ten", "abc", "xabcx", "b", "", "é日 ab", "no match here"]
    needles = ["two three four five six seven eight nine", "abc", "b", "é日", "bcx", "", "ten", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in hits(docs, spark.createDataFrame(list(enumerate(needles)), "item_id long, text string")).collect()}
    assert found == {(i, j) for i, x in enumerate(texts) for j, n in enumerate(needles) if n and n in x}


def test_culprits_are_found_by_halves():
    asked = []

    def passes(bad):
        def check(items):
            asked.append(tuple(items))
            return not bad & set(items)

        return check

    assert records.culprits(list(range(16)), passes({3, 12})) == [3, 12] and len(asked) < 20
    assert records.culprits(list(range(16)), passes(set())) == [] and records.culprits([], passes({1})) == []
    assert records.culprits([1, 2, 3, 4], lambda items: not {1, 4} <= set(items)) == [1, 2, 3, 4]


def test_reports_say_whether_they_are_complete(spark, tmp_path):
    from tessella.sources import tables

    rows = spark.createDataFrame([("a", 3, True), ("b", 2, False)], "name string, loc long, valid boolean")
    said = tables.report(rows, F.col("valid"), "name", f"{tmp_path}/r")
    assert said.startswith("Coverage: 1/2 projects passed. INCOMPLETE") and "| a | 3 | True |" in said
    assert tables.report(rows.where("valid"), F.col("valid"), "name", f"{tmp_path}/s").startswith("Coverage: 1/1 projects passed. Complete run.")


def test_change_shapes(spark):
    diffs = ["+++ b\n+x = v.iter().sum();\n-for a in b {\n-}\n--- a", "diff --git a\ndiff --git b", "+fn _h() {}", "+ return 1; } else", "+plain"]
    rows = spark.createDataFrame([(d,) for d in diffs], "d string").select(code.change_shapes(F.col("d")).alias("c")).collect()
    assert [(r.c.shapes, r.c.net) for r in rows] == [(["loop-to-iterator"], 1), (["dedup-extract-helper"], 0), (["dedup-extract-helper"], 0), (["guard-merge"], 0), (["other"], 0)]
