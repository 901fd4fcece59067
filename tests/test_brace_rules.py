"""Rewrites of scripts and Rust: what each rule makes of its shape, and what it leaves alone."""

import pytest

from tessella.operators.brace_rules import RUST_RULES, SCRIPT_RULES, shorten

CASES = [
    ("javascript", "conditional-return", "function f(h) {\n  if (!h) {\n    return;\n  }\n  return h.v;\n}\n", "function f(h) {\n  return !h ? void 0 : h.v;\n}\n"),
    ("javascript", "return-ladder", "function f(a) {\n  if (a > 2) return 'x';\n  if (a > 1) return 'y';\n  return 'z';\n}\n", "function f(a) {\n  return a > 2 ? 'x' : a > 1 ? 'y' : 'z';\n}\n"),
    ("javascript", "inline-return-binding", "function f(n) {\n  const p = path.join(tmp(), n);\n  return fs.make(p);\n}\n", "function f(n) {\n  return fs.make(path.join(tmp(), n));\n}\n"),
    ("javascript", "inline-return-binding", "function f() {\n\tconst p = new Promise(r => {\n\t\tdone = r;\n\t});\n\treturn p;\n}\n", "function f() {\n\treturn new Promise(r => {\n\t\tdone = r;\n\t});\n}\n"),
    ("javascript", "if-ladder-to-array-lookup", "function f(q) {\n  if (q === 1) { return 'a'; }\n  else if (q === 2) { return 'b'; }\n  else if (q === 3) { return 'c'; }\n  throw new RangeError('q');\n}\n", "function f(q) {\n  if (!Number.isInteger(q) || q < 1 || q > 3) throw new RangeError('q');\n  return ['a', 'b', 'c'][q - 1];\n}\n"),
    ("javascript", "multi-condition-ladder", "function f(m) {\n  if (m === 1 || m === 2) { return 1; }\n  else if (m === 3 || m === 4) { return 2; }\n  throw new RangeError('m');\n}\n", "function f(m) {\n  if (!Number.isInteger(m) || m < 1 || m > 4) throw new RangeError('m');\n  return [1, 1, 2, 2][m - 1];\n}\n"),
    ("javascript", "boolean-chain-collapse", "function f(n) {\n  if (typeof n !== 'number') return false;\n  if (n < 0 || n > 9) return false;\n  return true;\n}\n", "function f(n) {\n  return !(typeof n !== 'number' || n < 0 || n > 9);\n}\n"),
    ("javascript", "unbrace-single-statement", "if (ready) { run(); } else { wait(); }\n", "if (ready) run(); else wait();\n"),
    ("javascript", "hoist-common-tail", 'if (a) { one(); emit("a b"); } else { two(); emit("a b"); }\n', 'if (a) { one(); } else { two(); }\nemit("a b");\n'),
    ("javascript", "accumulator-to-direct", "function f(s, w) {\n  let out = s;\n  while (out.length < w) {\n    out = out + ' ';\n  }\n  return out;\n}\n", "function f(s, w) {\n  while (s.length < w) {\n    s = s + ' ';\n  }\n  return s;\n}\n"),
    ("javascript", "concise-arrow-return", "const c = v => {\n  return v ? 'y' : 'n';\n};\nconst d = v => { return {a: v}; };\n", "const c = v => v ? 'y' : 'n';\nconst d = v => ({a: v});\n"),
    ("javascript", "push-loop-to-map", "function f(b) {\n  const out = [];\n  for (let i = 0; i < b.length; i++) {\n    out.push([b[i].n, i]);\n  }\n  return out;\n}\n", "function f(b) {\n  const out = b.map(function (value, i) { return [value.n, i]; });\n  return out;\n}\n"),
    ("javascript", "copy-loop-to-slice", "function f(s, l) {\n  const out = [];\n  const n = Math.min(l, s.length);\n  for (let i = 0; i < n; i++) {\n    out.push(s[i]);\n  }\n  return out;\n}\n", "function f(s, l) {\n  const out = s.slice(0, Math.max(0, Math.ceil(l)));\n  return out;\n}\n"),
    ("javascript", "repeat-loop", "function f(t) {\n  let bar = '';\n  for (let i = 0; i < t.length; i++) {\n    bar = bar + '=';\n  }\n  return bar;\n}\n", "function f(t) {\n  let bar = '='.repeat(t.length);\n  return bar;\n}\n"),
    ("javascript", "for-loop-with-early-return-to-every", "function f(v) {\n  for (let i = 0; i < v.length; i++) {\n    if (typeof v[i] !== 'number' || !isFinite(v[i])) {\n      return false;\n    }\n  }\n  return true;\n}\n".replace("(v)", "(all)").replace("v[i]", "all[i]").replace("v.length", "all.length").replace("isFinite(v", "isFinite(all"), "function f(all) {\n  return all.every(function (v) { return !(typeof v !== 'number' || !isFinite(v)); });\n}\n"),
    ("javascript", "filter-loop", "function f(a) {\n  const out = [];\n  for (let i = 0; i < a.length; i++) {\n    if (a[i].ok) {\n      out.push(a[i]);\n    }\n  }\n  return out;\n}\n", "function f(a) {\n  const out = a.filter(function (value, i) { return value.ok; });\n  return out;\n}\n"),
    ("javascript", "undefined-default", "function f(n) {\n  let limit = n;\n  if (limit === undefined) {\n    limit = 5;\n  }\n  return limit;\n}\n", "function f(n) {\n  let limit = n === undefined ? 5 : n;\n  return limit;\n}\n"),
    ("javascript", "conditional-summary-loop", "function f(rows) {\n  let count = 0;\n  let total = 0;\n  for (let i = 0; i < rows.length; i++) {\n    if (rows[i].amount >= 0) {\n      count = count + 1;\n      total = total + rows[i].amount;\n    }\n  }\n  return { count: count, total: total };\n}\n", "function f(rows) {\n  const kept = rows.filter(function (row) { return row.amount >= 0; });\n  return { count: kept.length, total: kept.reduce(function (total, row) { return total + row.amount; }, 0) };\n}\n"),
    ("javascript", "validated-sum-loop", "function f(rows, c) {\n  let total = 0;\n  for (let i = 0; i < rows.length; i++) {\n    const v = rows[i][c];\n    if (!isFinite(v)) {\n      throw new TypeError('row ' + i);\n    }\n    total = total + v;\n  }\n  return total;\n}\n", "function f(rows, c) {\n  return rows.reduce(function (total, row, i) {\n    const v = row[c];\n    if (!isFinite(v)) throw new TypeError('row ' + i);\n    return total + v;\n  }, 0);\n}\n"),
    ("javascript", "guarded-filter-loop", "function f(rows, a) {\n  const out = [];\n  for (let i = 0; i < rows.length; i++) {\n    const d = rows[i].date;\n    if (!ok(d)) {\n      throw new TypeError(d);\n    }\n    if (d >= a && d) {\n      out.push(rows[i]);\n    }\n  }\n  return out;\n}\n", "function f(rows, a) {\n  return rows.filter(function (row) {\n    const d = row.date;\n    if (!ok(d)) throw new TypeError(d);\n    return d >= a && d;\n  });\n}\n"),
    ("javascript", "substring-replace-loop", 'let format = (s, close, r, index) =>\n  ~index ? open + swap(s, close, r, index) : s\nlet swap = (s, close, r, index) => {\n  let result = "", cursor = 0\n  do {\n    result += s.substring(cursor, index) + r\n    cursor = index + close.length\n    index = s.indexOf(close, cursor)\n  } while (~index)\n  return result + s.substring(cursor)\n}\n', "let format = (s, close, r, index) =>\n  ~index ? open + swap(s, close, r, index) : s\nlet swap = (s, close, r, index) => {\n  return s.substring(0, index) + s.substring(index).split(close).join(r)\n}\n"),
    ("rust", "csv-interleave-to-join", "fn f(xs: &[P], out: &mut String) {\n    for (i, x) in xs.iter().enumerate() {\n        if i > 0 {\n            out.push(',');\n        }\n        out.push_str(&show(x));\n    }\n}\n", "fn f(xs: &[P], out: &mut String) {\n    out.push_str(&xs.iter().map(|x| show(x)).collect::<Vec<_>>().join(\",\"));\n}\n"),
    ("rust", "nested-if-collapse", "fn f() {\n    if a || b {\n        if c {\n            g();\n        }\n    }\n}\n", "fn f() {\n    if (a || b) && c {\n        g();\n    }\n}\n"),
    ("rust", "use-merge", "use std::io::Read;\nuse std::io::{Write, BufRead};\n", "use std::io::{Read, Write, BufRead};\n"),
    ("rust", "vec-push-run", "fn f() -> Vec<u8> {\n    let mut v = Vec::new();\n    v.push(1);\n    v.push(g(2, 3));\n    v\n}\n", "fn f() -> Vec<u8> {\n    let mut v = vec![1, g(2, 3)];\n    v\n}\n"),
    ("rust", "string-concat-run", 'fn f() {\n    let mut s = String::new();\n    s.push_str("a");\n    s.push_str("b\\n");\n    g(s);\n}\n', 'fn f() {\n    let mut s = String::from("ab\\n");\n    g(s);\n}\n'),
    ("rust", "fold-add-to-sum", "fn f() {\n    let mut t: u32 = 0;\n    for x in v.iter() {\n        t += x.n;\n    }\n    g(t);\n}\n", "fn f() {\n    let t: u32 = v.iter().map(|x| x.n).sum();\n    g(t);\n}\n"),
    ("rust", "for-count-to-method", "fn f() {\n    let mut n = 0;\n    for _ in s.chars() {\n        n += 1;\n    }\n    g(n);\n}\n", "fn f() {\n    let n = s.chars().count();\n    g(n);\n}\n"),
    ("rust", "any-flag-loop", "fn f() {\n    let mut hit = false;\n    for c in s.chars() {\n        if c == '{' {\n            hit = true;\n            break;\n        }\n    }\n    g(hit);\n}\n", "fn f() {\n    let hit = s.chars().any(|c| c == '{');\n    g(hit);\n}\n"),
    ("rust", "for-push-to-collect", "fn f() {\n    let mut v = Vec::new();\n    for x in s.iter() {\n        v.push(x.n);\n    }\n    g(v);\n}\n", "fn f() {\n    let v: Vec<_> = s.iter().map(|x| x.n).collect();\n    g(v);\n}\n"),
    ("rust", "contains-check-loop", "fn f(v: &[u8], y: u8) -> bool {\n    for x in &v {\n        if *x == y {\n            return true;\n        }\n    }\n    false\n}\n", "fn f(v: &[u8], y: u8) -> bool {\n    v.contains(&y)\n}\n"),
    ("rust", "inline-single-use-binding", "fn f() -> u8 {\n    let x = g(1);\n    x\n}\n", "fn f() -> u8 {\n    g(1)\n}\n"),
    ("rust", "unbrace-match-arm", "fn f() {\n    match x {\n        A => { one() }\n        B => { two(); }\n    }\n}\n", "fn f() {\n    match x {\n        A => one(),\n        B => { two(); }\n    }\n}\n"),
    ("rust", "let-else", "fn f() {\n    let x = match g() { Some(v) => v, None => return 3 };\n    h(x);\n}\n", "fn f() {\n    let Some(x) = g() else { return 3; };\n    h(x);\n}\n"),
    ("rust", "match-early-return-to-question", "fn f() {\n    let x = match g() {\n        Ok(v) => v,\n        Err(e) => return Err(e),\n    };\n    h(x);\n}\n", "fn f() {\n    let x = g()?;\n    h(x);\n}\n"),
]


@pytest.mark.parametrize("lang, rule, source, wanted", CASES)
def test_rule(lang, rule, source, wanted):
    text, applied = shorten(source, lang, {rule})
    assert text == wanted and set(applied) == {rule}
    assert shorten(text, lang, {rule}) == (text, [])
    assert shorten("// note\n" + source, lang, {rule})[0] == "// note\n" + wanted


def test_every_rule_has_a_case():
    assert {(c[0], c[1]) for c in CASES} == {("javascript", n) for n in SCRIPT_RULES} | {("rust", n) for n in RUST_RULES}


LEFT = [
    ("javascript", "function f(x) {\n  if (x === 1) return 'a';\n  else if (x === 3) return 'c';\n  throw x;\n}\n", "if-ladder-to-array-lookup"),
    ("javascript", "function f(x) {\n  let out = x + 1;\n  while (out < 10) out = out + 1;\n  return out;\n}\n", "accumulator-to-direct"),
    ("javascript", "function f(v) {\n  if (v) return 1;\n  // lazily\n  return g();\n}\n", "conditional-return"),
    ("javascript", "function f() {\n  const v = g();\n  log(v);\n  return v;\n}\n", "inline-return-binding"),
    ("javascript", "function f() {\n  let v = g();\n  return v;\n}\n", "inline-return-binding"),
    ("javascript", "while (ready) { value() }\n[1].forEach(run)\n", "unbrace-single-statement"),
    ("javascript", 'if (a) { one(); emit("a b"); } else { two(); emit("a  b"); }\n', "hoist-common-tail"),
    ("javascript", "function f(b) {\n  const out = [];\n  for (let i = 0; i < b.length; i++) {\n    out.push(b.length);\n  }\n}\n", "push-loop-to-map"),
    ("javascript", "const s = 'if (a) { return 1; } return 2;'; const r = /{/g; const t = `${ {a: 1}.a }{`;\n", "conditional-return"),
    ("rust", "fn f() {\n    if a {\n        if b {\n            g();\n        } else {\n            h();\n        }\n    }\n}\n", "nested-if-collapse"),
    ("javascript", "function f(rows) {\n  let total = 0;\n  for (let i = 0; i < rows.length; i++) {\n    const v = rows[i + 1];\n    if (!v) {\n      throw v;\n    }\n    total = total + v;\n  }\n  return total;\n}\n", "validated-sum-loop"),
    ("javascript", 'let swap = (s, close, r, index) => {\n  let result = "", cursor = 0\n  do {\n    result += s.substring(cursor, index) + r\n    cursor = index + close.length\n    index = s.indexOf(close, cursor)\n  } while (~index)\n  return result + s.substring(cursor)\n}\nswap(a, b, c, d)\n', "substring-replace-loop"),
    ("rust", "use std::io::Read;\nuse std::fs::File;\n", "use-merge"),
    ("rust", "fn f() {\n    let mut v = Vec::new();\n    v.push(v.len());\n}\n", "vec-push-run"),
    ("rust", "fn f() {\n    let mut t: u32 = 0;\n    for x in v.iter() {\n        t += x?;\n    }\n}\n", "fold-add-to-sum"),
]


@pytest.mark.parametrize("lang, source, rule", LEFT)
def test_left_alone(lang, source, rule):
    assert shorten(source, lang, {rule}) == (source, [])


def test_rules_follow_one_another():
    text, applied = shorten("function f(a) {\n  const out = [];\n  for (let i = 0; i < a.length; i++) {\n    out.push(a[i] * 2);\n  }\n  return out;\n}\n", "javascript")
    assert text == "function f(a) {\n  return a.map(function (value, i) { return value * 2; });\n}\n" and applied == ["push-loop-to-map", "inline-return-binding"]
