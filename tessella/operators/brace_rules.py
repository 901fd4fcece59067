"""Rewrites that shorten scripts and Rust, over the statement trees of clike.

A rule looks at one place of a block and gives the place behind what it takes, and new text. Places with comments are left
alone, and so is what would leave brackets unmatched. Rules of Rust need no types where they stand alone; those that turn
loops into iterator calls take only loops over what already is a call. The recorded gates decide whether a result stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from tessella.operators.clike import Node, Tree

Fit = tuple[int, str]
PASSES = 6
NUMBER, TEXT = re.compile(r"\d+$"), re.compile(r"""(?:\d[\w.]*|"[^"]*"|'[^']*'|true|false|null)$""")
PATH = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*$")


def value(t: Tree, n: Node) -> str:
    return t.text(*n.parts["value"])


def test(t: Tree, n: Node) -> str:
    return t.text(*n.parts["test"])


def lone(n: Node | None, kind: str) -> Node | None:
    """The only statement of an if without else, if it is of a kind."""
    body = n.parts["body"] if n and n.kind == "if" and not n.parts["else"] else []
    return body[0] if len(body) == 1 and body[0].kind == kind and body[0].parts["closed"] else None


def loose(t: Tree, first: int, stop: int, *signs: str) -> bool:
    """Whether any of the signs stands outside brackets."""
    i = first
    while i < stop:
        if t.at(i) in signs:
            return True
        i = t.pairs.get(i, i) + 1
    return False


def wrapped(t: Tree, place: tuple[int, int], *signs: str) -> str:
    return f"({t.text(*place)})" if loose(t, *place, *signs) else t.text(*place)


def uses(t: Tree, name: str, first: int = 0, stop: int | None = None) -> int:
    return t.words(first, len(t.found) if stop is None else stop).count(name)


def renamed(t: Tree, first: int, stop: int, swap: Callable[[int], tuple[int, str] | None]) -> str:
    """Source of tokens with some replaced: swap gives how many tokens to take at a place, and what to write."""
    out, at, i = [], t.found[first].start, first
    while i < stop:
        found = swap(i)
        if found:
            out.append(t.source[at : t.found[i].start] + found[1])
            i += found[0]
            at = t.found[i - 1].end
        else:
            i += 1
    return "".join(out) + t.source[at : t.found[stop - 1].end]


def following(block: list[Node], i: int, n: int = 1) -> Node | None:
    return block[i + n] if i + n < len(block) else None


def joined(t: Tree, node: Node, parts: list[str]) -> str:
    return ("\n" + t.pad(node.start)).join(parts)


def shaped(t: Tree, first: int, stop: int, shape: str) -> dict[str, str] | None:
    """What stands in a shape for its names, where the tokens from first to stop have that shape: $a is one token, $$a all up to the next token outside brackets."""
    found: dict[str, str] = {}
    i, parts = first, shape.split()
    for j, p in enumerate(parts):
        if p.startswith("$$"):
            end = i
            while end < stop and (j + 1 == len(parts) or t.at(end) != parts[j + 1]):
                end = t.pairs.get(end, end) + 1
            if end == i or end > stop:
                return None
            text, i = t.text(i, end), end
        elif i >= stop:
            return None
        else:
            text, i = t.at(i), i + 1
        if p.startswith("$") and found.setdefault(p.lstrip("$"), text) != text or not p.startswith("$") and p != text:
            return None
    return found if i == stop else None


def spoken(text: str, array: str, counter: str, name: str) -> str | None:
    """Source with array[counter] called name; null where array, counter or name are used otherwise."""
    new = re.sub(rf"\b{re.escape(array)}\[{re.escape(counter)}\]", name, text)
    taken = re.search(rf"(?<![.\w$])(?:{re.escape(array)}|{re.escape(counter)})(?![\w$])", new) or re.search(rf"(?<![.\w$]){name}(?![\w$])", text)
    return None if taken else new


# ---- scripts


def returned(t: Tree, n: Node) -> str:
    first, stop = n.parts["value"]
    return wrapped(t, (first, stop), ",", "=>", "=") if first < stop else "void 0"


def conditional_return(t: Tree, block: list[Node], i: int) -> Fit | None:
    n, after = block[i], following(block, i)
    yes = lone(n, "return")
    if yes and after and after.kind == "return" and after.parts["closed"] and (value(t, yes) or value(t, after)):
        return after.end, f"return {wrapped(t, n.parts['test'], '?', ',', '=>', '=')} ? {returned(t, yes)} : {returned(t, after)};"
    return None


def return_ladder(t: Tree, block: list[Node], i: int) -> Fit | None:
    at, parts = i, []
    while (yes := lone(block[at] if at < len(block) else None, "return")) and value(t, yes) not in ("", "true", "false"):
        parts.append(f"{wrapped(t, block[at].parts['test'], '?', ',', '=>', '=')} ? {returned(t, yes)}")
        at += 1
    last = block[at] if at < len(block) else None
    if len(parts) > 1 and last and last.kind == "return" and last.parts["closed"] and value(t, last):
        return last.end, f"return {' : '.join(parts)} : {returned(t, last)};"
    return None


def inline_return_binding(t: Tree, block: list[Node], i: int) -> Fit | None:
    n, after = block[i], following(block, i)
    if n.kind != "bind" or "name" not in n.parts or n.parts["mutable"] or not n.parts["closed"] or not after or after.kind != "return" or not after.parts["closed"]:
        return None
    name, (first, stop) = n.parts["name"], after.parts["value"]
    if uses(t, name) != 2:
        return None
    if t.text(first, stop) == name:
        return after.end, f"return {value(t, n)};"
    inner = stop - first > 3 and t.at(stop - 1) == ")" and t.at(stop - 2) == name and t.at(stop - 3) == "(" and PATH.match(t.text(first, stop - 3))
    return (after.end, f"return {t.text(first, stop - 3)}({value(t, n)});") if inner else None


def keys_of(t: Tree, first: int, stop: int) -> tuple[str, list[int]] | None:
    """Subject and numbers of a test like x === 1 || x === 2."""
    words = t.words(first, stop)
    parts = [words[j : j + 3] for j in range(0, len(words), 4)]
    ors = words[3::4]
    if len(words) % 4 == 3 and all(o == "||" for o in ors) and all(p[1] == "===" and NUMBER.match(p[2]) and p[0] == words[0] for p in parts):
        return words[0], [int(p[2]) for p in parts]
    return None


def lookup(t: Tree, block: list[Node], i: int, several: bool) -> Fit | None:
    """A ladder of tests on whole numbers from 1 on, each returning a literal, that ends in a throw, as an array."""
    subject, keys, values, at, n = None, [], [], i, block[i]
    while n and n.kind == "if":
        found, body = keys_of(t, *n.parts["test"]), n.parts["body"]
        if not found or len(body) != 1 or body[0].kind != "return" or not TEXT.match(value(t, body[0])) or subject not in (None, found[0]):
            return None
        subject = found[0]
        keys += found[1]
        values += [value(t, body[0])] * len(found[1])
        rest = n.parts["else"]
        at += not rest
        n = rest[0] if rest and len(rest) == 1 else block[at] if not rest and at < len(block) else None
    in_else = n is not None and (at >= len(block) or n is not block[at])
    if len(keys) < 3 or keys != list(range(1, len(keys) + 1)) or not n or n.kind != "throw" or (len(keys) > len(set(values))) != several:
        return None
    end = block[at].end if in_else else n.end
    check = f"if (!Number.isInteger({subject}) || {subject} < 1 || {subject} > {len(keys)}) {t.text(n.start, n.end)}"
    return end, joined(t, block[i], [check, f"return [{', '.join(values)}][{subject} - 1];"])


def if_ladder_to_array_lookup(t: Tree, block: list[Node], i: int) -> Fit | None:
    return lookup(t, block, i, several=False)


def multi_condition_ladder(t: Tree, block: list[Node], i: int) -> Fit | None:
    return lookup(t, block, i, several=True)


def boolean_chain_collapse(t: Tree, block: list[Node], i: int) -> Fit | None:
    at, tests = i, []
    while (no := lone(block[at] if at < len(block) else None, "return")) and value(t, no) == "false":
        tests.append(wrapped(t, block[at].parts["test"], "?", ",", "=>", "=", "??"))
        at += 1
    last = block[at] if at < len(block) else None
    if tests and last and last.kind == "return" and value(t, last) == "true":
        return last.end, f"return !({' || '.join(tests)});"
    return None


def unbrace_single_statement(t: Tree, block: list[Node], i: int) -> Fit | None:
    n = block[i]
    if n.kind not in ("if", "while", "for"):
        return None
    bare = lambda body: len(body) == 1 and body[0].kind in ("plain", "return", "throw") and body[0].parts.get("closed") and t.at(body[0].start) not in ("function", "class", "async")
    first, other = n.parts["braced"] and bare(n.parts["body"]), n.parts["else"] and n.parts["else_braced"] and bare(n.parts["else"])
    if not first and not other:
        return None
    text = t.text(n.start, n.parts["at"]) + " " + (t.text(n.parts["body"][0].start, n.parts["body"][0].end) if first else t.text(n.parts["at"], (n.parts["else_at"] - 1) if n.parts["else"] else n.end))
    if n.parts["else"]:
        text += " else " + (t.text(n.parts["else"][0].start, n.parts["else"][0].end) if other else t.text(n.parts["else_at"], n.end))
    return n.end, text


def hoist_common_tail(t: Tree, block: list[Node], i: int) -> Fit | None:
    n = block[i]
    if n.kind != "if" or not n.parts["else"] or not n.parts["braced"] or not n.parts["else_braced"] or len(n.parts["body"]) < 2 or len(n.parts["else"]) < 2:
        return None
    a, b = n.parts["body"][-1], n.parts["else"][-1]
    if t.words(a.start, a.end) != t.words(b.start, b.end) or a.kind not in ("plain", "return") or not a.parts["closed"]:
        return None
    part = lambda last, opens: t.source[t.found[opens].start : t.found[last.start].start].rstrip() + "\n" + t.pad(n.start) + "}"
    flat = lambda last, opens: part(last, opens) if "\n" in t.text(n.start, n.end) else t.source[t.found[opens].start : t.found[last.start].start].rstrip() + " }"
    return n.end, f"{t.text(n.start, n.parts['at'])} {flat(a, n.parts['at'])} else {flat(b, n.parts['else_at'])}\n{t.pad(n.start)}{t.text(a.start, a.end)}"


def accumulator_to_direct(t: Tree, block: list[Node], i: int) -> Fit | None:
    n, loop, last = block[i], following(block, i), following(block, i, 2)
    if n.kind != "bind" or n.parts.get("word") != "let" or "name" not in n.parts or not loop or loop.kind != "while" or not last or last.kind != "return":
        return None
    name, source = n.parts["name"], value(t, n)
    owner = next((f for b in t.blocks for f in b if f.kind == "function" and f.parts["body"] and f.parts["body"][0].start <= n.start < f.end), None)
    if not owner or value(t, last) != name or not re.match(r"[A-Za-z_$][\w$]*$", source) or source not in t.words(*owner.parts["head"]) or uses(t, source, loop.start, owner.end) or uses(t, name, owner.start, owner.end) != uses(t, name, n.start, last.end):
        return None
    return last.end, renamed(t, loop.start, last.end, lambda j: (1, source) if t.at(j) == name and t.at(j - 1) != "." else None)


def concise_arrow(t: Tree) -> Iterator[tuple[int, int, str]]:
    """(first token, token behind, text) of arrow functions whose body only returns."""
    for i, token in enumerate(t.found):
        if token.text == "=>" and t.at(i + 1) == "{" and t.at(i + 2) == "return" and i + 1 in t.pairs:
            close = t.pairs[i + 1]
            inner = t.words(i + 3, close)
            if len(inner) > 1 and inner[-1] == ";" and not loose(t, i + 3, close - 1, ";", ","):
                text = t.text(i + 3, close - 1)
                yield i, close + 1, f"=> ({text})" if text.startswith("{") else f"=> {text}"


def counted(t: Tree, n: Node | None) -> tuple[str, str] | None:
    """Name and bound of a loop for (let i = 0; i < bound; i++)."""
    words = t.words(*n.parts["test"]) if n and n.kind == "for" else []
    if len(words) > 9 and words[0] == "let" and words[2:5] == ["=", "0", ";"] and words[5:7] == [words[1], "<"] and words[-3:] in ([";", words[1], "++"], [";", "++", words[1]]):
        first, stop = n.parts["test"]
        return words[1], t.text(first + 7, stop - 3)
    return None


def filled(t: Tree, block: list[Node], i: int, word: str = "const") -> tuple[str, Node, str, str] | None:
    """Name, loop, counter and bound of an empty array before a counting loop."""
    n, loop = block[i], following(block, i)
    head = counted(t, loop)
    if n.kind == "bind" and n.parts.get("word") == word and "name" in n.parts and value(t, n) == "[]" and head:
        return n.parts["name"], loop, *head
    return None


def element(t: Tree, first: int, stop: int, array: str, counter: str, name: str) -> str | None:
    """Source with array[counter] called name; null where the array is used otherwise."""
    at = lambda j: t.words(j, j + 4) == [array, "[", counter, "]"]
    hits = sum(at(j) for j in range(first, stop - 3))
    if hits != uses(t, array, first, stop) or uses(t, name, first, stop):
        return None
    return renamed(t, first, stop, lambda j: (4, name) if at(j) else None)


def pushed(t: Tree, n: Node, name: str) -> tuple[int, int] | None:
    """Place of what a statement pushes to name."""
    first, stop = n.parts.get("value", (0, 0))
    ok = n.kind == "plain" and t.words(first, first + 4) == [name, ".", "push", "("] and t.pairs.get(first + 3) == stop - 1
    return (first + 4, stop - 1) if ok and not loose(t, first + 4, stop - 1, ",") and not uses(t, name, first + 4, stop) else None


def push_loop_to_map(t: Tree, block: list[Node], i: int) -> Fit | None:
    found = filled(t, block, i)
    if not found or len(found[1].parts["body"]) != 1 or not found[3].endswith(".length"):
        return None
    name, loop, counter, array = found[0], found[1], found[2], found[3].removesuffix(".length")
    place = pushed(t, loop.parts["body"][0], name)
    if not place or not re.match(r"[\w$]+$", array) or t.text(*place) == f"{array}[{counter}]":
        return None
    text = element(t, *place, array, counter, "value")
    return (loop.end, f"const {name} = {array}.map(function (value, {counter}) {{ return {text}; }});") if text else None


def copy_loop_to_slice(t: Tree, block: list[Node], i: int) -> Fit | None:
    n, size = block[i], following(block, i)
    if n.kind != "bind" or "name" not in n.parts or value(t, n) != "[]" or not size or size.kind != "bind" or "name" not in size.parts:
        return None
    loop, m = following(block, i, 2), re.fullmatch(r"Math\.min\(([\w$]+), ([\w$]+)\.length\)", value(t, size))
    head = counted(t, loop)
    if not m or not head or head[1] != size.parts["name"] or uses(t, size.parts["name"]) != 2 or len(loop.parts["body"]) != 1:
        return None
    place = pushed(t, loop.parts["body"][0], n.parts["name"])
    if place and t.text(*place) == f"{m[2]}[{head[0]}]":
        return loop.end, f"const {n.parts['name']} = {m[2]}.slice(0, Math.max(0, Math.ceil({m[1]})));"
    return None


def repeat_loop(t: Tree, block: list[Node], i: int) -> Fit | None:
    n, loop = block[i], following(block, i)
    head = counted(t, loop)
    if n.kind != "bind" or "name" not in n.parts or value(t, n) not in ("''", '""') or not head or not head[1].endswith(".length") or len(loop.parts["body"]) != 1:
        return None
    name, step = n.parts["name"], loop.parts["body"][0]
    words = t.words(step.start, step.end)
    text = words[2] if words[:2] == [name, "+="] and len(words) == 4 else words[4] if words[:4] == [name, "=", name, "+"] and len(words) == 6 else ""
    return (loop.end, f"{n.parts['word']} {name} = {text}.repeat({head[1]});") if re.match(r"""['"]""", text) else None


def loop_to_every(t: Tree, block: list[Node], i: int) -> Fit | None:
    loop, last = block[i], following(block, i)
    head = counted(t, loop)
    if not head or not head[1].endswith(".length") or len(loop.parts["body"]) != 1 or not last or last.kind != "return" or value(t, last) != "true":
        return None
    check, array = loop.parts["body"][0], head[1].removesuffix(".length")
    no = lone(check, "return")
    if not no or value(t, no) != "false" or not re.match(r"[\w$]+$", array):
        return None
    text = element(t, *check.parts["test"], array, head[0], "v")
    return (last.end, f"return {array}.every(function (v) {{ return !({text}); }});") if text and not re.search(rf"\b{head[0]}\b", text) else None


def filter_loop(t: Tree, block: list[Node], i: int) -> Fit | None:
    found = filled(t, block, i)
    if not found or len(found[1].parts["body"]) != 1 or not found[3].endswith(".length"):
        return None
    name, loop, counter, array = found[0], found[1], found[2], found[3].removesuffix(".length")
    check = loop.parts["body"][0]
    push = lone(check, "plain")
    place = pushed(t, push, name) if push else None
    if not place or t.text(*place) != f"{array}[{counter}]" or not re.match(r"[\w$]+$", array) or uses(t, name, *check.parts["test"]):
        return None
    text = element(t, *check.parts["test"], array, counter, "value")
    return (loop.end, f"const {name} = {array}.filter(function (value, {counter}) {{ return {text}; }});") if text else None


def undefined_default(t: Tree, block: list[Node], i: int) -> Fit | None:
    n, check = block[i], following(block, i)
    if n.kind != "bind" or n.parts.get("word") != "let" or "name" not in n.parts or not re.match(r"[\w$]+$", value(t, n)) or not check:
        return None
    name, source, set_ = n.parts["name"], value(t, n), lone(check, "plain")
    if not set_ or t.words(*check.parts["test"]) != [name, "===", "undefined"] or t.words(set_.start, set_.start + 2) != [name, "="] or uses(t, name, set_.start + 2, set_.end):
        return None
    return check.end, f"let {name} = {source} === undefined ? {t.text(set_.start + 2, set_.parts['value'][1])} : {source};"


COUNT = "for ( let $i = 0 ; $i < $rows . length ; $i ++ ) {"


def conditional_summary_loop(t: Tree, block: list[Node], i: int) -> Fit | None:
    last = following(block, i, 3)
    found = last and shaped(t, block[i].start, last.end, f"let $n = 0 ; let $sum = 0 ; {COUNT} if ( $$test ) {{ $n = $n + 1 ; $sum = $sum + $$value ; }} }} return {{ count : $n , total : $sum }} ;")
    kept = found and [spoken(found[k], found["rows"], found["i"], "row") for k in ("test", "value")]
    if not kept or None in kept or any(re.search(rf"\b(?:{found['n']}|{found['sum']})\b", x) for x in kept):
        return None
    name = next(x for x in ("kept", "matching", "chosen") if not uses(t, x))
    return last.end, joined(t, block[i], [f"const {name} = {found['rows']}.filter(function (row) {{ return {kept[0]}; }});", f"return {{ count: {name}.length, total: {name}.reduce(function ({found['sum']}, row) {{ return {found['sum']} + {kept[1]}; }}, 0) }};"])


def validated_sum_loop(t: Tree, block: list[Node], i: int) -> Fit | None:
    last = following(block, i, 2)
    found = last and shaped(t, block[i].start, last.end, f"let $sum = 0 ; {COUNT} const $v = $$value ; if ( $$bad ) {{ throw $$error ; }} $sum = $sum + $v ; }} return $sum ;")
    value = found and spoken(found["value"], found["rows"], found["i"], "row")
    bare = lambda k: re.sub(r"'[^']*'|\"[^\"]*\"", "", found[k])
    if not value or any(re.search(rf"\b(?:{found['rows']}|{found['sum']}|row)\b", bare(k)) for k in ("bad", "error")):
        return None
    pad = t.pad(block[i].start)
    return last.end, f"return {found['rows']}.reduce(function ({found['sum']}, row, {found['i']}) {{\n{pad}  const {found['v']} = {value};\n{pad}  if ({found['bad']}) throw {found['error']};\n{pad}  return {found['sum']} + {found['v']};\n{pad}}}, 0);"


def guarded_filter_loop(t: Tree, block: list[Node], i: int) -> Fit | None:
    last = following(block, i, 2)
    found = last and shaped(t, block[i].start, last.end, f"const $out = [ ] ; {COUNT} const $v = $$value ; if ( $$bad ) {{ throw $$error ; }} if ( $$test ) {{ $out . push ( $rows [ $i ] ) ; }} }} return $out ;")
    parts = found and {k: spoken(found[k], found["rows"], found["i"], "row") for k in ("value", "bad", "error", "test")}
    if not parts or None in parts.values() or any(re.search(rf"\b{found['out']}\b", x) for x in parts.values()):
        return None
    pad = t.pad(block[i].start)
    return last.end, f"return {found['rows']}.filter(function (row) {{\n{pad}  const {found['v']} = {parts['value']};\n{pad}  if ({parts['bad']}) throw {parts['error']};\n{pad}  return {parts['test']};\n{pad}}});"


def substring_replace_loops(t: Tree) -> Iterator[tuple[int, int, str]]:
    """(first token, token behind, text) of loops that put a text in place of every other one from a place on where the first stands: the only call is made where that place was found."""
    shape = "let $out = \"\" , $at = 0 do {{ $out += $text . substring ( $at , $i ) + $new $at = $i + $old . length $i = $text . indexOf ( $old , $at ) }} while ( ~ $i ) return $out + $text . substring ( $at )"
    for i in range(len(t.found)):
        if t.at(i) == "let":
            size = len(shape.split())
            found = shaped(t, i, i + size, shape.replace("{{", "{").replace("}}", "}")) if i + size <= len(t.found) else None
            head = t.words(max(0, i - 13), i)
            named = next((head[j] for j in range(len(head) - 1) if head[j + 1] == "=" and head[j + 2 : j + 3] == ["("]), None) if found else None
            calls = [j for j in range(len(t.found)) if t.at(j) == named and t.at(j + 1) == "("] if named else []
            guarded = len(calls) == 1 and found["i"] in t.words(calls[0], t.pairs.get(calls[0] + 1, calls[0])) and any(t.words(j, j + 3) == ["~", found["i"], "?"] for j in range(max(0, calls[0] - 8), calls[0]))
            if guarded and uses(t, named) == 2:
                yield i, i + size, f"return {found['text']}.substring(0, {found['i']}) + {found['text']}.substring({found['i']}).split({found['old']}).join({found['new']})"


# ---- Rust


def nested_if_collapse(t: Tree, block: list[Node], i: int) -> Fit | None:
    n = block[i]
    inner = n.parts["body"][0] if n.kind == "if" and not n.parts["else"] and len(n.parts["body"]) == 1 else None
    if not inner or inner.kind != "if" or inner.parts["else"]:
        return None
    tests = [wrapped(t, x.parts["test"], "||") for x in (n, inner)]
    steps = [t.text(s.start, s.end) for s in inner.parts["body"]]
    pad = t.pad(n.start)
    return n.end, f"if {' && '.join(tests)} {{\n" + "".join(f"{pad}    {s}\n" for s in steps) + f"{pad}}}"


def use_merge(t: Tree, block: list[Node], i: int) -> Fit | None:
    n, after = block[i], following(block, i)
    if n.kind != "use" or not after or after.kind != "use":
        return None
    paths = [t.text(x.start + 1, x.parts["value"][1]) for x in (n, after)]
    heads = [p.split("::{")[0] if "::{" in p else p.rpartition("::")[0] for p in paths]
    if not heads[0] or heads[0] != heads[1]:
        return None
    names = [p[len(heads[0]) + 2 :].strip().removeprefix("{").removesuffix("}").strip(", \n") for p in paths]
    return after.end, f"use {heads[0]}::{{{', '.join(names)}}};"


def run_of_calls(t: Tree, block: list[Node], i: int, method: str) -> tuple[str, list[tuple[int, int]], int]:
    """Name bound at i, places of the arguments of the calls of method that follow at once, and the place behind."""
    name, places, at = block[i].parts["name"], [], i + 1
    while at < len(block) and block[at].kind == "plain" and block[at].parts["closed"] and t.words(block[at].start, block[at].start + 4) == [name, ".", method, "("]:
        first, stop = block[at].start + 4, block[at].parts["value"][1] - 1
        if t.pairs.get(first - 1) != stop or uses(t, name, first, stop):
            break
        places.append((first, stop))
        at += 1
    return name, places, block[at - 1].end


def vec_push_run(t: Tree, block: list[Node], i: int) -> Fit | None:
    n = block[i]
    if n.kind != "bind" or "name" not in n.parts or not n.parts["mutable"] or value(t, n) not in ("Vec::new()", "vec![]"):
        return None
    name, places, end = run_of_calls(t, block, i, "push")
    return (end, f"let mut {name} = vec![{', '.join(t.text(*p) for p in places)}];") if places else None


def string_concat_run(t: Tree, block: list[Node], i: int) -> Fit | None:
    n = block[i]
    if n.kind != "bind" or "name" not in n.parts or not n.parts["mutable"] or value(t, n) != "String::new()":
        return None
    name, places, end = run_of_calls(t, block, i, "push_str")
    texts = [t.text(*p) for p in places]
    return (end, f'let mut {name} = String::from("{"".join(x[1:-1] for x in texts)}");') if texts and all(re.fullmatch(r'"(?:\\.|[^"\\])*"', x) for x in texts) else None


def looped(t: Tree, n: Node | None) -> tuple[str, str] | None:
    """Pattern and source of a loop over the result of a call."""
    words = t.words(*n.parts["test"]) if n and n.kind == "for" else []
    if "in" not in words or words[-1] != ")":
        return None
    first, stop = n.parts["test"]
    at = first + words.index("in")
    return t.text(first, at), t.text(at + 1, stop)


def leaves(t: Tree, n: Node) -> bool:
    return bool({"return", "break", "continue", "?", "await"} & set(t.words(n.start, n.end)))


def counter_of(t: Tree, block: list[Node], i: int, start: str) -> tuple[str, str, Node, str, str] | None:
    """Name, type, loop, pattern and source of a value that starts before a loop."""
    n, loop = block[i], following(block, i)
    m = re.fullmatch(rf"let mut (\w+)(?:\s*:\s*([\w<>]+))? = {start};", t.text(n.start, n.end))
    over = looped(t, loop)
    return (m[1], m[2] or "", loop, *over) if n.kind == "bind" and m and over and len(loop.parts["body"]) == 1 else None


def fold_add_to_sum(t: Tree, block: list[Node], i: int) -> Fit | None:
    found = counter_of(t, block, i, "0")
    if not found or not found[1] or leaves(t, found[2]):
        return None
    name, kind, loop, pattern, source = found
    step = loop.parts["body"][0]
    if step.kind != "plain" or t.words(step.start, step.start + 2) != [name, "+="] or uses(t, name, step.start + 1, step.end):
        return None
    return loop.end, f"let {name}: {kind} = {source}.map(|{pattern}| {t.text(step.start + 2, step.parts['value'][1])}).sum();"


def for_count_to_method(t: Tree, block: list[Node], i: int) -> Fit | None:
    found = counter_of(t, block, i, "0")
    if not found or found[1] not in ("", "usize"):
        return None
    name, _, loop, _, source = found
    step = loop.parts["body"][0]
    return (loop.end, f"let {name} = {source}.count();") if t.words(step.start, step.end) == [name, "+=", "1", ";"] and looped(t, loop)[0] == "_" else None


def any_flag_loop(t: Tree, block: list[Node], i: int) -> Fit | None:
    found = counter_of(t, block, i, "false")
    check = found[2].parts["body"][0] if found else None
    if not check or check.kind != "if" or check.parts["else"] or {"return", "?", "await"} & set(t.words(*check.parts["test"])):
        return None
    name, _, loop, pattern, source = found
    steps = [t.words(s.start, s.end) for s in check.parts["body"]]
    return (loop.end, f"let {name} = {source}.any(|{pattern}| {test(t, check)});") if steps == [[name, "=", "true", ";"], ["break", ";"]] else None


def for_push_to_collect(t: Tree, block: list[Node], i: int) -> Fit | None:
    found = counter_of(t, block, i, r"(?:Vec::new\(\)|vec!\[\])")
    if not found or leaves(t, found[2]):
        return None
    name, kind, loop, pattern, source = found
    place = pushed(t, loop.parts["body"][0], name)
    mapped = f".map(|{pattern}| {t.text(*place)})" if place and t.text(*place) != pattern else ""
    return (loop.end, f"let {name}: {kind or 'Vec<_>'} = {source}{mapped}.collect();") if place else None


def contains_check_loop(t: Tree, block: list[Node], i: int) -> Fit | None:
    loop, last = block[i], following(block, i)
    m = re.fullmatch(r"(\w+) in &(\w+)", test(t, loop)) if loop.kind == "for" else None
    check = loop.parts["body"][0] if m and len(loop.parts["body"]) == 1 else None
    if not check or not last or last is not block[-1] or t.words(last.start, last.end) not in (["false"], ["return", "false", ";"]):
        return None
    hit, yes = re.fullmatch(rf"\*{m[1]} == (\w+)", test(t, check)) if check.kind == "if" else None, lone(check, "return")
    return (last.end, f"{m[2]}.contains(&{hit[1]})") if hit and yes and value(t, yes) == "true" else None


def inline_single_use_binding(t: Tree, block: list[Node], i: int) -> Fit | None:
    n, last = block[i], following(block, i)
    if n.kind != "bind" or "name" not in n.parts or n.parts["mutable"] or not last or last is not block[-1] or uses(t, n.parts["name"]) != 2:
        return None
    name = n.parts["name"]
    if t.words(last.start, last.end) == [name]:
        return last.end, value(t, n)
    return (last.end, f"return {value(t, n)};") if last.kind == "return" and value(t, last) == name else None


def matched(t: Tree, n: Node) -> tuple[str, str, dict[str, str]] | None:
    """Name, subject and arms of let x = match subject { pattern => result, ... };"""
    if n.kind != "bind" or "name" not in n.parts or t.at(n.parts["value"][0]) != "match":
        return None
    first, stop = n.parts["value"]
    brace = t.opening(first + 1, stop)
    if brace is None or t.pairs.get(brace) != stop - 1:
        return None
    arms, i = {}, brace + 1
    while i < stop - 1:
        end = i
        while end < stop - 1 and t.at(end) != ",":
            end = t.pairs.get(end, end) + 1
        pattern, _, result = t.text(i, end).partition("=>")
        arms[pattern.strip()] = result.strip()
        i = end + 1
    return n.parts["name"], t.text(first + 1, brace), arms


def match_early_return_to_question(t: Tree, block: list[Node], i: int) -> Fit | None:
    found = matched(t, block[i])
    for pattern, result in found[2].items() if found and len(found[2]) == 2 else []:
        m = re.fullmatch(r"(Ok|Some)\((\w+)\)", pattern)
        if m and result == m[2]:
            other, gives = next((p, r) for p, r in found[2].items() if p != pattern)
            e = re.fullmatch(r"Err\((\w+)\)", other)
            passes = e and m[1] == "Ok" and gives in (f"return Err({e[1]})", f"return Err({e[1]}.into())") or m[1] == "Some" and other == "None" and gives == "return None"
            if passes:
                return block[i].end, f"let {found[0]} = {found[1]}?;"
    return None


def let_else(t: Tree, block: list[Node], i: int) -> Fit | None:
    found = matched(t, block[i])
    for pattern, result in found[2].items() if found and len(found[2]) == 2 else []:
        m = re.fullmatch(r"(Ok|Some)\((\w+)\)", pattern)
        other, gives = next((p, r) for p, r in found[2].items() if p != pattern)
        if m and result == m[2] and other in ("None", "Err(_)", "_") and re.match(r"(return|continue|break)\b", gives):
            return block[i].end, f"let {m[1]}({found[0]}) = {found[1]} else {{ {gives}; }};"
    return None


def unbraced_arms(t: Tree) -> Iterator[tuple[int, int, str]]:
    """(first token, token behind, text) of match arms whose block is one expression."""
    for i, token in enumerate(t.found):
        if token.text == "=>" and t.at(i + 1) == "{" and i + 1 in t.pairs:
            close = t.pairs[i + 1]
            if close > i + 2 and not {";", "let", "if", "match", "for", "while", "loop"} & set(t.words(i + 2, close)):
                yield i, close + 1 + (t.at(close + 1) == ","), f"=> {t.text(i + 2, close)},"


def interleave_to_join(t: Tree, block: list[Node], i: int) -> Fit | None:
    n = block[i]
    found = n.kind == "for" and shaped(t, n.start, n.end, "for ( $i , $x ) in $$source . iter ( ) . enumerate ( ) { if $i > 0 { $out . push ( $sep ) ; } $out . push_str ( & $$value ) ; }")
    if not found or not re.fullmatch(r"'(?:\\.|[^'\\])'", found["sep"]) or re.search(rf"\b(?:{found['i']}|{found['out']})\b", found["value"]) or "?" in found["value"]:
        return None
    sep = {"'\"'": '\\"', "'\\''": "'"}.get(found["sep"], found["sep"][1:-1])
    return n.end, f'{found["out"]}.push_str(&{found["source"]}.iter().map(|{found["x"]}| {found["value"]}).collect::<Vec<_>>().join("{sep}"));'


SCRIPT_RULES = {
    "conditional-return": conditional_return, "inline-return-binding": inline_return_binding, "if-ladder-to-array-lookup": if_ladder_to_array_lookup,
    "accumulator-to-direct": accumulator_to_direct, "boolean-chain-collapse": boolean_chain_collapse, "unbrace-single-statement": unbrace_single_statement,
    "hoist-common-tail": hoist_common_tail, "for-loop-with-early-return-to-every": loop_to_every, "multi-condition-ladder": multi_condition_ladder, "filter-loop": filter_loop,
    "push-loop-to-map": push_loop_to_map, "copy-loop-to-slice": copy_loop_to_slice, "repeat-loop": repeat_loop, "return-ladder": return_ladder,
    "undefined-default": undefined_default, "concise-arrow-return": concise_arrow, "conditional-summary-loop": conditional_summary_loop, "validated-sum-loop": validated_sum_loop,
    "guarded-filter-loop": guarded_filter_loop, "substring-replace-loop": substring_replace_loops,
}
RUST_RULES = {
    "inline-single-use-binding": inline_single_use_binding, "contains-check-loop": contains_check_loop, "for-count-to-method": for_count_to_method, "fold-add-to-sum": fold_add_to_sum,
    "unbrace-match-arm": unbraced_arms, "vec-push-run": vec_push_run, "string-concat-run": string_concat_run, "nested-if-collapse": nested_if_collapse, "let-else": let_else,
    "any-flag-loop": any_flag_loop, "for-push-to-collect": for_push_to_collect, "use-merge": use_merge, "match-early-return-to-question": match_early_return_to_question, "csv-interleave-to-join": interleave_to_join,
}
#: Rules over tokens rather than statements.
OVER_TOKENS = {"concise-arrow-return", "unbrace-match-arm", "substring-replace-loop"}
#: Tried first and last, because another rule would take part of what they take.
FIRST, LAST = ["conditional-summary-loop", "validated-sum-loop", "guarded-filter-loop", "boolean-chain-collapse", "if-ladder-to-array-lookup", "multi-condition-ladder", "return-ladder", "match-early-return-to-question"], ["unbrace-single-statement"]


def _once(tree: Tree, only: set[str] | None) -> tuple[str, list[str]]:
    source, lang, edits = tree.source, tree.lang, []
    rules = RUST_RULES if lang == "rust" else SCRIPT_RULES
    names = [n for n in [*FIRST, *[n for n in rules if n not in FIRST + LAST], *LAST] if n in rules and (only is None or n in only)]
    taken: list[tuple[int, int]] = []

    def keep(first: int, stop: int, text: str, rule: str) -> bool:
        a, z = tree.found[first].start, tree.found[stop - 1].end
        if tree.commented(first, stop) or any(a < y and x < z for x, y in taken) or text == source[a:z]:
            return False
        taken.append((a, z))
        edits.append((a, z, text, rule))
        return True

    for name in names:
        if name in OVER_TOKENS:
            for first, stop, text in rules[name](tree):
                keep(first, stop, text, name)
            continue
        for block in tree.blocks:
            for i, node in enumerate(block):
                found = rules[name](tree, block, i)
                if found:
                    keep(node.start, found[0], found[1], name)
    for a, z, text, _ in sorted(edits, reverse=True):
        source = source[:a] + text + source[z:]
    return source, [e[3] for e in sorted(edits)]


def shorten(source: str, lang: str, only: set[str] | None = None) -> tuple[str, list[str]]:
    """The source after the rules of its language, and the names of those applied."""
    tree, applied = Tree(source, lang), []
    for _ in range(PASSES):
        new, names = _once(tree, only)
        if not names:
            break
        changed = Tree(new, lang)
        opened = [t.text for t in changed.found if t.kind == "sign"]
        if any(opened.count(a) != opened.count(z) for a, z in ("()", "[]", "{}")):
            break
        tree = changed
        applied += names
    return tree.source, applied
