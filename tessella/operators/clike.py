"""Scripts and Rust as tokens between matched brackets: declarations, and statements as trees for rewriting."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

#: Text, character and pattern literals, comments, words, operators, by language; scripts' templates and patterns are cut by hand.
COMMENT = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
RUST_TEXT = r"(?P<text>b?r(?P<fence>#*)\".*?\"(?P=fence)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:u\{[^}]*\}|.)|[^'\\\n])')"
SCRIPT_TEXT = r"(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
WORD = r"(?P<word>'?[^\W\d][\w$]*|\$[\w$]*|[\d][\w.]*)"
SIGN = r"(?P<sign>=>|->|::|\.\.\.|\.\.=|\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|.)"
LEXERS = {lang: re.compile(f"{COMMENT}|{text}|{WORD}|{SIGN}", re.S) for lang, text in (("rust", RUST_TEXT), ("javascript", SCRIPT_TEXT))}
PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words that declare a symbol, and words that may stand before them.
DECLARES = {"javascript": {"function", "class"}, "rust": {"fn", "struct", "enum", "trait", "mod", "impl"}}
BEFORE = {"javascript": {"export", "default", "async"}, "rust": {"pub", "default", "async", "unsafe", "const", "extern"}}


class Token(NamedTuple):
    kind: str  # comment, text, word or sign
    text: str
    start: int
    end: int


def _template(source: str, at: int) -> int:
    """End of a template literal that starts at a backquote."""
    at += 1
    while at < len(source) and source[at] != "`":
        if source.startswith("${", at):
            depth = 0
            while at < len(source):
                if source[at] == "`" and depth:
                    at = _template(source, at) - 1
                depth += (source[at] == "{") - (source[at] == "}")
                at += 1
                if not depth and source[at - 1] == "}":
                    break
            continue
        at += 2 if source[at] == "\\" else 1
    return min(at + 1, len(source))


def tokens(source: str, lang: str) -> list[Token]:
    """Tokens without blanks, comments among them."""
    lexer, found, at, value = LEXERS["rust" if lang == "rust" else "javascript"], [], 0, False
    while at < len(source):
        if source[at].isspace():
            at += 1
            continue
        kind, end = None, at
        if lang != "rust" and source[at] == "`":
            kind, end = "text", _template(source, at)
        elif lang != "rust" and source[at] == "/" and not value and (m := PATTERN.match(source, at)):
            kind, end = "text", m.end()
        else:
            m = lexer.match(source, at)
            kind, end = m.lastgroup if m.lastgroup != "fence" else "text", m.end()
        found.append(Token(kind, source[at:end], at, end))
        if kind != "comment":  # after a value a slash divides
            value = kind == "text" or kind == "word" and found[-1].text not in ("return", "typeof", "case", "in", "of") or found[-1].text in (")", "]", "}")
        at = end
    return found


def partners(found: list[Token]) -> dict[int, int]:
    """Place of the closing bracket of each opening one; brackets that do not match have none."""
    open_, pairs = [], {}
    for i, t in enumerate(found):
        if t.kind == "sign" and t.text in PAIRS:
            open_.append(i)
        elif t.kind == "sign" and t.text in PAIRS.values():
            if open_ and PAIRS[found[open_[-1]].text] == t.text:
                pairs[open_.pop()] = i
    return pairs


def declarations(source: str, lang: str) -> list[tuple[int, int, str, str]]:
    """(start, end, name, head) of the symbols declared outside brackets: places in the source, the name, and the words before it.

    A declaration that stands where a line begins runs to the end of its first braces, or to a semicolon before any; what is within is part of it.
    """
    all_ = tokens(source, lang)
    found = [t for t in all_ if t.kind != "comment"]
    pairs, out, i = partners(found), [], 0
    words, before = DECLARES["rust" if lang == "rust" else "javascript"], BEFORE["rust" if lang == "rust" else "javascript"]
    while i < len(found):
        if i in pairs:
            i = pairs[i] + 1
            continue
        first = i
        while i < len(found) and (found[i].text in before or found[i].text == "(" and i > first and found[i - 1].text == "pub" or i > first and found[i - 1].text == "extern" and found[i].kind == "text"):
            i = pairs.get(i, i) + 1
        begins = first < len(found) and not source[source.rfind("\n", 0, found[first].start) + 1 : found[first].start].strip()
        if i >= len(found) or found[i].text not in words or not begins:
            i = max(i, first + 1) if i == first else i
            continue
        stop = i
        while stop < len(found) and found[stop].text not in ("{", ";"):
            stop = pairs[stop] + 1 if stop in pairs and found[stop].text != "{" else stop + 1
        if stop < len(found) and found[stop].text == "{":
            close = pairs.get(stop)
            if close is None:
                i += 1
                continue
        else:
            close = min(stop, len(found) - 1)
        if found[i].text == "impl":
            name = source[found[i].end : found[stop].start if stop < len(found) else len(source)].strip()
            name = re.sub(r"^<[^>]*>\s*", "", name)
        else:
            name = next((t.text for t in found[i + 1 : stop] if t.kind == "word"), "")
        out.append((found[first].start, found[close].end, name, source[found[first].start : found[i].end]))
        i = close + 1
    return out


@dataclass
class Node:
    """A statement: its kind, place among the tokens (end exclusive), and parts by name as places or statements."""

    kind: str
    start: int
    end: int
    parts: dict = field(default_factory=dict)


class Tree:
    """Statements of a source: blocks are lists of nodes; what is not understood is a node of kind other."""

    def __init__(self, source: str, lang: str):
        self.source, self.lang = source, lang
        everything = tokens(source, lang)
        self.comments = [t for t in everything if t.kind == "comment"]
        self.found = [t for t in everything if t.kind != "comment"]
        self.pairs = partners(self.found)
        self.blocks: list[list[Node]] = []
        self.body = self.block(0, len(self.found))

    def at(self, i: int) -> str:
        return self.found[i].text if 0 <= i < len(self.found) else ""

    def text(self, first: int, stop: int) -> str:
        """Source of tokens first to stop, exclusive."""
        return self.source[self.found[first].start : self.found[stop - 1].end] if first < stop else ""

    def words(self, first: int, stop: int) -> list[str]:
        return [t.text for t in self.found[first:stop]]

    def commented(self, first: int, stop: int) -> bool:
        low, high = self.found[first].start, self.found[stop - 1].end
        return any(low <= c.start < high for c in self.comments)

    def pad(self, i: int) -> str:
        """White space before a token's line, null-free: empty unless the token begins its line."""
        at = self.found[i].start
        line = self.source[self.source.rfind("\n", 0, at) + 1 : at]
        return line if not line.strip() else ""

    def block(self, i: int, stop: int) -> list[Node]:
        out: list[Node] = []
        self.blocks.append(out)
        while i < stop:
            node = self.statement(i, stop)
            out.append(node)
            i = max(node.end, i + 1)
        return out

    def braces(self, i: int) -> tuple[list[Node], int] | None:
        """Statements of the block that opens at i, and the place behind it."""
        if self.at(i) == "{" and i in self.pairs:
            return self.block(i + 1, self.pairs[i]), self.pairs[i] + 1
        return None

    def opening(self, i: int, stop: int) -> int | None:
        """Place of the brace that ends a head without brackets of its own."""
        while i < stop and self.at(i) != "{":
            i = self.pairs.get(i, i) + 1
        return i if i < stop else None

    def head(self, i: int, stop: int) -> tuple[int, int, int] | None:
        """First and last place (exclusive) of what a statement tests, and the place of its body."""
        if self.lang == "rust":
            brace = self.opening(i, stop)
            return (i, brace, brace) if brace is not None else None
        return (i + 1, self.pairs[i], self.pairs[i] + 1) if self.at(i) == "(" and i in self.pairs else None

    def arm(self, i: int, stop: int) -> tuple[list[Node], int, bool]:
        """Body of an if or a loop: its statements, the place behind, whether it has braces."""
        found = self.braces(i)
        if found:
            return found[0], found[1], True
        one = self.statement(i, stop)
        self.blocks.append([one])
        return [one], one.end, False

    def statement(self, i: int, stop: int) -> Node:
        word = self.at(i)
        if word in ("if", "while", "for") and not (self.lang == "rust" and self.at(i + 1) == "let" and word == "if"):
            head = self.head(i + 1, stop)
            if head:
                body, end, braced = self.arm(head[2], stop)
                node = Node(word, i, end, {"test": head[:2], "body": body, "braced": braced, "at": head[2], "else": None})
                if word == "if" and self.at(end) == "else" and end < stop:
                    node.parts["else_at"] = end + 1
                    node.parts["else"], node.end, node.parts["else_braced"] = self.arm(end + 1, stop)
                return node
        if word in ("function", "async", "export", "class", "pub", "fn", "impl", "mod", "trait", "struct", "enum", "try", "do", "switch", "match", "loop", "unsafe") or word == "{":
            brace = self.opening(i, stop)
            if brace is not None and ";" not in self.words(i, brace):
                found = self.braces(brace)
                if found:
                    node = Node("function" if {"function", "fn"} & set(self.words(i, brace)) else "other", i, found[1], {"body": found[0], "head": (i, brace)})
                    while self.at(node.end) in ("catch", "finally", "while") and node.end < stop and word in ("try", "do"):
                        brace = self.opening(node.end, stop)
                        more = self.braces(brace) if brace is not None and self.at(node.end) != "while" else None
                        if not more:
                            break
                        node.end = more[1]
                    return node
        end = i
        while end < stop and self.at(end) != ";":
            if end in self.pairs and self.at(end) == "{":
                self.block(end + 1, self.pairs[end])
            end = self.pairs.get(end, end) + 1
        closed = end < stop
        kind = "return" if word == "return" else "throw" if word == "throw" else "bind" if word in ("const", "let", "var") else "use" if word == "use" else "plain"
        node = Node(kind, i, end + closed, {"closed": closed, "value": (i + 1 if kind in ("return", "throw") else i, end)})
        if kind == "bind":
            name = i + 1 + (self.at(i + 1) == "mut")
            if self.found[name].kind == "word" and self.at(name + 1) == "=" if name + 1 < end else False:
                node.parts |= {"name": self.at(name), "word": word, "mutable": self.at(i + 1) == "mut" or word in ("let", "var") and self.lang != "rust", "value": (name + 2, end)}
        return node
