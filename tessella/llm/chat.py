"""Chat formatting: turns of a conversation become one marked-up text with a loss mask, in Spark expressions only.

Template: <|im_start|>role<|text|>text<|turn|>text<|im_end|>\\n for each run of turns of one role. Adjacent turns of the
same role share one block; <|turn|> keeps their border, so the turns can be read back exactly.

Escaping: wherever a text or role holds a control string (c followed by rest, with any number of backslashes between the
two), one more backslash goes after c. Reading back removes one. An escaped text holds no control string, and since no
control string holds a backslash, the change is a bijection.

Defined results: null roles and texts count as empty; turns are ordered by turn (null first), ties by role, then text;
repeated rows stay as turns of their own; an empty table gives an empty result; other columns are ignored. All turns of
one conversation meet in one row, because they are one row of the result; a conversation has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
BEGIN, TEXT, TURN, END = "<|im_start|>", "<|text|>", "<|turn|>", "<|im_end|>"
#: What makes a control string after "<" and after "["; any "<|" counts, whatever follows.
AFTER_ANGLE, AFTER_BRACKET = r"(?:\||/?s>|/?unk>|pad>|<SYS>>|</SYS>>)", r"(?:/?INST\]|/?SYSTEM_PROMPT\])"


def escape(text: Column) -> Column:
    """Add a backslash after the first character of each control string."""
    return F.regexp_replace(text, rf"(?<=<)(?=\\*{AFTER_ANGLE})|(?<=\[)(?=\\*{AFTER_BRACKET})", r"\\")


def unescape(text: Column) -> Column:
    """Take that backslash away."""
    return F.regexp_replace(text, rf"(?<=<)\\(?=\\*{AFTER_ANGLE})|(?<=\[)\\(?=\\*{AFTER_BRACKET})", "")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted string, loss_spans array of (start, end) code points of the texts of role learn."""
    empty = F.lit("")
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    marked = F.transform("turns", lambda t: F.struct(t.role.alias("role"), escape(t.role).alias("shown"), escape(t.text).alias("text")))
    rows = chats.select("conv_id", marked.alias("turns"))
    # each turn beside the role of the turn before; the last entry has no turn
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t.role))
    pairs = F.filter(F.arrays_zip(F.col("turns").alias("t"), before.alias("last")), lambda p: p["t"].isNotNull())
    opened = lambda t: F.concat(F.lit(BEGIN), t.shown, F.lit(TEXT))
    head = lambda t, last: F.when(last.eqNullSafe(t.role), F.lit(TURN)).when(last.isNull(), opened(t)).otherwise(F.concat(F.lit(END + "\n"), opened(t)))
    shown = F.transform(pairs, lambda p: F.struct(head(p["t"], p["last"]).alias("head"), p["t"].text.alias("text"), (p["t"].role == learn).alias("learn")))
    rows = rows.select("conv_id", shown.alias("shown"))
    formatted = F.concat(F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["text"])), ""), F.lit(END + "\n"))
    return rows.select(F.col("conv_id").alias(conv), formatted.alias("formatted"), _spans(F.col("shown")).alias("loss_spans"))


def _blocks(items: Column, size: int) -> Column:
    """An array cut into arrays of size."""
    at = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(items, i, F.lit(size)))


def _spans(shown: Column) -> Column:
    """(start, end) of the texts to learn, where heads and texts stand one after the other.

    An aggregation that appends copies what it has; blocks keep these copies short, so the time grows with the turns.
    """
    long = F.lit(0).cast("long")
    size = F.transform(_blocks(shown, BLOCK), lambda b: F.aggregate(b, long, lambda n, x: n + F.length(x["head"]) + F.length(x["text"])))
    starts = F.aggregate(size, F.array(long), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def add(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["head"])
        end = begin + F.length(x["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["learn"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    parts = F.filter(F.arrays_zip(_blocks(shown, BLOCK).alias("b"), starts.alias("at")), lambda p: p["b"].isNotNull())
    return F.flatten(F.transform(parts, lambda p: F.aggregate(p["b"], F.struct(p["at"].alias("at"), none.alias("spans")), add, lambda a: a["spans"])))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) that a formatted text holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        cut = F.split(F.substring_index(block, END, 1), r"<\|text\|>", 2)
        return F.transform(F.split(cut[1], r"<\|turn\|>", -1), lambda t: F.struct(unescape(cut[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def _cut(text: Column, at: Column, spans: Column, sizes: tuple[int, ...]) -> Column:
    """The texts at spans, where text begins at code point at. A cut counts code points from the start, so blocks of spans are cut out first."""
    take = lambda first, last: F.substring(text, (first["start"] - at + 1).cast("int"), (last["end"] - first["start"]).cast("int"))
    if not sizes:
        return F.transform(spans, lambda s: take(s, s))
    parts = F.transform(_blocks(spans, sizes[0]), lambda b: F.struct(take(b[0], F.element_at(b, -1)).alias("text"), b[0]["start"].alias("at"), b.alias("spans")))
    return F.flatten(F.transform(parts, lambda p: _cut(p["text"], p["at"], p["spans"], sizes[1:])))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(_cut(formatted, F.lit(0), spans, (BLOCK * BLOCK, BLOCK)), unescape), "")
