"""Line dedup as an exact set-similarity join.

A line's tokens are its distinct windows of k words (A-Z in lower case), hashed. Tokens are ordered by rarity: by bucket
counts over the tokens of all lines, then by hash. Two lines of Jaccard similarity t or more share a token among the first
n - ceil(t n) + 1 of each; pairs that do, and pass the positional and length filters and the parity bits of their sets,
are verified on all their tokens. A line is removed if any earlier line (by doc_id, then line number) is similar or equal,
whether that one stays or not. So what stays does not depend on the order of the work.

Lines of equal sets are one line to the join, known by two hashes of the set and its size, with the earliest as its place
(doc_id, hash of the text, line number). One earlier match is enough, so no group lists its pairs: in each group that
shares a token every line first meets the group's earliest; only lines that this leaves unmatched meet the earlier others.
Sets of so few tokens that only equal ones are similar are not joined at all. Documents of verified pairs are re-read; a bitmap skips most others, or a join where there are too many for one.
Intermediate tables are deleted when the result is written.

Words are hashed and windows ordered in numpy, batch by batch; joins and decisions are DataFrame operations. A form in
DataFrame operations alone came first; README.md has its figures.

Defined results: lines are what line feeds separate; a line of fewer than k words has its whole sequence as only token, so
it goes where an earlier line is equal; lines of fewer than min_words words, blank ones among them, stay; null texts have
no lines that could go and stay null; rows that repeat doc_id and text count as one document whose equal lines are the
same line; a doc_id that stands for several texts is that many documents, in order of the texts' hashes, and one row of
decide; rows whose doc_id is null stay as they are; an empty table gives an empty result; other columns are kept, whatever
they are called; texts are read whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_map, few, scratch, settle, unused
from .lanes import U, Words, chunks, distinct, mix, ordered
from .ngram import _SEEDS, BUCKETS, SHIFT, SLICE, _able, _by_doc, _even, _least, _lists, _pack, _rarity, hit, reread

PARITY, REMEMBERED, _LOW = 128, 200_000, (1 << 64) - 1


class Lines:
    """Lines of at least min_words words of a chunk: doc (index in the chunk), line (number), and their tokens by (row, hash)."""

    def __init__(self, w: Words, k: int, min_words: int):
        breaks = np.flatnonzero(w.data == 10)
        at = np.sort(np.concatenate([w.offsets[:-1], breaks + 1]))
        first = np.searchsorted(w.start, at)
        count = np.diff(np.append(first, len(w.start)))
        doc = np.searchsorted(w.offsets, at, "right") - 1
        # where an empty line or text ends at a text's start, the last entry is that text's first line, and the others have no words
        number = np.arange(len(at)) - (np.searchsorted(at, w.offsets[:-1], "right") - 1)[np.minimum(doc, len(w.count) - 1)]
        rows = np.flatnonzero(count >= min_words)
        self.doc, self.line = doc[rows], number[rows]
        place = np.full(len(at), -1)
        place[rows] = np.arange(len(rows))
        owner = place[np.repeat(np.arange(len(at)), count)]
        n = len(owner) - k + 1
        begin = np.flatnonzero((owner[:n] >= 0) & (owner[:n] == owner[k - 1 :])) if n > 0 else np.empty(0, np.int64)
        token, row = w._window(begin, k), owner[begin]
        for size in range(min_words, k):
            short = rows[count[rows] == size]
            token = np.concatenate([token, w._window(first[short], size)])
            row = np.concatenate([row, place[short]])
        self.row, self.token = distinct(row, token)
        self.n, self.first = _by_doc(self.row, len(rows))

    def parity(self) -> list[np.ndarray]:
        """Columns of bits a line: which of PARITY classes of tokens are odd in number; a word a token at a time, however many lines there are."""
        at = mix(self.token ^ _SEEDS[2]) & U(PARITY - 1)
        bit = U(1) << (at & U(63))
        words = (np.where(at >> U(6) == U(i), bit, U(0)) for i in range(PARITY // 64))
        return [np.bitwise_xor.reduceat(w, self.first[:-1]).view(np.int64) if len(self.n) else np.empty(0, np.int64) for w in words]

    def signature(self, i: int) -> np.ndarray:
        return np.add.reduceat(mix(self.token ^ _SEEDS[i]), self.first[:-1]).view(np.int64) if len(self.n) else np.empty(0, np.int64)


def _summary(k: int, min_words: int):
    """Rows of lines (doc_id, h, line, n, sig_a, sig_b, b0, b1: parity), and for each task packed counts of its tokens by bucket (n: slice of buckets)."""
    names = ["is_doc", "doc_id", "h", "line", "n", "sig_a", "sig_b", "b0", "b1", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kind = np.zeros(BUCKETS, np.int64), None
        for batch in batches:
            kind = batch.column(0).type
            for begin, w in chunks(batch.column(1), lower=True):
                x = Lines(w, k, min_words)
                seen += np.bincount((x.token >> SHIFT).astype(np.int64), minlength=BUCKETS)
                ids = [batch.column(i).take(pa.array(x.doc + begin)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(x.n), bool)), *ids, pa.array(x.line.astype(np.int32)), pa.array(x.n), pa.array(x.signature(0)), pa.array(x.signature(1)), *map(pa.array, x.parity()), pa.nulls(len(x.n), pa.binary())], names)
        if kind is not None:
            slices, task = BUCKETS // SLICE, int.from_bytes(os.urandom(4))
            packed = [_pack(x) for x in seen.reshape(slices, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(slices, bool)), pa.nulls(slices, kind), pa.nulls(slices, pa.int64()), pa.nulls(slices, pa.int32()), pa.array(np.arange(slices)), pa.array(np.full(slices, task)), *[pa.nulls(slices, pa.int64())] * 3, pa.array(packed, pa.binary())], names)

    return run


def _least_size(percent: int) -> int:
    """Tokens that a set has at least if another, different one can be similar to it."""
    return -(-percent * -(-100 // (100 - percent)) // 100) if percent < 100 else 1 << 62


def _prefixes(k: int, percent: int, min_words: int, rarity: np.ndarray):
    """Rows (sig_a, n, p1: first tokens by rarity) of lines; a task gives a line that it remembers once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, w in chunks(batch.column(0), lower=True):
                x = Lines(w, k, min_words)
                order = ordered(x.row, rarity[(x.token >> SHIFT).astype(np.int64)], x.token)
                values, taken = _lists(x.token.view(np.int64), x.first, x.n, _least(x.n, percent), order)
                p1 = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken)]).astype(np.int32)), pa.array(values))
                sig, other = x.signature(0), x.signature(1)
                new = np.array([not (s in seen or seen.add(s)) for s in (a << 64 | b & _LOW for a, b in zip(sig.tolist(), other.tolist(), strict=True))], bool)
                new &= x.n >= _least_size(percent)
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(x.n), p1], ["sig_a", "n", "p1"]).filter(pa.array(new))

    return run


def _sets(k: int, min_words: int, bitmap: np.ndarray | None):
    """Rows (id, line, tokens) of the lines of documents that the bitmap marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bitmap is not None:
                batch = batch.filter(hit(bitmap, batch.column(2)))
            for begin, w in chunks(batch.column(1), lower=True):
                x = Lines(w, k, min_words)
                tokens = pa.ListArray.from_arrays(pa.array(x.first.astype(np.int32)), pa.array(x.token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x.doc + begin)), pa.array(x.line.astype(np.int32)), tokens], ["id", "line", "tokens"])

    return run


#: What tells the sets of lines apart.
KEY = ["sig_a", "sig_b", "n"]


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, min_words: int, kind: str) -> DataFrame:
    """Places x of the later lines of those pairs (x, y) of places whose sets are similar."""
    pairs = settle(pairs.distinct(), "lines-pairs")
    ends = settle(pairs.select(F.explode(F.array("x", "y")).alias("e")).select(F.struct("e.doc_id", "e.h").alias("id"), "e.line").distinct(), "lines-ends")
    sets = reread(docs.select(F.struct("doc_id", "h").alias("id"), "text"), ends.select("id").distinct(), lambda bitmap: _sets(k, min_words, bitmap), f"id struct<doc_id:{kind},h:bigint>, line int, tokens array<bigint>")
    sets = settle(sets.join(ends, ["id", "line"], "left_semi").dropDuplicates(["id", "line"]), "lines-sets")
    side = lambda c: sets.select(F.struct("id.doc_id", "id.h", "line").alias(c), F.col("tokens").alias(f"s{c}"))
    both = F.size(F.array_intersect("sx", "sy"))
    found = pairs.join(side("x"), "x").join(side("y"), "y").where(100 * both >= percent * (F.size("sx") + F.size("sy") - both))
    return settle(found.select("x").distinct(), "lines-late")


def _removed(docs: DataFrame, k: int, percent: int, min_words: int) -> DataFrame:
    """docs (doc_id, text, h) to (doc_id, h, removed): numbers of the lines that go, of documents that lose any."""
    kind = docs.dtypes[0][1]
    known = docs.where("doc_id is not null")
    summary = settle(arrow_map(known, _summary(k, min_words), f"is_doc boolean, doc_id {kind}, h long, line int, n long, sig_a long, sig_b long, b0 long, b1 long, counts binary"), "lines-summary")
    rarity = _rarity(summary)
    rows = summary.where("is_doc").select("doc_id", "h", "line", *KEY, "b0", "b1")
    first = settle(rows.groupBy(*KEY).agg(F.min(F.struct("doc_id", "h", "line")).alias("e"), F.count(F.lit(1)).alias("c"), F.min("b0").alias("b0"), F.min("b1").alias("b1")), "lines-first")

    prefixes = settle(arrow_map(known.select("text"), _prefixes(k, percent, min_words, rarity), "sig_a long, n long, p1 array<bigint>"), "lines-prefixes")
    # few columns: a row for every token of every line's prefix is shuffled. One signature does for proposing; the others come from the join
    listed = prefixes.select("sig_a", "n", F.posexplode("p1").alias("pos", "token")).select("token", "sig_a", F.expr("shiftleft(n, 32) | pos").alias("np"))
    # a token with one line proposes nothing; one shuffle serves to find the others, and a line is listed once a task at most
    group = Window.partitionBy("token")
    member = listed.withColumn("differ", F.min("sig_a").over(group) != F.max("sig_a").over(group)).where("differ")
    member = member.groupBy("token", "sig_a", F.expr("shiftright(np, 32)").alias("n")).agg(F.min(F.expr("cast(np & 4294967295 as int)")).alias("pos"))
    # from here on a set is known by its place, and signatures need not be carried
    member = settle(member.join(first.drop("c"), ["sig_a", "n"]).drop("sig_a", "sig_b"), "lines-members")
    # each line beside its group's earliest; where a group has only one other, that comparison is the last
    group, lead = Window.partitionBy("token"), F.col("lead")
    member = member.withColumns({"lead": F.min(F.struct("e", "n", "pos", "b0", "b1")).over(group), "c": F.count(F.lit(1)).over(group)}).where(F.col("e") != lead.e)
    able = _able(F.col("n"), F.col("pos"), lead.n, lead.pos, percent) & _even(F.col("n"), F.array("b0", "b1"), lead.n, F.array(lead.b0, lead.b1), percent, PARITY)
    later = settle(member.select("token", "e", "n", "pos", "b0", "b1", "c", F.when(able, lead.e).alias("y")), "lines-later")
    late = _verified(known, later.where("y is not null").select(F.col("e").alias("x"), "y"), k, percent, min_words, kind)

    crowd = later.where("c > 2")
    probe = crowd.join(few(late.toDF("e")), "e", "left_anti").select("token", F.col("e").alias("x"), F.col("n"), F.col("pos").alias("xpos"), F.array("b0", "b1").alias("xbits"))
    others = crowd.select("token", F.col("e").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("ypos"), F.array("b0", "b1").alias("ybits"))
    able = _able(F.col("yn"), F.col("ypos"), F.col("n"), F.col("xpos"), percent) & _even(F.col("yn"), F.col("ybits"), F.col("n"), F.col("xbits"), percent, PARITY)
    rest = probe.join(others, "token").where((F.col("y") < F.col("x")) & able).select("x", "y")
    late = late.unionByName(_verified(known, rest, k, percent, min_words, kind)).distinct()

    fate = settle(first.join(few(late.toDF("e").withColumn("late", F.lit(True))), "e", "left").where("late or c > 1").select(*KEY, "e", F.coalesce("late", F.lit(False)).alias("late")), "lines-fate")
    away = rows.drop("b0", "b1").join(few(fate), KEY).where(F.col("late") | (F.struct("doc_id", "h", "line") != F.col("e")))
    return settle(away.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("removed")), "lines-removed", keep=True)


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))


def decide(docs: DataFrame, k: int = 5, percent: int = 80, min_words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per doc_id: doc_id, n_lines, removed (numbers of its lines that go, from 0, in order); of several texts under one doc_id, the most lines and all numbers."""
    docs = _hashed(docs, doc_id, text)
    with scratch():
        away = _removed(docs, k, percent, min_words).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))
    counted = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0))).alias("n_lines"))
    none = F.expr("cast(array() as array<int>)")
    return counted.join(away, "doc_id", "left").select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("removed", none).alias("removed"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80, min_words: int = 1, doc_id: str = "doc_id", text: str = "text", drop_empty: bool = False) -> DataFrame:
    """docs with the removed lines cut out of text; drop_empty drops documents of which no word is left by that."""
    name, h, gone, left = unused(docs, "name", "h", "gone", "left")
    with scratch():
        cut = _removed(_hashed(docs, doc_id, text), k, percent, min_words).toDF(name, h, gone)
    lines = F.split(F.col(text), "\n")
    numbered = F.arrays_zip(lines.alias("t"), F.sequence(F.lit(0), F.size(lines) - 1).alias("i"))
    kept = F.transform(F.filter(numbered, lambda x: ~F.array_contains(F.col(gone), x["i"])), lambda x: x["t"])
    changed = F.col(gone).isNotNull()
    out = docs.withColumns({name: F.col(doc_id), h: F.xxhash64(F.col(text))}).join(cut, [name, h], "left")
    out = out.withColumn(left, F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text)))
    if drop_empty:
        out = out.where(~changed | F.col(left).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col(left).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
