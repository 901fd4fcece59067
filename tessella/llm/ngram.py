"""N-gram Jaccard join: links between texts whose sets of word n-grams are similar, without comparing all pairs.

Texts of equal sets form a class, represented by its smallest doc_id. Under any global order of the tokens, two sets of
Jaccard similarity t or more share a token among their first n - ceil(t n) + 1 (the prefix). Three orders are used:
rarest first, by bucket counts over the tokens of all documents (fixed in number, so of a known size to send), and two orders by different hashes. A pair is a candidate
only if its prefixes meet under every order, and lengths, positions and what the prefixes show to differ allow it: below
the smaller end of two prefixes of one order both sets are known, so tokens found on one side only are truly missing; and
bits of parity per set of hashed tokens differ in no more places than the sets do.
Only candidates are verified.

Pairs are not listed group by group. In each group of texts that share a rare token everybody is compared with the
smallest member first; components are formed; then only members outside their group's main component are compared, with
the members of other components, so a group of thousands of near copies costs a pair per member. A token whose group is
large is refined: members meet only if they share a token of their second prefix too. This loses no link between different
components: every similar pair shares a rare-prefix token and either is in one component already or has a member outside.

Texts are re-read for verification. A bitmap of hashed ids, at least PER_ID bits an id and at most 2^MOST bits, skips most
others; for more ids than that the texts are joined with the ids. It only saves work: what it lets through wrongly meets
no pair. Intermediate tables are deleted when the result is written.

Defined results: a text of fewer than k words has its whole sequence as only token; null, empty and blank texts have an
empty set and are linked with nothing; repeated rows are copies; a doc_id that stands for several texts is that many
documents, each told by id and hash of its text; rows whose doc_id is null have a null component, and keep_one keeps them
once per different text; an empty table gives an empty result; other columns are ignored, or kept by keep_one, whatever
they are called; texts are read whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, few, scratch, settle, unused
from .lanes import U, chunks, mix, ordered
from .links import components

#: Counted buckets of tokens; members above which a group is refined; parity bits of a set.
BUCKETS, LARGE, PARITY = 1 << 20, 1024, 512
#: Bits of the bitmap: as many an id, and the most and least in all, as powers of two (2^27 bits are 16 MB).
PER_ID, MOST, LEAST = 4, 27, 16
SHIFT, SLICE, FAN = U(64 - BUCKETS.bit_length() + 1), 1 << 12, 64
_SEEDS = [U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0), U(0x082EFA98EC4E6C89)]


def _by_doc(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(doc, minlength=n_docs)
    return size, np.concatenate([[0], np.cumsum(size)])


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def _unpack(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), np.int64)


def _rarity(summary: DataFrame) -> np.ndarray:
    """Class of each bucket of tokens, by how many tokens of all documents fell in it; slices of buckets are added up in a tree."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in rows["counts"]:
            total += _unpack(x.as_py())
        at = rows.schema.get_field_index("counts")
        return rows.slice(0, 1).set_column(at, "counts", pa.array([_pack(total)], pa.binary()))

    rows = summary.where("not is_doc").select("n", F.pmod("sig_a", F.lit(FAN)).alias("branch"), "counts")
    schema = rows.schema
    rows = rows.groupBy("n", "branch").applyInArrow(add, schema).groupBy("n").applyInArrow(add, schema)
    counts = np.zeros((BUCKETS // SLICE, SLICE), np.int64)
    for r in rows.collect():
        counts[r.n] = _unpack(r.counts)
    return np.round(4 * np.log2(counts.ravel() + 1)).astype(np.uint8)


def _summary(k: int):
    """Rows (doc_id, h, n, sig_a, sig_b) of documents, and for each task rows (n: number of a slice of buckets, counts: packed) of how many tokens fell in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, names = np.zeros(BUCKETS, np.int64), ["is_doc", "doc_id", "h", "n", "sig_a", "sig_b", "counts"]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            size, sums = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows), U)
            for begin, w in chunks(batch.column(1), lower=True):
                doc, token = w.shingles(k)
                seen += np.bincount((token >> SHIFT).astype(np.int64), minlength=BUCKETS)
                n, first = _by_doc(doc, len(w.count))
                size[begin : begin + len(n)] = n
                full = np.flatnonzero(n)
                for i in range(2):
                    if len(full):
                        sums[i, begin + full] = np.add.reduceat(mix(token ^ _SEEDS[i]), first[full])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(size), bool)), batch.column(0), batch.column(2), pa.array(size), *[pa.array(x.view(np.int64)) for x in sums], pa.nulls(len(size), pa.binary())], names)
        if kind is not None:
            slices, task = BUCKETS // SLICE, int.from_bytes(os.urandom(4))
            packed = [_pack(x) for x in seen.reshape(slices, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(slices, bool)), pa.nulls(slices, kind), pa.nulls(slices, pa.int64()), pa.array(np.arange(slices)), pa.array(np.full(slices, task)), pa.nulls(slices, pa.int64()), pa.array(packed, pa.binary())], names)

    return run


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix of a set of n tokens."""
    return n + (-n * percent // 100) + 1


def _lists(values: np.ndarray, first: np.ndarray, size: np.ndarray, keep: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first keep values of each document in an order, and how many."""
    rank = np.arange(len(order)) - np.repeat(first[:-1], size)
    taken = rank < np.repeat(keep, size)
    return values[order][taken], np.minimum(keep, size)


def _prefixes(k: int, percent: int, rarity: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], []]
            sizes: list[list[np.ndarray]] = [[], [], []]
            total, parity = [], []
            for _, w in chunks(batch.column(1), lower=True):
                doc, token = w.shingles(k)
                n, first = _by_doc(doc, len(w.count))
                keep = np.where(n > 0, _least(n, percent), 0)
                rare = ordered(doc, rarity[(token >> SHIFT).astype(np.int64)], token)
                others = [mix(token ^ _SEEDS[i]) for i in (2, 3)]
                ways = [(token.view(np.int64), keep, rare), *[((x >> U(33)).astype(np.int32), keep, np.lexsort((x, doc))) for x in others]]
                for i, (values, most, order) in enumerate(ways):
                    values, taken = _lists(values, first, n, most, order)
                    parts[i].append(values)
                    sizes[i].append(taken)
                total.append(n)
                odd = np.bincount(doc * PARITY + (others[0] & U(PARITY - 1)).astype(np.int64), minlength=len(n) * PARITY) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            offsets = [pa.array(np.concatenate([[0], np.cumsum(np.concatenate(x or [[]]))]).astype(np.int32)) for x in sizes]
            lists = [pa.ListArray.from_arrays(offsets[i], pa.array(np.concatenate(p) if p else np.empty(0, np.int64 if i == 0 else np.int32))) for i, p in enumerate(parts)]
            width = PARITY // 64
            bits = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(np.concatenate(parity) if parity else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(total or [[]]).astype(np.int64)), *lists, bits], ["doc_id", "n", "p1", "p2", "p3", "bits"])

    return run


def marked(ids: DataFrame) -> np.ndarray | None:
    """Bitmap of the hashes of ids (one column); null if there are too many for one."""
    n = ids.count()
    if n * PER_ID > 1 << MOST:
        return None
    bits = 1 << max(LEAST, min(MOST, (16 * n).bit_length()))
    bit = ids.select(F.xxhash64(ids.columns[0]).bitwiseAND(bits - 1).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toArrow()
    bitmap = np.zeros(bits // 64, U)
    bitmap[np.asarray(words["at"])] = np.asarray(words["word"]).view(U)
    return bitmap


def hit(bitmap: np.ndarray, hashes: pa.Array) -> pa.Array:
    """Which of the hashes are marked in a bitmap."""
    bit = np.asarray(hashes).astype(np.int64) & (len(bitmap) * 64 - 1)
    return pa.array((bitmap[bit >> 6] >> (bit & 63).astype(U)) & U(1) == 1)


def reread(texts: DataFrame, ids: DataFrame, function, schema: str) -> DataFrame:
    """function of texts (id, text), by way of Arrow, for the rows whose id is in ids, and perhaps others; function takes a bitmap or null."""
    name, bitmap = texts.columns[0], marked(ids)
    if bitmap is None:
        texts = texts.join(ids.toDF(name), name, "left_semi")
    return arrow_map(texts.withColumn("hashed", F.xxhash64(name)), function(bitmap), schema)


def _sets(k: int, bitmap: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bitmap is not None:
                batch = batch.filter(hit(bitmap, batch.column(2)))
            values, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, w in chunks(batch.column(1), lower=True):
                doc, token = w.shingles(k)
                values.append(token.view(np.int64))
                sizes.append(_by_doc(doc, len(w.count))[0])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))], ["doc_id", "tokens"])

    return run


def _even(n: Column, a: Column, m: Column, b: Column, percent: int, parity: int = PARITY) -> Column:
    """Whether parity bits differ in no more places than two similar sets of n and m tokens could."""
    differ = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(parity // 64)), F.lit(0))
    return differ <= n + m - 2 * F.ceil(percent * (n + m) / (100 + percent))


def _verified(docs: DataFrame, pairs: DataFrame, prefixes: DataFrame, k: int, percent: int, kind: str) -> DataFrame:
    """Of pairs (a, b) those that pass the other orders and whose sets are similar."""
    side = lambda x, *names: prefixes.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in names])
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    near = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b").where(_even(F.col("na"), F.col("bitsa"), F.col("nb"), F.col("bitsb"), percent))
    near = settle(near.select("a", "b", "na", "nb").distinct(), "ngram-even")
    near = near.join(side("a", "p2", "p3"), "a").join(side("b", "p2", "p3"), "b")
    for p in ("p2", "p3"):
        low = F.array(F.least(F.array_max(f"{p}a"), F.array_max(f"{p}b")))  # in an array, so that lambdas take it as a value
        missing = lambda x, y, p=p, low=low: F.get(F.transform(low, lambda end: F.size(F.filter(F.array_except(f"{p}{x}", f"{p}{y}"), lambda v: v < end))), F.lit(0))
        near = near.where(F.arrays_overlap(f"{p}a", f"{p}b")).where(missing("a", "b") <= F.col("na") - need).where(missing("b", "a") <= F.col("nb") - need)
    near = settle(near.select("a", "b").distinct(), "ngram-near")
    ids = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
    sets = reread(docs, settle(ids, "ngram-ids"), lambda bitmap: _sets(k, bitmap), f"doc_id {kind}, tokens array<bigint>")
    sets = settle(sets, "ngram-sets").dropDuplicates(["doc_id"])
    named = lambda x: sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return settle(near.join(named("a"), "a").join(named("b"), "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "ngram-links")


def _able(n: Column, pos: Column, m: Column, other: Column, percent: int) -> Column:
    """Length and positional filter for two sets that share a token at these positions of the rare order."""
    most = F.least(pos, other) + 1 + F.least(n - pos - 1, m - other - 1)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (most * (100 + percent) >= percent * (n + m))


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """docs (doc_id, text) to a row per document: doc_id, h (hash of the text), n_shingles, component_id, gone (it is not the first of its component)."""
    docs = docs.withColumn("h", F.xxhash64("text"))
    kind = docs.dtypes[0][1]
    summary = settle(arrow_map(docs, _summary(k), f"is_doc boolean, doc_id {kind}, h long, n long, sig_a long, sig_b long, counts binary"), "ngram-summary")
    rarity = _rarity(summary)

    rows = summary.where("is_doc").select("doc_id", "h", "n", "sig_a", "sig_b")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z")
    repeated = not several.isEmpty()
    # a node is an id, or an id and a hash where ids stand for several texts
    node = F.struct("doc_id", "h") if repeated else F.col("doc_id")
    rows, texts = rows.withColumn("own", F.when(F.col("doc_id").isNotNull(), node)), docs.where("doc_id is not null").select(node.alias("doc_id"), "text")
    kind = texts.dtypes[0][1]
    key = ["sig_a", "sig_b", "n"]
    copies = settle(rows.where("n > 0").groupBy(*key).agg(F.min("own").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "ngram-copies")
    grouped = settle(rows.where("n > 0").join(few(copies), key, "left").select("doc_id", "h", "n", "own", F.coalesce("rep", "own").alias("rep")), "ngram-classes")
    gone = grouped.where("own <> rep").select(F.col("own").alias("doc_id"))
    prefixes = arrow_map(texts, _prefixes(k, percent, rarity), f"doc_id {kind}, n long, p1 array<bigint>, p2 array<int>, p3 array<int>, bits array<bigint>")
    prefixes = settle(prefixes.where("n > 0").join(gone, "doc_id", "left_anti"), "ngram-prefixes")

    listed = prefixes.select("doc_id", "n", F.posexplode("p1").alias("pos", "token")).select("token", "doc_id", F.struct("doc_id", "n", "pos").alias("m"))
    groups = listed.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("lead")).where("c > 1")
    member = settle(listed.join(groups, "token").select("token", "c", "lead", "m"), "ngram-members")
    m, lead = F.col("m"), F.col("lead")
    first = member.where((m.doc_id != lead.doc_id) & _able(m.n, m.pos, lead.n, lead.pos, percent)).select(lead.doc_id.alias("a"), m.doc_id.alias("b")).distinct()
    links = _verified(texts, first, prefixes, k, percent, kind)
    labels = components(links)

    owner = lambda c, name: labels.select(F.col("node").alias(c), F.col("label").alias(name))
    member = member.select("token", "c", "m", m.doc_id.alias("x"), lead.doc_id.alias("y")).join(owner("x", "lx"), "x", "left").join(owner("y", "ly"), "y", "left")
    member = settle(member.select("token", "c", "m", F.coalesce("lx", "x").alias("own"), F.coalesce("ly", "y").alias("main")), "ngram-owned")
    split = member.where("own <> main").select("token").distinct()
    # members carry their parity bits, so that the join itself drops what cannot be similar
    member = member.join(split, "token", "left_semi").select("*", F.col("m.doc_id").alias("doc_id")).join(prefixes.select("doc_id", "bits"), "doc_id")
    fine = member.where(F.col("c") > LARGE).join(prefixes.select("doc_id", "p2"), "doc_id").select("token", "m", "own", "main", "bits", F.explode("p2").alias("second"))
    coarse = member.where(F.col("c") <= LARGE).select("token", "m", "own", "main", "bits", F.lit(0).alias("second"))
    member = coarse.unionByName(fine)
    odd = member.where("own <> main").select("token", "second", F.col("m").alias("o"), F.col("own").alias("odd_own"), F.col("bits").alias("odd_bits"))
    o = F.col("o")
    able = (F.col("own") != F.col("odd_own")) & _able(m.n, m.pos, o.n, o.pos, percent) & _even(m.n, F.col("bits"), o.n, F.col("odd_bits"), percent)
    pairs = odd.join(member, ["token", "second"]).where(able).select(F.least(m.doc_id, o.doc_id).alias("a"), F.greatest(m.doc_id, o.doc_id).alias("b")).distinct()
    more = _verified(texts, settle(pairs, "ngram-pairs"), prefixes, k, percent, kind)
    labels = components(links.unionByName(more))

    found = grouped.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), "own", F.when(F.col("own").isNotNull(), F.coalesce("label", "rep")).alias("label"))
    found = found.unionByName(rows.where("n = 0").select("doc_id", "h", F.col("n").alias("n_shingles"), "own", F.col("own").alias("label")))
    component = F.col("label.doc_id" if repeated else "label")
    return found.select("doc_id", "h", "n_shingles", component.alias("component_id"), (F.col("own") != F.col("label")).alias("gone"))


def classes(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links of percent or more)."""
    with scratch():
        rows = _classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k, percent)
        return settle(rows.select("doc_id", "n_shingles", "component_id"), "ngram-found", keep=True)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which no similar document has a smaller doc_id in its component; rows that repeat doc_id and text stay once."""
    name, h = unused(docs, "name", "h")
    with scratch():
        rows = _classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k, percent)
        rows = settle(rows.select(F.col("doc_id").alias(name), F.col("h").alias(h), "gone"), "ngram-kept", keep=True)
    gone = rows.where("gone").select(name, h).distinct()
    found = docs.withColumns({name: F.col(doc_id), h: F.xxhash64(F.col(text))}).join(gone, [name, h], "left_anti")
    if not rows.where("gone is null or not gone").groupBy(name, h).count().where("count > 1").isEmpty():
        found = found.dropDuplicates([name, h])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
