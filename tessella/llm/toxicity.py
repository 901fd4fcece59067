"""Toxicity: bags of subwords, embedded, averaged and put into a linear softmax; embeddings and softmax are trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed to BUCKETS), so unseen misspellings and inflections
share vectors with words seen. A word of more than LONG characters (a paragraph without spaces, a long URL) is taken as
overlapping pieces of PIECE characters, each a word, so that all of its n-grams count. A window of WINDOW words is the mean of its words; a text scores as its highest window, so
a long text is not averaged away. Training first fits whole texts, then each text's highest window.

The model is linear in the mean, so for scoring a word is one number: words are scored once per task and looked up.

Sample: at most SAMPLE rows of each class, those of smallest hashed id, of texts up to SAMPLE_CHARS characters, and of those
as many as have SAMPLE_TOTAL characters a class; the logit is corrected for the classes' true shares. One task trains; the
driver gets one weight a bucket.

Defined results: null and empty texts have no words and score as the intercept does; without labelled rows of both
classes every text scores the share of toxic labels seen (0 without any); repeated labels of a document count once, toxic
if any is; repeated documents are scored each, and of texts that share a labelled doc_id the first in order is
learnt from; an empty table gives an empty result; other columns are ignored; texts are
scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow_map

SAMPLE, SAMPLE_CHARS, SAMPLE_TOTAL = 2000, 100_000, 16_000_000
BUCKETS, DIM, GRAMS, HALF = 1 << 17, 8, (3, 4, 5, 6), 24
STEPS, BATCH, RATE, SEED, CACHE, PART = 500, 64, 0.5, 7, 150_000, 1 << 14
MIN_DOCS, DROPPED, DECAY = 5, 0.5, 0.0005
LONG, PIECE = 64, 16
_STRIP = b".,;:!?\"'()[]{}"


@dataclass
class Model:
    weights: np.ndarray  # per bucket, the embedding times the difference of the softmax rows
    bias: float
    flat: float | None = None  # the score of every text, where there was nothing to learn from

    def words(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to the logit when it stands alone."""
        rows, at = subwords(words)
        return np.add.reduceat(self.weights[at], rows[:-1]) / np.diff(rows) if len(words) else np.empty(0)


def tokens(text: str) -> list[bytes]:
    words = text.lower().encode("utf-8", "ignore").split()
    if not words or max(map(len, words)) <= LONG:
        return words
    return [p for w in words for p in (pieces(w) if len(w) > LONG else (w,))]


def pieces(word: bytes) -> list[bytes]:
    """A long word as pieces between blanks, which overlap so that each n-gram is whole in one."""
    shown = (word.strip(_STRIP) or word).decode("utf-8", "ignore")
    if len(shown) <= LONG:
        return [word]
    step = PIECE - max(GRAMS)
    return [f" {shown[i : i + PIECE]} ".encode("utf-8", "ignore") for i in range(0, len(shown) - max(GRAMS), step)]


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than words) and buckets of each word's n-grams and of the word itself; a part of the words at a time."""
    parts = [_subwords(words[i : i + PART]) for i in range(0, len(words), PART)] or [_subwords([])]
    size = np.concatenate([np.diff(rows) for rows, _ in parts])
    return np.concatenate([[0], np.cumsum(size)]), np.concatenate([at for _, at in parts])


def _subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    # a piece keeps its punctuation and has blanks in place of a word's borders
    shown = [w.decode("utf-8", "ignore") if w[:1] == b" " else f"<{(w.strip(_STRIP) or w).decode('utf-8', 'ignore')}>" for w in words]
    size = np.array([len(w) for w in shown], np.int64)
    points = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(words)), size)
    who, what = [np.arange(len(words))], [np.zeros(len(words), np.uint64)]
    mixed = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    run = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if n > len(points):
            break
        run = run[: len(points) - n + 1] * np.uint64(0x100000001B3) + (mixed[n - 1 :] ^ (mixed[n - 1 :] >> np.uint64(29)))
        if n in GRAMS:
            at = np.flatnonzero(owner[: len(run)] == owner[n - 1 :])
            who.append(owner[at])
            what.append(run[at] + np.uint64(n))
    total = np.add.reduceat(mixed ^ ((np.arange(len(points), dtype=np.uint64) - np.repeat(first[:-1], size).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)), first[:-1]) if len(words) else what[0]
    what[0] = total
    who_all, what_all = np.concatenate(who), np.concatenate(what)
    what_all = what_all ^ (what_all >> np.uint64(31))
    what_all = what_all * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(who_all, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(who_all, minlength=len(words)))]), ((what_all >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)[order]


def best_window(ids: np.ndarray, scores: np.ndarray) -> tuple[float, int]:
    """Highest window of a text of word ids, and where it starts. Windows are two neighbouring blocks of HALF words; a repeated word adds once to a window and counts in its length each time."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    before = np.full(n, -1)
    again = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    first = np.arange(0, n, HALF)
    begin = np.arange(n) // HALF * HALF
    alone = np.add.reduceat(scores * (before < begin), first)
    size = np.diff(np.append(first, n))
    if len(first) == 1:
        return float(alone[0] / n), 0
    after = np.add.reduceat(scores * (before < begin - HALF), first)
    value = (alone[:-1] + after[1:]) / (size[:-1] + size[1:])
    best = int(np.argmax(value))
    return float(value[best]), best * HALF


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] entries, then first[1] and so on."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def train(texts: list[str], labels: list[int], prior: float | None = None) -> Model:
    """Fit embeddings and softmax by minibatches with per-bucket step sizes; prior: true share of label 1."""
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(BUCKETS), 0.0, share)
    ids: dict[bytes, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in tokens(t)], np.int64) for t in texts]
    rows, at = subwords(list(ids))
    del ids
    size = np.diff(rows)
    common = np.zeros(BUCKETS, np.int32)
    for d in docs:
        mine = np.unique(d)
        common[np.unique(at[_ranges(rows[mine], size[mine])])] += 1
    kept = common[at] >= MIN_DOCS
    at, rows = at[kept], np.concatenate([[0], np.cumsum(kept)])[rows]
    held = np.diff(rows)
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, seen_soft, seen_bias = np.full(BUCKETS, 1e-6, np.float32), np.full(soft.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    spans = [(0, len(d)) for d in docs]
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)  # classes weigh alike

    def word_scores() -> np.ndarray:
        value, out = vectors @ (soft[:, 1] - soft[:, 0]), np.empty(len(size))
        for i in range(0, len(size), PART):  # a part at a time: in all there are millions of n-grams
            cut = rows[i : i + PART + 1]
            sums = np.concatenate([[0], np.cumsum(value[at[cut[0] : cut[-1]]], dtype=np.float64)])
            out[i : i + PART] = np.diff(sums[cut - cut[0]]) / size[i : i + PART]
        return out

    order = np.empty(0, np.int64)
    for step in range(STEPS):
        if step >= STEPS // 3 and step % max(1, STEPS // 12) == 0:
            score = word_scores()
            for i, d in enumerate(docs):
                if len(d) > 2 * HALF:
                    begin = best_window(d, score[d])[1]
                    spans[i] = (begin, min(len(d), begin + 2 * HALF))
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(docs))])
        batch, order = order[:BATCH], order[BATCH:]
        parts = [docs[i][slice(*spans[i])] for i in batch]
        count = np.array([max(1, (1 - DROPPED) * len(p)) for p in parts], np.float32)
        parts = [np.unique(p) for p in parts]
        parts = [p[rng.random(len(p)) >= DROPPED] for p in parts]
        owner = np.repeat(np.arange(len(batch)), [len(p) for p in parts])
        used, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        k, n = held[used], size[used]
        flat, word_of = at[_ranges(rows[used], k)], np.repeat(np.arange(len(used)), k)
        word = np.stack([np.bincount(word_of, vectors[flat, j], len(used)) for j in range(DIM)], 1) / n[:, None]
        mean = np.stack([np.bincount(owner, word[inverse, j], len(batch)) for j in range(DIM)], 1).astype(np.float32) / count[:, None]
        logits = mean @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        wrong = (p - np.eye(2, dtype=np.float32)[y[batch]]) * weight[batch, None]
        back = (wrong @ soft.T) / count[:, None]
        grad_word = np.stack([np.bincount(inverse, back[owner, j], len(used)) for j in range(DIM)], 1) / n[:, None]
        grad = grad_word[word_of]
        hit, where = np.unique(flat, return_inverse=True)
        grad = np.stack([np.bincount(where, grad[:, j], len(hit)) for j in range(DIM)], 1).astype(np.float32)
        seen[hit] += (grad**2).mean(1)
        vectors[hit] -= RATE * (grad / np.sqrt(seen[hit])[:, None] + DECAY * vectors[hit])
        for value, slope, past in ((soft, mean.T @ wrong / len(batch), seen_soft), (bias, wrong.sum(0) / len(batch), seen_bias)):
            past += slope**2
            value -= 0.3 * RATE * slope / np.sqrt(past)
    prior = share if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    vectors[common < MIN_DOCS] = 0
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]) + math.log(prior / (1 - prior)))


def scorer(model: Model, at_text: int = 1, keep: bool = False):
    """A function for mapInArrow: batches with the text in column at_text to their other columns, or all of them, and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        scores = np.empty(0)

        def learn(words: set[bytes]) -> None:
            nonlocal scores
            new = [w for w in words if w not in known]
            if len(known) + len(new) > CACHE:
                known.clear()
                new, scores = list(words), np.empty(0)
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                scores = np.concatenate([scores, model.words(new)])

        def score(words: list[bytes]) -> float:
            value = 0.0
            if words:
                ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                value = best_window(ids, scores[ids])[0]
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, model.bias + value))))

        for batch in batches:
            texts, found = batch.column(at_text), [model.flat] * batch.num_rows
            at = 0
            while model.flat is None and at < len(texts):
                # words of many texts are scored at a time; a long text is taken alone
                part, size = [], 0
                while at + len(part) < len(texts) and size < 1 << 20:
                    part.append(tokens(texts[at + len(part)].as_py() or ""))
                    size += sum(map(len, part[-1]))
                learn(set().union(*part))
                found[at : at + len(part)] = map(score, part)
                at += len(part)
            stay = [i for i in range(batch.num_columns) if keep or i != at_text]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], pa.array(found, pa.float64())], [*[batch.schema.names[i] for i in stay], "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on labelled documents that are not held out; at most sample of each class."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    total = sum(counts.values())
    if not total or len(counts) < 2:
        return Model(np.zeros(BUCKETS), 0.0, float(counts.get(1, 0) > 0))
    # both samples are bounded, so they may be broadcast
    chosen = [marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.length("text") <= sample_chars)
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("y", "text")
    found = arrow_map(rows, _trainer(counts[1] / total), "weights binary, bias double, flat double").first()
    return Model(np.frombuffer(found.weights, np.float32).astype(np.float64), found.bias, found.flat)


def _trainer(prior: float):
    """A function for mapInArrow: all rows (y, text) of the sample to one row of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, size = [], [], [0, 0]
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size[y] += len(text)
                if size[y] <= SAMPLE_TOTAL or y not in marks:
                    texts.append(text)
                    marks.append(y)
        model = train(texts, marks, prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()]), pa.array([model.bias]), pa.array([model.flat], pa.float64())], ["weights", "bias", "flat"])

    return run


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of each document."""
    kind = docs.select(doc_id).dtypes[0][1]
    return arrow_map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), scorer(model), f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that score below threshold, whole."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)) + ", score double"
    found = arrow_map(rows, scorer(model, names.index(text), keep=True), schema).where(F.col("score") < threshold)
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])
