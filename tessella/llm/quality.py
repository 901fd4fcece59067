"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how far to trust each.

Every rule says good (1), bad (-1) or nothing (0). For each rule and class of document the model holds how often the rule
casts each vote, given the class, independently of the other rules. These rates, and the share of good documents, are
estimated by expectation-maximisation over the counts of vote patterns, which are counted over all documents (at most
3 ** len(rules()) patterns reach the driver). A rule's accuracy is what its rates imply: how far a vote moves the odds.
Rates start from, and are drawn towards, PRIOR, and no vote may count against what it says; so the classes cannot swap.
The posterior probability of good replaces an all-must-pass filter.

Defined results: null and empty texts have no words and all counts 0, and fail the base; repeated rows are counted and
judged each; an empty table gives an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, settle
from .lanes import chunks

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_digits", "n_distinct"]
_SYMBOL, _LETTER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
# letters of ASCII, and lead bytes but those of Latin signs (C2), punctuation and drawing (E2) and emoji (F0 on)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xE2] = _LETTER[0xE3:0xF0] = True
_DIGIT[48:58] = True
#: Rates of the votes -1, 0, 1 of bad and of good documents; drawn towards them by as much as PULL of all documents would.
PRIOR, PULL = np.array([[0.3, 0.2, 0.5], [0.03, 0.17, 0.8]]), 0.02
SHARE, ROUNDS = (0.05, 0.95), 100


def _within(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Size of each entry's group of equal (doc, key)."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    size = np.empty(len(d), np.int64)
    size[order] = np.repeat(np.diff(np.append(first, len(d))), np.diff(np.append(first, len(d))))
    return size


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros((len(COUNTS), batch.num_rows), np.int64)
        for begin, w in chunks(batch.column(1), lower=False):
            n, data = len(w.count), w.data
            m = {"n_words": w.count, "word_chars": w.total(w.filled & ((data & 0xC0) != 0x80)), "n_symbols": w.total(_SYMBOL[data]), "n_letters": w.total(_LETTER[data]), "n_digits": w.total(_DIGIT[data])}
            breaks = np.flatnonzero(data == 10)
            starts = np.sort(np.concatenate([w.offsets[:-1], breaks + 1]))
            ends = np.sort(np.concatenate([w.offsets[1:], breaks]))
            full = np.searchsorted(w.start, starts) < np.searchsorted(w.start, ends)
            starts, ends = starts[full], ends[full]
            line_doc = np.searchsorted(w.offsets, starts, "right") - 1
            size = _within(line_doc, w.spans(starts, ends))
            lines = np.bincount(line_doc, minlength=n)
            m["n_lines"] = lines
            m["n_dup_lines"] = lines - np.round(np.bincount(line_doc, 1 / size, minlength=n)).astype(np.int64)
            m["n_distinct"] = np.round(np.bincount(w.doc, 1 / _within(w.doc, w.hash), minlength=n)).astype(np.int64)
            key, at = w.windows(5)
            hit = np.zeros(len(w.hash) + 5, bool)
            at = at[_within(w.doc[at], key) > 1]
            for j in range(5):
                hit[at + j] = True
            m["n_repeat_words"] = np.bincount(w.doc[hit[: len(w.hash)]], minlength=n)
            for i, k in enumerate(COUNTS):
                out[i, begin : begin + n] = m[k]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in out]], ["doc_id", *COUNTS])


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of each text."""
    kind = docs.select(doc_id).dtypes[0][1]
    return arrow_map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), _measure, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in COUNTS))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the counts."""
    n, c = F.greatest("n_words", F.lit(1)), F.col
    chars, lines = F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "length": _vote(c("n_words") < 15, c("n_words") >= 40),
        "word_length": _vote(~(c("word_chars") / n).between(2.5, 12), (c("word_chars") / n).between(3, 9)),
        "symbols": _vote(c("n_symbols") / n > 0.3, c("n_symbols") / n < 0.1),
        "lines": _vote((c("n_dup_lines") >= 3) & (c("n_dup_lines") / lines > 0.3), (c("n_dup_lines") / lines < 0.1) & (c("n_lines") >= 3)),
        "repeats": _vote(c("n_repeat_words") / n > 0.2, c("n_repeat_words") / n < 0.05),
        "symbol_chars": _vote(c("n_symbols") / chars > 0.1, c("n_symbols") / chars < 0.03),
        "letters": _vote(c("n_letters") / chars < 0.7, c("n_letters") / chars > 0.85),
        "digits": _vote(c("n_digits") / chars > 0.2, c("n_digits") / chars < 0.05),
        "variety": F.when(c("n_words") < 50, 0).otherwise(_vote(c("n_distinct") / n < 0.1, c("n_distinct") / n > 0.25)),
    }


def estimate(votes: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-odds of good before any vote, and what each rule's votes -1, 0, 1 add, from vote patterns and how many documents show each."""
    rules_, share = votes.shape[1], 0.8
    rates = np.repeat(PRIOR[None], rules_, 0)
    onehot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    for _ in range(ROUNDS):
        gain = np.log(rates[:, 1] / rates[:, 0])
        gain[:, 0], gain[:, 2] = np.minimum(gain[:, 0], 0), np.maximum(gain[:, 2], 0)
        gain[:, 1] = 0  # abstaining says nothing
        base = math.log(share / (1 - share))
        if not len(votes):
            return base, gain
        good = 1 / (1 + np.exp(-(base + (onehot * gain).sum((1, 2)))))
        pull = PULL * counts.sum() + 1
        new = np.stack([np.einsum("p,pkv->kv", counts * y, onehot) + pull * PRIOR[i] for i, y in enumerate((1 - good, good))], 1)
        new /= new.sum(2, keepdims=True)
        share_new = float(np.clip((counts * good).sum() / counts.sum(), *SHARE))
        if abs(share - share_new) + np.abs(new - rates).max() < 1e-9:
            break
        share, rates = share_new, new
    return base, gain


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, counts, base_failed, posterior (probability of good), kept."""
    named = rules()
    rows = settle(measure(docs, doc_id, text).withColumns({f"v_{k}": v for k, v in named.items()}), "quality-votes")
    seen = rows.groupBy(*[f"v_{k}" for k in named]).count().collect()
    base, gain = estimate(np.array([r[:-1] for r in seen], float).reshape(len(seen), len(named)), np.array([r[-1] for r in seen], float))
    odds = F.lit(base)
    for k, g in zip(named, gain, strict=True):
        odds = odds + F.when(F.col(f"v_{k}") == 1, float(g[2])).when(F.col(f"v_{k}") == -1, float(g[0])).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-odds))})
    return rows.select("doc_id", *COUNTS, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"))
