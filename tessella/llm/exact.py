"""Exact dedup by progressive refinement: length, then a hash of the first characters, then a hash of the whole text.

Texts are equal when they are identical after deleting ASCII white space. Only rows whose (length, prefix hash) occurs
more than once have their whole text hashed. Texts do not move: hashes are taken in the scan, and what is shuffled has one
narrow row a document. The keys that occur more than once are broadcast while they are few; beyond that
every text is hashed in the scan and the rows are told apart by a join of hashes. All counting is by partial aggregation,
so a key that holds a third of all rows is counted before it is shuffled.

Defined results: null text counts as empty; of equal texts the one with the most code points in the original stays, then
the smallest doc_id (null last); rows that repeat doc_id and length in one group are indistinguishable and marked alike,
and drop_exact_duplicates keeps one of them; doc_id may be of any type that has an order; a doc_id that stands for several
texts is that many documents; an empty table gives an empty result; other columns are ignored, or kept by
drop_exact_duplicates, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACES, few, scratch, settle, unused

PREFIX = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def refine(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One narrow row per document: doc_id, n_chars, content_key (sha256 of the normalised text; null where length or prefix already tell it apart).

    digest_all adds text_sha256 for the rows that the refinement did not need to hash as well.
    """
    with scratch():
        full = F.sha2("norm", 256)
        keyed = docs.select(F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), normalised(F.col(text)).alias("norm"))
        keyed = keyed.select("doc_id", "n_chars", F.length("norm").alias("norm_len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("head"), "norm")
        narrow = settle(keyed.drop("norm") if not digest_all else keyed.select("*", full.alias("text_sha256")).drop("norm"), "exact-narrow")
        lengths = settle(narrow.groupBy("norm_len").count().where("count > 1").select("norm_len"), "exact-lengths")
        heads = narrow.join(few(lengths), "norm_len", "left_semi").groupBy("norm_len", "head").count().where("count > 1")
        shared = settle(heads.select("norm_len", "head", F.lit(True).alias("shared")), "exact-heads")
        known = few(shared)
        if digest_all:
            rows = narrow
        elif known is not shared:
            rows = keyed.withColumn("text_sha256", F.lit(None).cast("string"))
        else:
            rows = keyed.withColumn("text_sha256", full).drop("norm")
        digest = F.col("text_sha256") if "norm" not in rows.columns else full
        found = rows.join(known, ["norm_len", "head"], "left").select("doc_id", "n_chars", F.when(F.col("shared"), digest).alias("content_key"), *(["text_sha256"] if digest_all else []))
        return settle(found, "exact-keys", keep=True)


def _groups(rows: DataFrame) -> DataFrame:
    """content_key, best_id, best_chars and n of each key of refined rows."""
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    groups = rows.where("content_key is not null").groupBy("content_key").agg(first.alias("best"), F.count(F.lit(1)).alias("n"))
    return groups.select("content_key", F.col("best.doc_id").alias("best_id"), (-F.col("best.n")).alias("best_chars"), "n")


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept (and text_sha256 with digest_all)."""
    rows = refine(docs, doc_id, text, digest_all)
    groups = settle(_groups(rows), "exact-groups")
    more = ["text_sha256"] if digest_all else []
    # rows that are alone have no key; in the join they would all meet in one task
    alone = rows.where("content_key is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *more)
    kept = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_chars") == F.col("best_chars"))
    found = rows.where("content_key is not null").join(few(groups), "content_key").select("doc_id", F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), *more)
    return found.unionByName(alone)


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, whole, with all their columns: one row of each group of equal texts."""
    key, best, chars = unused(docs, "key", "best", "chars")
    groups = _groups(refine(docs, doc_id, text)).where("n > 1").select(F.col("content_key").alias(key), F.col("best_id").alias(best), F.col("best_chars").alias(chars))
    rows = docs.withColumn(key, F.sha2(normalised(F.col(text)), 256)).join(groups, key, "left")
    first = F.col(doc_id).eqNullSafe(F.col(best)) & (F.length(F.coalesce(F.col(text), F.lit(""))) == F.col(chars))
    alone, of_group = rows.where(F.col(chars).isNull()), rows.where(first).dropDuplicates([key])
    return alone.unionByName(of_group).select(*[F.col(f"`{c}`") for c in docs.columns])
