"""The corpus pipeline: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever else
docs has beside doc_id, text, source and n_chars.

Defined results: null texts count as empty but stay null, and are never toxic, cut or near copies; they have size 0 in the
mix, and null ids in the last stage. Rows that repeat doc_id and text are one document from the near-copy stage on; rows
that share a doc_id but not a text are judged each; rows without doc_id are never cut or removed as copies of others, but
once per text. Empty tables pass through all stages. Texts are taken whole at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import lines, mixing, ngram, sentencepiece, toxicity
from tessella.llm.base import settle, table
from tessella.llm.queries import PIECES


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op2_toxicity would not call toxic; the model learns from the labelled rows among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, threshold=0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier one; those of which nothing is left go."""
    return lines.dedup(docs, drop_empty=True).withColumn("n_chars", F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram.keep_one(docs, k=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each text."""
    rows = sentencepiece.encode(docs.select("doc_id", "source", "text"), sentencepiece.load(PIECES))
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("n-gram Jaccard", near_stage), ("mixing", mix_stage), ("SentencePiece", encode_stage)]
ORACLE_SQL = None  # training, hashed draws and the tokenizer have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, f"stage-{i}")
    return docs
