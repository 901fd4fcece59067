"""The contract queries opN_<name> and their SQL. Each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, lines, mixing, ngram, pii, quality, sentencepiece, toxicity, urls
from .base import table

#: Vocabulary of a public tokenizer.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: (entry, since, verdict) of a list that changed: what the tables do not hold. Hosts are the unwanted ones of `pages`.
REVISIONS = [
    ("casino-win.example.com", "2024-01-01 00:00:00", "block"), ("casino-win.example.com", "2024-01-11 00:00:00", None), ("casino-win.example.com", "2024-01-16 12:00:00", "block"),
    ("*.cheap-pills.example.com", "2024-01-01 00:00:00", "block"), ("cheap-pills.example.com/de/", "2024-01-08 00:00:00", "allow"),
    ("www.spam-farm.example.com", "2024-01-05 00:00:00", "block"), ("spam-farm.example.com", "2024-01-20 00:00:00", "block"),
    ("http://free-bets.example.com/en", "2024-01-10 00:00:00", "block"), ("ads-track.example.com", "2024-01-25 00:00:00", "block"),
]


#: pages have no time of capture; the page's number gives a second of the 30 days from FROM on.
FROM, DAYS, STEP = 1_704_067_200, 30, 104_729


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, at) with the time that the page's number gives."""
    at = F.timestamp_seconds(F.lit(FROM) + (F.col("page_id") * STEP) % (DAYS * 86_400))
    return pages.select("page_id", "url", at.alias("at"))


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = spark.createDataFrame(REVISIONS, "entry string, since string, verdict string").withColumn("since", F.to_timestamp(F.concat("since", F.lit("+00:00"))))
    rows = urls.judge(captures(table(spark, sf_dir, "pages")), revisions)
    blocked = F.coalesce(F.col("rule.verdict") == "block", F.lit(False))
    return rows.select("page_id", urls.host(F.col("url")).alias("host"), F.unix_seconds("at").alias("at"), F.col("rule.entry").alias("entry"), F.unix_seconds("rule.since").alias("since"), F.col("rule.verdict").alias("verdict"), (~blocked).alias("kept"))


_LISTED = ", ".join(f"('{e}', epoch(TIMESTAMP '{t}'), {repr(v) if v else 'NULL'})" for e, t, v in REVISIONS)
ORACLES["op1_url_filters"] = rf"""
WITH r AS (SELECT entry, CAST(since AS BIGINT) AS since, verdict, regexp_replace(regexp_replace(entry, '^[a-z]+://', ''), '^\*\.', '') AS bare FROM (VALUES {_LISTED}) v(entry, since, verdict)),
k AS (SELECT *, regexp_extract(bare, '^[^/]*') AS h, regexp_replace(regexp_extract(bare, '/.*'), '/$', '') AS p FROM r),
i AS (SELECT *, lead(since) OVER (PARTITION BY h, p ORDER BY since) AS until FROM k),
c AS (SELECT page_id, url, {FROM} + (page_id * {STEP}) % {DAYS * 86_400} AS at, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages),
d AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host, regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/$', '') AS path FROM c),
m AS (SELECT d.page_id, i.entry, i.since, i.verdict FROM d JOIN i ON (d.host = i.h OR d.host LIKE '%.' || i.h) AND (d.path = i.p OR starts_with(d.path, i.p || '/')) AND i.since <= d.at AND (i.until IS NULL OR d.at < i.until)
  WHERE i.verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d.page_id ORDER BY length(i.h) DESC, length(i.p) DESC) = 1)
SELECT d.page_id, d.host, d.at, m.entry, m.since, m.verdict, coalesce(m.verdict <> 'block', true) AS kept FROM d LEFT JOIN m USING (page_id)"""


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql("select -1L as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role from range(2)").withColumn("text", F.lit(ok))
    chats = chat.format_chats(turns.unionByName(extra))
    read = chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped(column: str) -> str:
    angle = f"regexp_replace({column}, '(<)(\\\\*(?:\\||/?s>|/?unk>|pad>|<SYS>>|</SYS>>))', '\\1\\\\\\2', 'g')"
    return f"regexp_replace({angle}, '(\\[)(\\\\*(?:/?INST\\]|/?SYSTEM_PROMPT\\]))', '\\1\\\\\\2', 'g')"


#: Per turn: its escaped text and either <|turn|> (8) or <|im_start|>, role, <|text|>, <|im_end|> and a line feed (12 + 8 + 11).
ORACLES["op3_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped('text')}) + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE 31 + length({_escaped('role')}) END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id"""


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, sf_dir, "documents"), digest_all=True)


ORACLES["op7_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT h, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -n, b := doc_id)) AS keep_id FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN k USING (h)"""


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents")).select("doc_id", "base", "spans")
    count = lambda column, k: F.size(F.filter(column, lambda s: s["rank"] == pii.KINDS.index(k))).cast("long")
    secrets = count("spans", "secret") + count("spans", "private_key")
    return found.select(
        "doc_id", *[count("base", k).alias(f"n_{k}") for k in pii.BASE], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
        secrets.alias("n_secret"), F.size("spans").cast("long").alias("n_spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.classes(table(spark, sf_dir, "documents"), k=3, percent=90)


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("m").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece.load(PIECES)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepiece.encode(docs, pieces, decoded=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.decide(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))
