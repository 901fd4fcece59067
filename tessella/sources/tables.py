"""Readers: tables of a folder, text corpora, JSON lines that may be broken, manifests; and the writers' counterparts."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders never scanned, suffixes and their languages, folders of tests, suffixes of text.
SKIP = ["node_modules", "target", "dist", "build", ".git", ".venv", "venv", "__pycache__"]
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "rs": "rust"}
TEST_FOLDERS = ["tests", "test", "__tests__"]
TEXTS = ["py", "md", "rst", "cfg", "toml", "ini", "txt", "yml", "yaml", "json"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows a task gets where the work on each is heavy.
PER_TASK = 4000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to tasks of about PER_TASK: a narrow table is a file or two, which would be one task or two however many rows it has."""
    return rows.repartition(max(1, -(-rows.count() // PER_TASK)), *keys)


def files(spark: SparkSession, root: str) -> DataFrame:
    """path relative to root, and text, of every file below it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select(F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/')}\E/", "").alias("path"), F.col("content").cast("string").alias("text"))


def suffix(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def language(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix(path))


def is_test(path: Column) -> Column:
    """By a folder's name, or by the file name's pattern in its language."""
    parts, name = F.split(path, "/"), F.lower(F.substring_index(path, "/", -1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(TEST_FOLDERS))
    python = (suffix(path) == "py") & (name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py"))
    script = suffix(path).isin("js", "mjs", "cjs", "ts", "mts") & stem.rlike(r"^(test|tests|spec)$|[._-](test|spec)$|^(test|spec)-")
    return folder | python | script


def excluded(path: Column, entries: list[str]) -> Column:
    """A bare name anywhere, an exact path, or a folder and what is below."""
    names = [e.strip().strip("/") for e in entries if e.strip().strip("/")]
    test = lambda e: F.array_contains(F.split(path, "/"), e) | (path == e) | path.startswith(f"{e}/")
    out = F.lit(False)
    for e in names:
        out = out | test(e)
    return out


def project(tree: DataFrame, exclude: list[str] = []) -> DataFrame:  # noqa: B006
    """Source and test files of a scanned tree: path, text, lang, role; scripts compiled beside their source are left out."""
    rows = tree.where(~F.exists(F.split("path", "/"), lambda p: p.isin(SKIP)) & ~excluded(F.col("path"), exclude))
    rows = rows.withColumn("lang", language(F.col("path"))).where("lang is not null")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    typed = rows.where("lang = 'typescript'").select(stem.alias("stem"), F.lit("javascript").alias("lang")).distinct()
    rows = rows.withColumn("stem", stem).join(typed, ["stem", "lang"], "left_anti")
    return rows.select("path", "text", "lang", F.when(is_test(F.col("path")), "test").otherwise("source").alias("role"))


def texts(tree: DataFrame) -> DataFrame:
    """The text files of a scanned tree, without folders that are never scanned or begin with a dot."""
    shut = F.exists(F.split("path", "/"), lambda p: p.isin(SKIP) | p.startswith("."))
    return tree.where(suffix(F.col("path")).isin(TEXTS) & ~shut)


def main_language(tree: DataFrame) -> DataFrame:
    """One row: the language of a tree, by its manifest, else by most files (ties: name)."""
    rows = tree.where(~F.exists(F.split("path", "/"), lambda p: p.isin(SKIP)))
    n = rows.agg(*[F.count_if(language(F.col("path")) == v).alias(v) for v in dict.fromkeys(LANGUAGES.values())], *[F.bool_or(F.col("path") == f).alias(f.replace(".", "_")) for f in ("Cargo.toml", "package.json", "pyproject.toml", "setup.py")])
    script = F.col("javascript") + F.col("typescript") > 0
    most = F.greatest("python", "javascript", "typescript", "rust")
    by_count = F.coalesce(*[F.when(F.col(v) == most, v) for v in ("javascript", "python", "rust", "typescript")])
    known = F.when(F.col("Cargo_toml"), "rust").when(F.col("package_json") & script, F.when(F.col("typescript") > F.col("javascript"), "typescript").otherwise("javascript")).when(F.coalesce("pyproject_toml", F.lit(False)) | F.coalesce("setup_py", F.lit(False)), "python").otherwise(by_count)
    return n.select(F.when(F.coalesce(most, F.lit(0)) > 0, known).alias("lang"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; a line that does not parse stays in column raw."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("raw", T.StringType())])).option("columnNameOfCorruptRecord", "raw").json(path)


def manifest(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The tables of one key of a TOML file, a row each; a small file that the driver reads."""
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in tomllib.loads(Path(path).read_text())[key]], schema)


def write_split(rows: DataFrame, accepted: Column, path: str) -> None:
    """Accepted and rejected rows as JSON lines in two folders."""
    rows.withColumn("accepted", accepted).write.partitionBy("accepted").mode("overwrite").json(path)


def markdown(rows: DataFrame, order: str, limit: int = 1000) -> str:
    """A small report table; limit is the feature."""
    shown = rows.orderBy(order).limit(limit).collect()
    head = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    return "\n".join(head + [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in shown])


def report(rows: DataFrame, valid: Column, order: str, json_path: str) -> str:
    """Rows as JSON lines at json_path, read back and counted, and as a Markdown table under a line that says whether the run is complete."""
    rows.write.mode("overwrite").json(json_path)
    back = rows.sparkSession.read.schema(rows.schema).json(json_path)
    n = back.agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("ok")).first()
    if n["n"] != rows.count():
        raise ValueError(f"{json_path} holds {n['n']} rows, not those reported")
    whole = "Complete run." if n["ok"] == n["n"] else "INCOMPLETE: do not compare this aggregate with a complete-corpus result."
    return f"Coverage: {n['ok']}/{n['n']} projects passed. {whole}\n\n{markdown(back, order)}\n"
