"""What the operators share: written intermediate tables and the word rule of the contracts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


_written: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables settled inside, but for those that were to be kept, when the block ends."""
    _written.append([])
    try:
        yield
    finally:
        for spark, path in _written.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts the lineage, survives lost executors.

    Tables of one application share a subfolder named after it, which may be removed when the application has ended; those
    written within scratch() go with its block, unless they are to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessella-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written[keep:]:
        _written[-2 if keep else -1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table may be broadcast.
FEW = 500_000


def few(rows: DataFrame) -> DataFrame:
    """rows, marked for broadcast where there are at most FEW of them."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"_{'_' * i}{name}" for i in range(len(taken) + 1)) if n not in taken) for name in names]


def words(text: Column) -> Column:
    """Array of the words of text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that a Python worker gets at a time; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def _trim() -> None:
    """Give memory that was freed back to the system, where the C library can: a worker that waits for its next task keeps little."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, so that a worker's memory stays small.

    Spark reads both limits when the plan runs, so they are set for the session; lower ones set by the user stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).rstrip("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            conf.set(key, most)

    def run(batches):
        yield from function(batches)
        _trim()

    return df.mapInArrow(run, schema)
