"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as a character class body for Java and RE2 expressions.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

#: Documents are long rows: so many of them, and of their bytes (one row at least), go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1500, 1 << 22

_scratch: dict[int, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows_a_batch(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = id(spark.sparkContext)
        if key not in _scratch:
            folder = tempfile.TemporaryDirectory(prefix="domloom-")
            atexit.register(folder.cleanup)
            _scratch[key] = f"file://{folder.name}"
        base = _scratch[key]
    return f"{base.rstrip('/')}/domloom-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}"
    few_rows_a_batch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_rows_a_batch(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes where they are larger.

    Spark reads these settings when a plan runs, so they cannot travel with a DataFrame: they stay as set.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < _bytes(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def _bytes(value: str) -> int:
    """A number, or a size such as 256MB."""
    n = value.rstrip("bBkKmMgG")
    return int(n) << {"": 0, "k": 10, "m": 20, "g": 30}[value[len(n) :].lower().rstrip("b")]
