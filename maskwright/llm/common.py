"""Shared helpers: tables, the cluster's shared folder, and cutting lineage by a written table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, as every contract of this subpackage has it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch of rows that goes to Python at once.
BATCH_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session, whose executors are this machine, may go without; it has a temporary folder until it ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of tables written so far by this process, in order.
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one of this application."""
    path = f"{shared_dir(spark)}/maskwright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def made() -> int:
    """A mark for clear(): how many scratch tables there are so far."""
    return len(_MADE)


def clear(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Delete the scratch tables made since a mark, but for the last where that is to be kept. What still reads them must be done."""
    for path in _MADE[since : len(_MADE) - keep_last]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _MADE.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what follows doesn't depend on df's lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches bounded by bytes, as texts have no bound that rows could stand for; a longer row is a batch of its own."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def row_key(*columns: str) -> Column:
    """A digest of the values of a row in these columns; nulls are values of their own. Rows of one key are interchangeable in them."""
    tagged = [F.coalesce(F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.md5(F.concat(*tagged))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)
