"""Where intermediate tables live: a folder of this application in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Parquet reader and an Arrow batch hold at most in registered queries. Arrow batches are
#: bounded by bytes as well, by Spark's own default.
READER_ROWS = 512
BATCH_ROWS = 2048
#: A key with over this part of all rows is a hot one; so there are fewer of them than that.
HOT_PART = 65536

_made: list[str] = []
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only where none is set, and the executors are in this
    process (tests), is it one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnbeck-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's folder there; it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/tarnbeck-{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_remove_at_exit, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except (Py4JError, OSError, AttributeError):
        pass  # the JVM has ended before


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the run's folder and read it again: this cuts the
    lineage, and a lost executor costs no more than the stage that was running."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined to side by a key, without the column count: side has one row for each key, and count
    says how many of rows have it, of total in all. The fewer than HOT_PART rows of side whose keys are
    hot are broadcast, so rows of a hot key stay where they are; all others are dealt by their key."""
    hot = F.col(count) * HOT_PART > total
    often = F.broadcast(side.filter(hot).drop(count).withColumn("_hot", F.lit(True)))
    tried = rows.join(often, key, "left")
    cold = tried.filter("_hot is null").select(*rows.columns).join(side.filter(~hot).drop(count), key)
    return tried.filter("_hot").drop("_hot").unionByName(cold)


def mark() -> int:
    """How many tables were stashed so far."""
    return len(_made)


def drop_since(spark: SparkSession, since: int, keep: Iterable[str] = ()) -> None:
    """Remove the tables stashed after a mark, but for those in keep: nothing reads them any more."""
    kept = set(keep)
    for path in [p for p in _made[since:] if p not in kept]:
        _made.remove(path)
        _remove(spark, path)


def newest() -> str:
    """Path of the table that was stashed last."""
    return _made[-1]


def bound_batches(spark: SparkSession) -> None:
    """For registered queries and the pipeline, which own their session: documents are long, and an
    executor holds several batches of each of its tasks, in the JVM and in Python. Operators never
    change a session, and are right whatever it says; results are lazy, so it can't be changed back."""
    for name, rows in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS),
    ):
        if not 0 < int(spark.conf.get(name)) <= rows:
            spark.conf.set(name, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a registered query."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
