"""Tables in and out, and intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch of rows that goes to a Python worker.
ARROW_BYTES = 1 << 22


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches that a session sends to Python, for good.

    Rows of long texts then come a few at a time, whatever the number of rows in a batch
    is set to. A smaller bound stays. Operators leave the session as it is; whoever opens it,
    such as the registered queries, calls this once.
    """
    said = spark.conf.get(_BATCH_BYTES, str(1 << 26))
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(said) <= ARROW_BYTES:
        spark.conf.set(_BATCH_BYTES, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only in local mode, as in tests,
    may it be unset; a folder of this process is set then.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINT_DIR} has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set(CHECKPOINT_DIR, found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder, once its results are read or stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts the lineage without localCheckpoint: a lost executor costs nothing that
    was written, and what follows is planned with the written table's true size.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """``materialize`` by the hash of ``key``, so that work on whole keys reads the table without a shuffle.

    It is an external table of the session's catalog, in the shared folder. ``df`` should be partitioned by the key.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = _table_name(path)
    df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def _table_name(path: str) -> str:
    return path.rpartition("/")[2].replace("-", "_")


def forget(df: DataFrame) -> None:
    """Deletes the folder of a written intermediate table that nothing is going to read again; no other files."""
    spark, own = df.sparkSession, urlparse(_own_dir(df.sparkSession)).path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if urlparse(folder).path.rpartition("/")[0] == own:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(folder)}")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a materialised table has at most ``max_rows`` rows (read from file footers)."""
    return df.agg(F.count(F.lit(1))).first()[0] <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows are within the bound, else unchanged."""
    return F.broadcast(df) if small_enough(df, max_rows) else df
