"""Tables that an operator writes once and reads several times, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own on a single machine where that is unset, an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="loreweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def files_of(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Path, length and time of each file of a table: what tells whether it was written anew."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(found):
        return ()
    status = files.getFileStatus(found)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (files.listStatus(found) if status.isDirectory() else [status])))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends here, and a lost executor costs nothing of it."""
    path = f"{scratch_folder(df.sparkSession)}/loreweave-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256, size: int = 4 << 20) -> None:
    """Keep the Arrow batches of whole documents small where the session has Spark's defaults of 10,000 rows and 64 MB."""
    for key, default, value in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out (by keys, if given) for work that takes long for its bytes: by number, as Spark would else put
    what is small in bytes into few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
