"""What the operators of this package share: scratch tables, row keys and the words of a text."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; long texts make it shorter.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_LOOK_SECONDS, _last_look = 5.0, [0.0]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session's ``spark.checkpoint.dir``; a folder of our own only where that is unset and
    all of Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loreweave-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    This cuts the lineage as a checkpoint does, compressed and by column, and a lost executor costs nothing
    that was written. Shuffle files behind the table are let go, as nothing needs them any more. The tables
    stay until the scratch folder is cleared, since results are read from them lazily.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/loreweave-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    schema = df.schema
    del df
    _let_go(spark)
    return spark.read.schema(schema).parquet(path)


def _let_go(spark: SparkSession) -> None:
    """Have the JVM look for shuffles that nothing holds any more, once in a while; small tables follow each other
    faster than that."""
    if time.monotonic() - _last_look[0] < _LOOK_SECONDS:
        return
    for _ in range(2):  # the first finds plans still held by listeners that were told of their end
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    _last_look[0] = time.monotonic()


def discard(table: DataFrame) -> None:
    """Delete a table of ``written`` that nothing will read again."""
    sc = table.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of texts small where the session has Spark's defaults of 10,000 rows and 64 MB."""
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; a null text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Each text; a null text is empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def table_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in batches if b.num_rows)


def text_digest(text: str = "text"):
    """A column that tells rows of one id with different texts apart."""
    return F.xxhash64(F.col(text))


def offsets_of(lengths: list[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(lengths, dtype=np.int64))))


def byte_characters() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]
