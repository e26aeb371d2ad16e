"""The inbox as a stream: new files are registered, normalised, cut into blocks and chunked, each batch exactly once.

A batch writes its documents and chunks under its own number, in folders that a retry replaces, and publishes them
together with one file that names both. Readers read what is published. A batch that dies between the writes leaves
folders that nobody names; run again, it decides by the batches before it alone, and so writes the same rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loreweave.functions import text as X
from loreweave.operators import chunks, ingest
from loreweave.sources import snapshots

TABLES = ("documents", "chunks")


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``source_path, text`` of text files as they come."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select(F.input_file_name().alias("source_path"), F.col("value").alias("text"))


def process(batch: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Registered rows of a batch that no known digest has, and the chunks of the normal form of those that are no
    duplicates. The digest is that of the file as it came."""
    rows = batch.withColumn("sha256", F.sha2("text", 256)).withColumn("document_id", F.abs(F.xxhash64("sha256", "source_path")))
    if known is not None:
        rows = rows.join(known.select("sha256").distinct(), "sha256", "left_anti")
    registered = ingest.register(rows).withColumn("text", X.normalized("text", edges=True))
    own = registered.where("status = 'PENDING'")
    return registered, chunks.chunk(chunks.blocks(own, "document_id", "text"))


def committed(spark: SparkSession, table_path: str, before: int | None = None) -> list[int]:
    """The batches that are published, or those of them before a batch."""
    names = snapshots.names_in(spark, f"{table_path}/batches")
    found = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
    return [n for n in found if before is None or n < before]


def table(spark: SparkSession, table_path: str, name: str, before: int | None = None) -> DataFrame | None:
    """A table of the published batches; None where there are none."""
    found = committed(spark, table_path, before)
    return spark.read.parquet(*[f"{table_path}/{name}/batch={n}" for n in found]) if found else None


def write_batch(batch: DataFrame, batch_id: int, table_path: str) -> None:
    """Work off one batch: both tables under its number, then the file that publishes them. One that is published
    already is left as it is."""
    spark = batch.sparkSession
    if batch_id in committed(spark, table_path):
        return
    registered, own = process(batch, table(spark, table_path, "documents", before=batch_id))
    registered.drop("text").write.mode("overwrite").parquet(f"{table_path}/documents/batch={batch_id}")
    own.write.mode("overwrite").parquet(f"{table_path}/chunks/batch={batch_id}")
    snapshots.publish(spark, f"{table_path}/batches/{batch_id:012d}.json", json.dumps({"tables": TABLES}))


def run(spark: SparkSession, folder: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Work off what is there into ``documents`` and ``chunks`` under ``table_path``; read them with ``table``."""
    stream = text_stream(spark, folder).writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, table_path))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
