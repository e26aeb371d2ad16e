"""The inbox as a source of files; published files are read by ``operators.published``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.operators import ingest

MAX_INPUT_BYTES = 50 << 20


def scan_inbox(spark: SparkSession, root: str) -> DataFrame:
    """``source_path, file_name, extension, file_size, created_at, sha256, content``: every regular file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    path = F.concat(F.lit(f"{base}/"), F.regexp_replace("path", rf"^.*?/{base}/", ""))
    name = ingest.safe_file_name("path")
    return files.where(F.col("length") <= MAX_INPUT_BYTES).select(
        path.alias("source_path"), name.alias("file_name"), ingest.extension(name).alias("extension"), F.col("length").alias("file_size"),
        F.col("modificationTime").alias("created_at"), F.sha2("content", 256).alias("sha256"), "content",
    )


def rescan(files: DataFrame, documents: DataFrame) -> DataFrame:
    """``source_path, outcome``: new, duplicate, existing or removed, from outer joins on the path and the digest. Of
    new files with one content the one of the least path is new, and the others are duplicates."""
    live = documents.where(~F.col("status").isin("DELETED", "SUPERSEDED"))
    known = live.select("source_path", F.col("sha256").alias("known_sha"))
    hashes = live.select(F.col("sha256").alias("live_sha")).distinct()
    rows = files.select("source_path", "sha256").join(known, "source_path", "full_outer").join(hashes, F.col("sha256") == F.col("live_sha"), "left")
    outcome = F.when(F.col("sha256").isNull(), "removed").when(F.col("sha256") == F.col("known_sha"), "existing").when(F.col("live_sha").isNotNull(), "duplicate").otherwise("new")
    rows = rows.select("source_path", "sha256", outcome.alias("outcome"))
    first = rows.where("outcome = 'new'").groupBy(F.col("sha256").alias("new_sha")).agg(F.min("source_path").alias("first_path"))
    rows = rows.join(first, F.col("sha256") == F.col("new_sha"), "left")
    later = (F.col("outcome") == "new") & (F.col("source_path") > F.col("first_path"))
    return rows.select("source_path", F.when(later, "duplicate").otherwise(F.col("outcome")).alias("outcome"))


def extracted(files: DataFrame) -> DataFrame:
    """Text of the formats Spark reads itself (text, markdown); others keep a null text for an extractor of the caller's
    choice behind ``mapInArrow``."""
    plain = F.col("extension").isin("txt", "md", "markdown")
    text = F.when(plain, F.decode("content", "UTF-8"))
    return files.withColumn("text", X.normalized(text, edges=True)).withColumn("parse_status", F.when(plain, "PROCESSED").when(ingest.supported("file_name"), "PENDING").otherwise("UNSUPPORTED"))
