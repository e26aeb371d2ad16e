"""Projections over time: ledgers, health, fingerprints, job progress and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import text as X


def document_fingerprint(chunks: DataFrame, document: str = "document_id", order: str = "chunk_no", fields: tuple[str, ...] = ("chunk_id", "chunk_no", "page_no", "section", "heading_path", "normalized_content", "content_hash")) -> DataFrame:
    """``document_id, chunks, fingerprint``: the digest of a document's chunks in order, each field length-prefixed."""
    rows = chunks.select(F.col(document).alias("document_id"), F.struct(F.col(order).alias("o"), X.length_prefixed(*fields).alias("row")).alias("x"))
    own = rows.groupBy("document_id").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.count("*").alias("chunks"))  # the chunks of one document
    return own.select("document_id", "chunks", F.sha2(F.array_join(F.transform("xs", lambda x: x["row"]), ""), 256).alias("fingerprint"))


def index_health(authority: DataFrame, projection: DataFrame, key: str, fields: tuple[str, ...], failed: Column | None = None) -> DataFrame:
    """One row: indexed, missing, stale, orphan, failed and the status. One full outer join on the identity."""
    a = authority.select(F.col(key).alias("k"), F.struct(*fields).alias("canonical"))
    p = projection.select(F.col(key).alias("k"), F.struct(*fields).alias("indexed"))
    rows = a.join(p, "k", "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    both = F.col("canonical").isNotNull() & F.col("indexed").isNotNull()
    sums = rows.agg(
        count(F.col("indexed").isNotNull()).alias("indexed"),
        count(F.col("canonical").isNotNull() & F.col("indexed").isNull()).alias("missing"),
        count(both & ~F.col("canonical").eqNullSafe(F.col("indexed"))).alias("stale"),
        count(F.col("canonical").isNull()).alias("orphan"),
        (failed if failed is not None else F.lit(0).cast("long")).alias("failed"),
    )
    status = F.when(F.col("failed") > 0, "DEGRADED").when(F.col("missing") + F.col("stale") + F.col("orphan") > 0, "REBUILD_REQUIRED").otherwise("HEALTHY")
    return sums.withColumn("status", status)


def dangling(identities: DataFrame, projection: DataFrame, key: str) -> DataFrame:
    return identities.join(projection.select(key), key, "left_anti")


def job_progress(items: DataFrame, job: str, status: str, states: dict[str, Column]) -> DataFrame:
    """Per job: all items and those of each state."""
    return items.groupBy(job).agg(F.count("*").alias("total"), *[F.sum(c.cast("long")).alias(name) for name, c in states.items()])


def latest_generation(operations: DataFrame, keys: tuple[str, ...] = ("workspace_id", "corpus")) -> DataFrame:
    """The state a callback left last: a late one of an older generation changes nothing."""
    return operations.groupBy(*keys).agg(F.max("generation").alias("generation"), F.max_by("state", "generation").alias("state"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the changed rows in place of those of the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def embedding_fresh(contract: dict[str, object]) -> Column:
    """Whether a stored vector is that of the current text under the current contract."""
    out = F.col("projection_hash").eqNullSafe(F.col("content_hash"))
    for column, value in contract.items():
        out = out & F.col(column).eqNullSafe(F.lit(value))
    return out
