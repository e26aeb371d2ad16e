"""Digests of ordered rows: of whole tables as a tree over ranges, and of documents from the digests of their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions import text as X
from loreweave.sources.snapshots import Change, Committed, Keyed, Snapshot, SnapshotStore
from loreweave.sources.tables import stored

#: Rows of one leaf or inner node of the tree, and chunks of one leaf of a document.
LEAF, CHUNKS = 4096, 1024
SEPARATOR = "\x1e"


def _joined(order: str, value: str, by: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), by), 256)


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` and ``digest`` of a table of ``key`` and ``value``: the values in the order of their keys.

    The table is sorted by ranges; places are counted range by range, and each 4,096 places make a leaf, so that
    equal tables have equal leaves however they are dealt out. A leaf's digest is that of its values, a node's that
    of 4,096 digests below it; one of a single leaf is that leaf's. No task holds more than a leaf, and what reaches
    the driver is a number of rows per range.
    """
    rows = rows.select("key", "value").repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    places = stored(rows.select(F.monotonically_increasing_id().alias("at"), "value"), "ordered-values")
    sizes = {r["part"]: r["n"] for r in places.groupBy(F.expr("shiftright(at, 33)").alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(total)]
        total += sizes[part]
    if not total:
        return rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("rows"), F.sha2(F.lit(""), 256).alias("digest"))
    offset = F.element_at(F.create_map(*before), F.expr("shiftright(at, 33)"))
    level = places.select((offset.cast("long") + F.expr("at & 8589934591")).alias("place"), "value")
    nodes, separator = total, SEPARATOR
    while nodes > 1 or separator:
        level = level.groupBy(F.expr(f"place div {LEAF}").alias("node")).agg(_joined("place", "value", separator).alias("value")).select(F.col("node").alias("place"), "value")
        nodes, separator = -(-nodes // LEAF), ""
    return level.select(F.lit(total).cast("long").alias("rows"), F.col("value").alias("digest"))


def ordered_sql(source: str) -> str:
    """DuckDB SQL for ``ordered`` of a query with ``key`` and ``value``, for up to 4,096 leaves."""
    return f"""SELECT count(*) AS leaves, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, CASE WHEN count(*) = 1 THEN min(d) ELSE sha256(coalesce(string_agg(d, '' ORDER BY leaf), '')) END AS digest
FROM (SELECT place // {LEAF} AS leaf, count(*) AS n, sha256(string_agg(value, chr(30) ORDER BY place)) AS d FROM (SELECT value, row_number() OVER (ORDER BY key, value) - 1 AS place FROM ({source})) GROUP BY 1)"""


def chunk_digests(chunks: DataFrame, fields: tuple[str, ...] = ("chunk_no", "normalized_content", "content_hash")) -> DataFrame:
    """``document_id, chunk_id, chunk_no, digest``: of each chunk's fields, each with its length before it."""
    return chunks.select("document_id", "chunk_id", F.col("chunk_no").cast("long").alias("chunk_no"), X.sha256(X.length_prefixed(*fields)).alias("digest"))


def of_documents(digests: DataFrame) -> DataFrame:
    """``document_id, chunks, fingerprint`` from chunk digests alone, in the order of chunk numbers.

    Chunks are folded by 1,024 numbers, and these folds once more, so that a document of very many chunks is spread
    over tasks; what comes together for it is a digest for each 1,024 numbers.
    """
    leaf = digests.groupBy("document_id", F.expr(f"chunk_no div {CHUNKS}").alias("leaf")).agg(
        F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "digest"))), lambda x: x["digest"]), ""), 256).alias("d")
    )
    return leaf.groupBy("document_id").agg(F.sum("n").alias("chunks"), _joined("leaf", "d", "").alias("fingerprint"))


class DocumentDigests:
    """The chunk digests of an index, kept by document: a refresh computes those of changed documents, and a question
    about some documents reads their buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.store = SnapshotStore(spark, path, {"digests": Keyed("document_id", ("document_id", "chunk_id"))}, version="chunk-digests-v1", buckets=buckets)

    def refresh(self, chunks: DataFrame, documents: DataFrame | None = None) -> Committed:
        """Digest ``chunks``, which are all of their documents; documents without chunks any more are named by
        ``documents`` (``document_id``)."""
        own = chunk_digests(chunks)
        gone = own.select("document_id") if documents is None else own.select("document_id").unionByName(documents.select("document_id"))
        return self.store.commit({"digests": Change(own, gone.distinct())})

    def fingerprints(self, document_ids: list | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """``document_id, chunks, fingerprint`` of all documents, or of a bounded list of them."""
        snapshot = snapshot or self.store.snapshot()
        if snapshot is None:
            return self.store.spark.createDataFrame([], T.StructType().add("document_id", "string").add("chunks", "long").add("fingerprint", "string"))
        return of_documents(self.store.read(snapshot, "digests", keys=document_ids))
