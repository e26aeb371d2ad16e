"""Vector search: exact cosine neighbours under a contract, with authority and document scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.functions import vectors as V

OVER_FETCH, MOST_FETCHED = 5, 200


def nearest(projections: DataFrame, query: list[float], limit: int, kinds: tuple[str, ...] | None = None, offset: int = 0, digits: int = 6) -> DataFrame:
    """``stable_id, kind, distance, score`` of the nearest rows: by distance, kind and id as text.

    Columns: ``stable_id``, ``kind``, ``embedding``; rows of another length or with values that are not finite take
    no part. One scan and a top-k; the query is a literal.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = projections.where((F.size("embedding") == len(query)) & V.finite("embedding"))
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    distance = F.round(1 - V.cosine("embedding", q), digits)
    rows = rows.select("stable_id", "kind", distance.alias("distance")).where("distance is not null")
    rows = rows.orderBy("distance", "kind", F.col("stable_id").cast("string")).offset(offset).limit(limit)
    return rows.withColumn("score", V.similarity(F.col("distance")))


def in_documents(projections: DataFrame, chunks: DataFrame, document_ids: DataFrame) -> DataFrame:
    """Projections of the chunks of some documents: a semi join on the id as text."""
    scope = chunks.join(document_ids, "document_id", "left_semi").select(F.col("chunk_id").cast("string").alias("scope_id"))
    return projections.join(scope, F.col("stable_id").cast("string") == F.col("scope_id"), "left_semi")


def candidates(projections: DataFrame, authority: DataFrame, query: list[float], limit: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The nearest ``limit`` rows that canonical rows still back: one over-fetch, then a semi join, then the limit.

    The order is total, so this equals fetching page after page until enough are legal.
    """
    found = nearest(projections, query, min(MOST_FETCHED, OVER_FETCH * limit), kinds)
    legal = found.join(authority.select("stable_id"), "stable_id", "left_semi")
    return legal.orderBy("distance", "kind", F.col("stable_id").cast("string")).limit(limit)


def drift(readiness: DataFrame, contract: dict[str, object]) -> DataFrame:
    """``kind, generation, reason`` of the projections that a query vector of this contract may not be compared with: not
    READY, or built by another provider or model, of another dimension or version."""
    other = F.lit(False)
    for column, value in contract.items():
        other = other | ~F.col(column).eqNullSafe(F.lit(value))
    reason = F.when(~F.col("status").eqNullSafe(F.lit("READY")), F.concat(F.lit("NOT_READY/"), F.coalesce("status", F.lit("NOT_BUILT")))).when(other, "METADATA_DRIFT")
    return readiness.withColumn("reason", reason).where("reason is not null").select("kind", "generation", "reason")


def fresh(projections: DataFrame, contract: dict[str, object]) -> DataFrame:
    """Projections of the current provider, model, dimension, version and generation."""
    for column, value in contract.items():
        projections = projections.where(F.col(column).eqNullSafe(F.lit(value)))
    return projections
