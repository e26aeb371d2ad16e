"""The embedding projection: what has to be embedded, embedded rows that are checked, and a guarded write of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.sources.snapshots import Change, Committed, Keyed, SnapshotStore

#: Vectors of some texts; it may raise.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

COLUMNS = "kind string, stable_id string, content_hash string, provider string, model string, dimension int, projection_version string, generation long, status string, failure string, embedding array<double>"
NAMES = [c.split(" ")[0] for c in COLUMNS.split(", ")]


@dataclass(frozen=True)
class Contract:
    provider: str
    model: str
    dimension: int
    projection_version: str


def store(spark: SparkSession, path: str, buckets: int = 16) -> SnapshotStore:
    return SnapshotStore(spark, path, {"projections": Keyed("stable_id", ("kind", "stable_id"))}, version="embedding-v1", buckets=buckets)


def delta(authority: DataFrame, projections: DataFrame, contract: Contract) -> DataFrame:
    """``kind, stable_id, content_hash, action`` of every identity on either side.

    authority: ``kind, stable_id, content_hash`` of what is eligible; projections: the stored rows. MISSING, ORPHAN (no
    eligible text any more), CHANGED (another text), CONTRACT (another provider, model, dimension or version), FAILED
    (to be tried again) or CURRENT. One full outer join on the identity; no text is read.
    """
    mine = authority.select("kind", "stable_id", F.col("content_hash").alias("now"))
    stored = projections.select("kind", "stable_id", F.col("content_hash").alias("then"), *NAMES[3:7], "status")
    other = F.lit(False)
    for name in NAMES[3:7]:
        other = other | ~F.col(name).eqNullSafe(F.lit(getattr(contract, name)))
    action = (
        F.when(F.col("status").isNull(), "MISSING").when(F.col("now").isNull(), "ORPHAN").when(~F.col("now").eqNullSafe(F.col("then")), "CHANGED")
        .when(other, "CONTRACT").when(F.col("status") != "FRESH", "FAILED").otherwise("CURRENT")
    )
    return mine.join(stored, ["kind", "stable_id"], "full_outer").select("kind", "stable_id", F.col("now").alias("content_hash"), action.alias("action"))


def embedded(texts: DataFrame, embed: Embedder, contract: Contract, generation: int, batch: int = 64) -> DataFrame:
    """Rows of the projection for ``kind, stable_id, content_hash, content``.

    Texts go to the embedder in batches on the executors. A batch that fails is tried text by text, so that one bad
    text fails alone; a vector of another length or with a value that is not finite is a failure. A failed row keeps
    no vector.
    """

    def vectors(own: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            found = [list(map(float, v)) for v in embed(own)]
            if len(found) != len(own):
                raise ValueError("another number of vectors than of texts")
        except Exception as failure:  # noqa: BLE001 - whatever an embedder raises is a failed row, not a failed job
            return [(None, type(failure).__name__)] if len(own) == 1 else [v for text in own for v in vectors([text])]
        return [(v, None) if len(v) == contract.dimension and all(map(math.isfinite, v)) else (None, "INVALID_VECTOR") for v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                rows = whole.slice(at, batch)
                found = vectors(["" if t is None else t for t in rows.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:3], pa.array([v for v, _ in found], pa.list_(pa.float64())), pa.array([f for _, f in found], pa.string())],
                    ["kind", "stable_id", "content_hash", "embedding", "failure"],
                )

    out = texts.select("kind", "stable_id", "content_hash", "content").mapInArrow(run, "kind string, stable_id string, content_hash string, embedding array<double>, failure string")
    fixed = {"provider": F.lit(contract.provider), "model": F.lit(contract.model), "dimension": F.lit(contract.dimension).cast("int"), "projection_version": F.lit(contract.projection_version), "generation": F.lit(generation).cast("long")}
    fixed["status"] = F.when(F.col("failure").isNull(), "FRESH").otherwise("FAILED")
    return out.withColumns(fixed).select(*NAMES)


def write(kept: SnapshotStore, rows: DataFrame, orphans: DataFrame, authority: Callable[[], DataFrame], generation: int, tries: int = 5) -> Committed:
    """Store embedded rows under a generation's guard.

    A row is stored if its text is still the one that was embedded (``authority()`` is read again now) and no row of
    a later generation is there; an orphan goes unless it is eligible again or a later generation wrote it. Where
    another writer commits in between, all of this is decided anew against what is there then.
    """
    keys = ["kind", "stable_id"]
    for _ in range(tries):
        base = kept.snapshot()
        now = authority().select(*keys, F.col("content_hash").alias("now"))
        rows_now = rows.join(now, keys).where(F.col("content_hash").eqNullSafe(F.col("now"))).drop("now")
        gone = orphans.select(*keys).join(now, keys, "left_anti")
        if base is not None:
            later = kept.read(base, "projections").where(F.col("generation") > generation).select(*keys)
            rows_now, gone = rows_now.join(later, keys, "left_anti"), gone.join(later, keys, "left_anti")
        done = kept.commit({"projections": Change(rows_now, gone)}, base)
        if done.status != "SUPERSEDED":
            return done
    return done


def refresh(kept: SnapshotStore, authority: Callable[[], DataFrame], embed: Embedder, contract: Contract, generation: int) -> tuple[DataFrame, Committed]:
    """Bring the projection up to date: the plan of ``delta`` and what came of its write. Only texts that need it are
    read and embedded."""
    base = kept.snapshot()
    projections = kept.read(base, "projections") if base is not None else kept.spark.createDataFrame([], COLUMNS)
    plan = delta(authority(), projections, contract)
    wanted = plan.where(F.col("action").isin("MISSING", "CHANGED", "CONTRACT", "FAILED")).select("kind", "stable_id")
    texts = authority().join(wanted, ["kind", "stable_id"], "left_semi")
    return plan, write(kept, embedded(texts, embed, contract, generation), plan.where("action = 'ORPHAN'"), authority, generation)
