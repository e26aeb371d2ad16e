"""Evidence: revalidation against canonical rows, budgets, handoff, context packing and citations."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions import text as X
from loreweave.operators.fusion import FusionPolicy

CHANNELS = ("LEXICAL", "VECTOR", "GRAPH")


def revalidated(candidates: DataFrame, authority: DataFrame, workspace: int) -> DataFrame:
    """Every candidate with ``rejection``: null if canonical rows still back it, else the first test that failed.

    Candidates: ``stable_id, workspace_id, content_hash, revision``; authority: ``stable_id, content_hash, revision,
    eligible``. The bounded candidates are the streamed side of one left join.
    """
    canonical = authority.select("stable_id", F.col("content_hash").alias("canonical_hash"), F.col("revision").alias("canonical_revision"), "eligible")
    rows = candidates.join(canonical, "stable_id", "left")
    reason = (
        F.when(F.col("workspace_id") != workspace, "WORKSPACE_MISMATCH")
        .when(F.col("stable_id").isNull() | X.is_blank(F.col("stable_id").cast("string")), "IDENTITY_MISMATCH")
        .when(F.col("canonical_hash").isNull(), "AUTHORITY_MISSING")
        .when(~F.coalesce("eligible", F.lit(False)), "INELIGIBLE")
        .when(~F.col("content_hash").eqNullSafe(F.col("canonical_hash")) | ~F.col("revision").eqNullSafe(F.col("canonical_revision")), "STALE_REVISION")
    )
    return rows.withColumn("rejection", reason)


def _before(order: Window) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, -1)


def budgeted(items: DataFrame, max_items: int = 8, max_characters: int = 12000, group: tuple[str, ...] = (), rank: str = "rank", content: str = "content") -> DataFrame:
    """Items in rank order within a number of items and characters; the last one is cut, and a blank one ends the list.

    Rows of one identity fold into the first. ``group`` keeps many bundles apart; a bundle is bounded by its
    candidate limit.
    """
    once = Window.partitionBy(*group, "stable_id").orderBy(rank)
    rows = items.withColumn("fold", F.row_number().over(once)).where("fold = 1").drop("fold")
    order = Window.partitionBy(*group).orderBy(rank)
    rows = rows.withColumn("ordinal", F.row_number().over(order))
    rows = rows.withColumn("used", F.coalesce(F.sum(F.length(content)).over(_before(order)), F.lit(0)))
    room = F.lit(max_characters) - F.col("used")
    cut = F.substring(F.col(content), F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
    rows = rows.withColumn("evidence", cut).withColumn("truncated", F.length(content) > room)
    blank = F.max(X.is_blank("evidence").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.where((F.col("used") < max_characters) & (F.col("ordinal") <= max_items)).withColumn("ended", blank).where("ended = 0").drop("ended")


def packed(items: DataFrame, max_items: int = 32, per_item: int = 4000, total: int = 16000, group: tuple[str, ...] = (), rank: str = "rank", content: str = "content") -> DataFrame:
    """Context blocks E1..En: each item cut to its own limit and to what is left of the whole."""
    once = Window.partitionBy(*group, "stable_id").orderBy(rank)
    rows = items.withColumn("fold", F.row_number().over(once)).where("fold = 1").drop("fold")
    order = Window.partitionBy(*group).orderBy(rank)
    size = F.least(F.length(content), F.lit(per_item))
    rows = rows.withColumn("ordinal", F.row_number().over(order)).withColumn("used", F.coalesce(F.sum(size).over(_before(order)), F.lit(0)))
    limit = F.least(F.lit(per_item), F.lit(total) - F.col("used"))
    rows = rows.where((F.col("used") < total) & (F.col("ordinal") <= max_items))
    rows = rows.withColumn("block", F.substring(F.col(content), F.lit(1), limit.cast("int"))).withColumn("truncated", F.length(content) > limit)
    blank = F.max(X.is_blank("block").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("ended", blank).where("ended = 0").drop("ended")
    return rows.withColumn("citation_id", F.concat(F.lit("E"), F.col("ordinal").cast("string")))


def handoff(evidence: DataFrame, authority: DataFrame) -> DataFrame:
    """Evidence that a newer snapshot still backs; what is dropped is not filled up again."""
    current = authority.where("eligible").select("stable_id", "content_hash")
    return evidence.join(current, ["stable_id", "content_hash"], "left_semi")


def usage(blocks: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    return blocks.groupBy(*group).agg(F.count("*").alias("blocks"), F.sum(F.length("block")).alias("characters"), F.max("truncated").alias("truncated"))


def citations(answers: DataFrame, known: DataFrame, group: tuple[str, ...], cited: str = "citation_ids", insufficient: str = "insufficient") -> DataFrame:
    """Answers with ``citation_status``: VALID, or MISSING, REPEATED, UNKNOWN."""
    ids = known.groupBy(*group).agg(F.collect_set("citation_id").alias("known_ids"))
    rows = answers.join(ids, list(group), "left").withColumn("known_ids", F.coalesce("known_ids", F.array().cast("array<string>")))
    status = (
        F.when(~F.col(insufficient) & (F.size(cited) == 0), "MISSING")
        .when(F.size(F.array_distinct(cited)) < F.size(cited), "REPEATED")
        .when(F.size(F.array_except(cited, "known_ids")) > 0, "UNKNOWN")
        .otherwise("VALID")
    )
    return rows.withColumn("citation_status", status).drop("known_ids")


def serialized(blocks: DataFrame, question: str) -> Column:
    """The context as one JSON text of version ANSWER_CONTEXT_V1, from an array of block structs ``blocks``."""

    @F.arrow_udf(T.StringType())
    def render(own: pa.Array) -> pa.Array:
        out = []
        for rows in own.to_pylist():
            body = {"version": "ANSWER_CONTEXT_V1", "question": question, "evidence": [{"id": r["citation_id"], "identity": str(r["stable_id"]), "content": r["block"]} for r in rows or []]}
            out.append(json.dumps(body, ensure_ascii=False, separators=(",", ":")))
        return pa.array(out, pa.string())

    return render(F.col("blocks"))


def _rejection(prefix: str) -> Column:
    """Why canonical rows, joined as ``prefix...`` columns, do not back a candidate."""
    return (
        F.when(F.col("workspace_id") != F.coalesce(F.col(f"{prefix}workspace"), F.col("workspace_id")), "WORKSPACE_MISMATCH")
        .when(F.col(f"{prefix}hash").isNull(), "AUTHORITY_MISSING")
        .when(~F.coalesce(F.col(f"{prefix}eligible"), F.lit(False)), "INELIGIBLE")
        .when(~F.col("content_hash").eqNullSafe(F.col(f"{prefix}hash")), "STALE_REVISION")
    )


def _authority(rows: DataFrame, prefix: str, *more: str) -> DataFrame:
    return rows.select("kind", "stable_id", F.col("workspace_id").alias(f"{prefix}workspace"), F.col("content_hash").alias(f"{prefix}hash"), F.col("eligible").alias(f"{prefix}eligible"), *more)


def fused_trace(candidates: DataFrame, authority: DataFrame, now: DataFrame, policy: FusionPolicy, max_items: int = 8, max_characters: int = 12000, group: tuple[str, ...] = (), graph_current: bool = True) -> DataFrame:
    """Every candidate of the channels LEXICAL, VECTOR and GRAPH with what became of it: a row per identity.

    candidates: ``channel, kind, stable_id, ordinal, workspace_id, content_hash``, in the order of their channel;
    authority: ``kind, stable_id, workspace_id, content_hash, eligible, content`` as the channels are read; now: the same
    without content, as the answer is given. ``group`` keeps the candidates of many queries apart.

    The columns: the places in the channels (``lexical``, ``vector``, ``graph``; rejected candidates have theirs), the
    ``rejections`` as CHANNEL:REASON, ``score`` and ``fused_rank`` of those that a channel kept, by weighted reciprocal
    ranks among the kept, ``modalities``, ``disposition`` (REJECTED, SELECTED, BUDGET_EXCLUDED, NOT_REACHED), the
    ``reason`` of a rejection and the ``evidence`` of what is selected. Selection goes down the fused order until the
    items or characters are used up; what is blank is excluded, the item that is cut ends it. Selected items that are
    no longer current at the end, or that only a graph that has moved on speaks for, are rejected and not replaced.
    """
    key = [*group, "kind", "stable_id"]
    own = candidates.groupBy(*group, "channel", "kind", F.col("stable_id").cast("string").alias("stable_id")).agg(F.min("ordinal").alias("first"), F.min_by(F.struct("workspace_id", "content_hash"), "ordinal").alias("c"))
    own = own.select(*group, "channel", "kind", "stable_id", "first", "c.*")
    by_channel = Window.partitionBy(*group, "channel")  # a channel is bounded by its candidate limit
    own = own.withColumn("ordinal", F.row_number().over(by_channel.orderBy("first")))
    authority, now = (rows.withColumn("stable_id", F.col("stable_id").cast("string")) for rows in (authority, now))
    if not group:  # the candidates of one query are few: what they ask for is taken out before any text is shuffled
        asked = F.broadcast(own.select("kind", "stable_id").distinct())
        authority, now = (rows.join(asked, ["kind", "stable_id"], "left_semi") for rows in (authority, now))
    then = _authority(authority, "a_", "content")
    own = own.join(then, ["kind", "stable_id"], "left").withColumn("rejection", _rejection("a_"))
    own = own.withColumn("rank", F.when(F.col("rejection").isNull(), F.row_number().over(Window.partitionBy(*group, "channel", F.col("rejection").isNull()).orderBy("ordinal"))))

    kept = F.col("rank").isNotNull()
    part = policy.weight(F.col("channel")) / (F.lit(policy.k) + F.col("rank"))
    merged = own.groupBy(*key).agg(
        *[F.max(F.when(F.col("channel") == c, F.col("ordinal"))).alias(c.lower()) for c in CHANNELS],
        F.array_join(F.array_sort(F.collect_list(F.when(~kept, F.concat("channel", F.lit(":"), "rejection")))), ",").alias("rejections"),
        F.round(F.sum(part), 12).alias("score"),
        F.array_sort(F.collect_set(F.when(kept, F.col("channel")))).alias("modalities"),
        F.max(F.when(kept, F.col("content"))).alias("content"), F.max(F.when(kept, F.col("content_hash"))).alias("content_hash"), F.max("workspace_id").alias("workspace_id"),
    )
    alive = F.col("score").isNotNull()
    place = F.row_number().over(Window.partitionBy(*group, F.col("score").isNotNull()).orderBy(F.desc("score"), "kind", "stable_id"))
    merged = merged.withColumn("fused_rank", F.when(alive, place))

    # what the budget decides needs the lengths alone, in fused order: a list as long as the channels are
    lead = F.length(F.regexp_extract("content", r"^\s*", 0))
    item = F.struct("fused_rank", F.length("content").alias("long"), lead.alias("lead"), "kind", "stable_id")
    lists = merged.where(alive).groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(False).alias("ended"), F.array().cast("array<struct<kind:string,stable_id:string,fate:string,room:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        room = F.lit(max_characters) - state["used"]
        full = (state["n"] >= max_items) | (room <= 0)
        blank = F.least(x["long"], room) <= x["lead"]
        fate = F.when(state["ended"], "NOT_REACHED").when(full | blank, "BUDGET_EXCLUDED").otherwise("SELECTED")
        taken = ~state["ended"] & ~full & ~blank
        return F.struct(
            F.when(taken, state["n"] + 1).otherwise(state["n"]).alias("n"),
            F.when(taken, state["used"] + F.least(x["long"], room)).otherwise(state["used"]).alias("used"),
            (state["ended"] | full | (taken & (x["long"] > room))).alias("ended"),
            F.concat(state["out"], F.array(F.struct(x["kind"].alias("kind"), x["stable_id"].alias("stable_id"), fate.alias("fate"), F.greatest(room, F.lit(0)).alias("room")))).alias("out"),
        )

    fates = lists.select(*group, F.explode(F.aggregate("items", begin, step, lambda state: state["out"])).alias("f")).select(*group, "f.*")
    rows = merged.join(fates, key, "left").join(_authority(now, "n_"), ["kind", "stable_id"], "left")
    selected = F.col("fate") == "SELECTED"
    graph_only = F.lit(not graph_current) & (F.array_join("modalities", ",") == "GRAPH")
    late = F.when(selected, F.when(graph_only, "PROJECTION_STALE").otherwise(_rejection("n_")))
    rows = rows.withColumn("reason", F.when(F.col("fate").isNull(), F.split_part(F.split_part("rejections", F.lit(","), F.lit(1)), F.lit(":"), F.lit(2))).otherwise(late))
    disposition = F.when(F.col("reason").isNotNull(), "REJECTED").otherwise(F.col("fate"))
    return rows.select(
        *key, "lexical", "vector", "graph", F.when(F.col("rejections") != "", F.col("rejections")).alias("rejections"), "score", "fused_rank", F.array_join("modalities", ",").alias("modalities"),
        disposition.alias("disposition"), "reason", F.when(disposition == "SELECTED", F.substring("content", F.lit(1), F.col("room"))).alias("evidence"),
    )


def outcomes(trace: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Per channel what it gave: candidates, rejected ones, selected items, and CONTRIBUTED, EMPTY or REJECTED."""
    rows = None
    for name in CHANNELS:
        own = trace.where(F.col(name.lower()).isNotNull())
        refused = F.coalesce(F.col("rejections").contains(f"{name}:"), F.lit(False))
        agg = own.groupBy(*group, F.lit(name).alias("channel")).agg(F.count("*").alias("candidates"), F.count_if(refused).alias("rejected"), F.count_if((F.col("disposition") == "SELECTED") & ~refused).alias("selected"))
        rows = agg if rows is None else rows.unionByName(agg)
    return rows.withColumn("outcome", F.when(F.col("candidates") > F.col("rejected"), "CONTRIBUTED").otherwise("REJECTED"))
