"""Rank fusion and second-stage ranking, under versioned policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions import text as X


@dataclass(frozen=True)
class FusionPolicy:
    version: str
    k: int = 60
    lexical: float = 1.0
    vector: float = 1.0
    graph: float = 1.0

    def __post_init__(self) -> None:
        if not 1 <= self.k <= 200 or not all(0.25 <= w <= 2 for w in (self.lexical, self.vector, self.graph)):
            raise ValueError("fusion policy out of bounds")

    def weight(self, channel: Column) -> Column:
        return F.when(channel == "LEXICAL", self.lexical).when(channel == "VECTOR", self.vector).when(channel == "GRAPH", self.graph)


FUSION = {p.version: p for p in (FusionPolicy("fusion-rrf-v1"), FusionPolicy("fusion-rrf-v2-graph-damped", graph=0.75))}


def channel(rows: DataFrame, name: str) -> DataFrame:
    """``channel, kind, stable_id, rank`` of scored candidates: the best of an identity, then by score, kind and id."""
    key = F.col("stable_id").cast("string")
    best = rows.groupBy("kind", key.alias("stable_id")).agg(F.max("score").alias("score"))
    order = Window.orderBy(F.desc("score"), "kind", "stable_id")  # a channel is bounded by the candidate limit
    return best.select(F.lit(name).alias("channel"), "kind", "stable_id", F.row_number().over(order).alias("rank"))


def listed(rows: DataFrame, name: str, order: str = "ord") -> DataFrame:
    """A channel in list order; the first occurrence of an identity counts."""
    first = rows.groupBy("kind", F.col("stable_id").cast("string").alias("stable_id")).agg(F.min(order).alias("ord"))
    return first.select(F.lit(name).alias("channel"), "kind", "stable_id", F.row_number().over(Window.orderBy("ord")).alias("rank"))


def fuse(channels: list[DataFrame], limit: int | None = None, policy: FusionPolicy | None = None, digits: int = 12) -> DataFrame:
    """``kind, stable_id, score, signals``: reciprocal ranks summed over channels, weighted by the policy if there is one."""
    rows = channels[0]
    for c in channels[1:]:
        rows = rows.unionByName(c)
    weight = policy.weight(F.col("channel")) if policy else F.lit(1.0)
    score = F.sum(weight / (F.lit(policy.k if policy else 60) + F.col("rank")))
    out = rows.groupBy("kind", "stable_id").agg(F.round(score, digits).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("signals"))
    out = out.orderBy(F.desc("score"), "kind", "stable_id")
    return out.limit(limit) if limit is not None else out


def exact_anchor_scores(items: DataFrame, query: str, title: str = "title", content: str = "content", provenance: str | None = None) -> DataFrame:
    """``items`` with ``rerank_score``: technical words 4 each, query words in the title 2 each, shares of ideograph
    pairs 1.5 and of words 1."""
    q = items.sparkSession.range(1).select(X.rerank_tokens(F.lit(query)).alias("t"), X.rerank_bigrams(F.lit(query)).alias("b"), F.array_distinct(F.transform(F.regexp_extract_all(F.lit(query), F.lit(X.RERANK_ANCHOR), F.lit(1)), F.lower)).alias("a")).first()
    words, pairs, technical = (F.array(*[F.lit(x) for x in q[c]]).cast("array<string>") for c in ("t", "b", "a"))
    hay = F.concat_ws(" ", title, F.lit(""), content, *([provenance] if provenance else []))
    own, own_pairs = X.rerank_tokens(hay), X.rerank_bigrams(hay)
    hits = lambda a, b: F.size(F.array_intersect(a, b))
    named = F.when(F.trim(F.coalesce(title, F.lit(""))) != "", hits(words, X.rerank_tokens(title))).otherwise(0)
    score = 4.0 * hits(technical, own) + 2.0 * named + 1.5 * hits(pairs, own_pairs) / max(1, len(q["b"])) + 1.0 * hits(words, own) / max(1, len(q["t"]))
    return items.withColumn("rerank_score", F.round(score, 9))


def rerank(items: DataFrame, query: str, policy: str = "rerank-policy-v1-exact-anchor", rank: str = "rank") -> DataFrame:
    """Items with ``reranked``, their new place; of equal scores the old order holds. A bundle is bounded, so its order
    is one window. With fewer than two items, or for the policy ``none``, the old order stays."""
    order = Window.orderBy(rank)
    if policy == "none" or len(items.limit(2).take(2)) < 2:
        return items.withColumn("rerank_score", F.lit(0.0)).withColumn("reranked", F.row_number().over(order))
    if policy != "rerank-policy-v1-exact-anchor":
        raise ValueError(f"unknown rerank policy {policy}")
    scored = exact_anchor_scores(items, query)
    return scored.withColumn("reranked", F.row_number().over(Window.orderBy(F.desc("rerank_score"), rank)))


def quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: recall, precision and reciprocal rank at k. ``ranked``: query_id, stable_id, rank; ``relevant``: query_id, stable_id."""
    top = ranked.where(F.col("rank") <= k)
    hits = top.join(relevant, ["query_id", "stable_id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    out = relevant.groupBy("query_id").agg(F.count("*").alias("relevant")).join(hits, "query_id", "left")
    n = F.coalesce("hits", F.lit(0))
    return out.select("query_id", (n / F.col("relevant")).alias("recall"), (n / F.lit(k)).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))
