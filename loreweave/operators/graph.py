"""The knowledge graph: vertices, typed edges, validation, seeds, bounded traversal and admission."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.operators import digests
from loreweave.sources.snapshots import Keyed, Snapshot, SnapshotStore
from loreweave.sources.tables import stored

# Which relations may lead to evidence.
ADMITTED_RELATIONS = ("CONTAINS", "LINKS_TO", "TAGGED_WITH", "DERIVED_FROM")
_VERSION = "graph-identity-v1"


def entity_id(workspace: int, entity_type: str, key: str):
    return X.stable_id("ge1_", F.lit(_VERSION), F.lit("entity"), F.lit(str(workspace)), F.lit(entity_type), F.col(key).cast("string"))


def relation_id(workspace: int, source: str, relation_type: str, target: str):
    return X.stable_id("gr1_", F.lit(_VERSION), F.lit("relation"), F.lit(str(workspace)), F.col(source), F.lit(relation_type), F.col(target))


def vertices(workspace: int, **tables: tuple[DataFrame, str]) -> DataFrame:
    """``entity_id, entity_type, key`` of every row of the tables, given as TYPE=(table, key column)."""
    out = None
    for kind, (table, key) in tables.items():
        own = table.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct()  # keys are shorter than ids
        own = own.select(entity_id(workspace, kind, "key").alias("entity_id"), F.lit(kind).alias("entity_type"), "key")
        out = own if out is None else out.unionByName(own)
    return out


def edges(workspace: int, relation: str, pairs: DataFrame, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
    """``relation_id, relation_type, source_id, target_id`` of key pairs; source and target are (TYPE, column)."""
    rows = pairs.where(F.col(source[1]).isNotNull() & F.col(target[1]).isNotNull())
    rows = rows.select(F.col(source[1]).cast("string").alias("s"), F.col(target[1]).cast("string").alias("t")).distinct()  # keys are shorter than ids
    rows = rows.select(entity_id(workspace, source[0], "s").alias("source_id"), entity_id(workspace, target[0], "t").alias("target_id"))
    return rows.select(relation_id(workspace, "source_id", relation, "target_id").alias("relation_id"), F.lit(relation).alias("relation_type"), "source_id", "target_id")


def links_to(pages: DataFrame, page_id: str, title: str, targets: str) -> DataFrame:
    """Page pairs by link target; titles that two pages share link nowhere. Self links are kept out."""
    named = pages.groupBy(X.title_key(title).alias("target")).agg(F.min(page_id).alias("target_page"), F.count("*").alias("n")).where("n = 1")
    asked = pages.select(F.col(page_id).alias("source_page"), F.explode(targets).alias("target")).distinct()
    return asked.join(named, "target").where("source_page <> target_page").select("source_page", "target_page").distinct()


def _digest(c: str):
    """What stands for an id where ids are only compared: 128 bits, a quarter of its length."""
    return F.unhex(F.md5(F.col(c)))


def _repeated(rows: DataFrame, id_: str) -> DataFrame:
    """The ids of several rows, once: found by their digests, and then looked at themselves."""
    own = rows.select(id_, F.coalesce(_digest(id_), F.lit(b"")).alias("digest"))
    twice = stored(own.groupBy("digest").count().where("count > 1").select("digest"), "repeated")
    if twice.isEmpty():
        return rows.select(id_).where("false")
    return own.join(twice, "digest", "left_semi").groupBy(id_).count().where("count > 1").select(id_)


def defects(vertices_: DataFrame, edges_: DataFrame) -> DataFrame:
    """``defect, id``: repeated identities, and relations whose end is no vertex."""
    out = _repeated(vertices_, "entity_id").select(F.lit("DUPLICATE_ENTITY").alias("defect"), F.col("entity_id").alias("id"))
    out = out.unionByName(_repeated(edges_, "relation_id").select(F.lit("DUPLICATE_RELATION").alias("defect"), F.col("relation_id").alias("id")))
    there = vertices_.select(_digest("entity_id").alias("end"))
    for end in ("source_id", "target_id"):
        loose = edges_.select("relation_id", _digest(end).alias("end")).join(there, "end", "left_anti")
        out = out.unionByName(loose.select(F.lit("ORPHAN_RELATION").alias("defect"), F.col("relation_id").alias("id")))
    return out.distinct()


def fingerprint(edges_: DataFrame, *columns: str) -> DataFrame:
    """One digest of the relations in the order of their ids, as a tree over ranges of them."""
    row = X.sha256(X.length_prefixed(*columns))
    return digests.ordered(edges_.select(F.col(columns[0]).alias("key"), row.alias("value"))).select(F.col("digest").alias("fingerprint"))


def store(spark: SparkSession, path: str, buckets: int = 16) -> SnapshotStore:
    """Vertices and the adjacency lists of sources, under generations."""
    tables = {"vertices": Keyed("entity_id", ("entity_id",)), "adjacency": Keyed("source_id", ("source_id", "relation_id"))}
    return SnapshotStore(spark, path, tables, version=_VERSION, buckets=buckets)


def seeds(fused: DataFrame, limit: int = 16) -> DataFrame:
    """The best fused identities, in the order of their ids."""
    best = fused.orderBy(F.desc("score"), "kind", "stable_id").limit(limit)
    return best.select("stable_id").orderBy("stable_id")


@dataclass(frozen=True)
class Bounds:
    depth: int = 2
    per_node: int = 8
    per_hop: int = 16
    nodes: int = 32
    edges: int = 32
    candidates: int = 16


@dataclass
class Traversal:
    candidates: list[tuple[str, str, int, list[str]]] = field(default_factory=list)  # seed, entity, depth, relation ids
    visited_nodes: int = 0
    visited_edges: int = 0
    limits: set[str] = field(default_factory=set)


#: A table of edges, or the edges of the sources that it is asked for.
Edges = DataFrame | Callable[[list[str]], DataFrame]


def _frontier_edges(edges_: Edges, frontier: pd.DataFrame, relation_types: tuple[str, ...], per_node: int) -> pd.DataFrame:
    """The outgoing edges of the frontier in the order of visits, ``per_node + 1`` a node at most: by the place of the
    node in the frontier, then by type, target and id."""
    ids = list(frontier["source_id"])
    own = edges_(ids) if callable(edges_) else edges_.where(F.col("source_id").isin(*ids))  # reaches the scan of stored edges
    nodes = own.sparkSession.createDataFrame(frontier[["place", "source_id"]])
    turn = F.row_number().over(Window.partitionBy("place").orderBy("relation_type", "target_id", "relation_id"))
    own = own.where(F.col("relation_type").isin(*relation_types))
    own = own.join(F.broadcast(nodes), "source_id")  # at most ``Bounds.nodes`` rows
    return own.withColumn("turn", turn).where(F.col("turn") <= per_node + 1).select("place", "turn", "relation_id", "target_id").orderBy("place", "turn").toPandas()


def traverse(edges_: Edges, seeds_: list[str], relation_types: tuple[str, ...] = ADMITTED_RELATIONS, bounds: Bounds = Bounds()) -> Traversal:
    """Breadth-first over outgoing edges within budgets that depend on the order of visits.

    One window a hop puts the frontier's edges in order; each budget is then a position in that order, and the hop
    ends at the smallest: where the hop's or the traversal's edges run out, or at the first new node for which
    there is no room. At most ``depth`` small reads, of at most ``nodes * (per_node + 1)`` rows.
    """
    if len(set(seeds_)) != len(seeds_):
        raise ValueError("repeated seed")
    if len(seeds_) > bounds.nodes:
        raise ValueError("more seeds than nodes may be visited")
    out, visited = Traversal(), set(seeds_)
    frontier = pd.DataFrame({"source_id": sorted(seeds_), "seed": sorted(seeds_), "path": [[] for _ in seeds_]})
    for depth in range(1, bounds.depth + 1):
        edges_left = bounds.edges - out.visited_edges
        if frontier.empty or not edges_left:
            out.limits |= {"VISITED_EDGES"} if len(frontier) else set()
            break
        frontier = frontier.reset_index(drop=True).rename_axis("place").reset_index()
        rows = _frontier_edges(edges_, frontier, relation_types, bounds.per_node)
        rows["position"] = (rows["turn"] <= bounds.per_node).cumsum()  # from 1; an edge too many of a node has that of the edge before
        taken = rows[rows["turn"] <= bounds.per_node]
        read = min(bounds.per_hop, edges_left)  # where the edge budgets end

        fresh = taken[~taken["target_id"].isin(visited)].drop_duplicates("target_id")
        room = {"VISITED_NODES": bounds.nodes - len(visited), "CANDIDATES": bounds.candidates - len(out.candidates)}
        tightest = min(room, key=room.get)
        refused = fresh["position"].iloc[room[tightest]] if len(fresh) > room[tightest] else read + 1
        full = refused <= read
        out.limits |= {tightest} if full else set()
        out.visited_edges += int(min(refused, read, len(taken)))

        begins = taken.groupby("place")["position"].min()
        begun = set(begins.index[begins <= min(refused, read)])
        over = rows[(rows["turn"] > bounds.per_node) & rows["place"].isin(begun)]
        out.limits |= {"PER_NODE_FAN_OUT"} if (over["position"] <= read).any() else set()
        out.limits |= _edge_limits(rows, frontier, read, bounds.per_hop, edges_left, begun, full)

        found = fresh[fresh["position"] < min(refused, read + 1)].merge(frontier, on="place")
        found["path"] = [[*p, r] for p, r in zip(found["path"], found["relation_id"], strict=True)]
        visited |= set(found["target_id"])
        out.candidates += [(r.seed, r.target_id, depth, r.path) for r in found.itertuples()]
        if depth == bounds.depth and len(found):
            out.limits.add("DEPTH")
        if full or "VISITED_EDGES" in out.limits:
            break
        frontier = found[["target_id", "seed", "path"]].rename(columns={"target_id": "source_id"})
    out.visited_nodes = len(visited)
    out.candidates.sort(key=lambda c: (c[2], c[0], c[1], c[3]))
    return out


def _edge_limits(rows: pd.DataFrame, frontier: pd.DataFrame, read: int, per_hop: int, edges_left: int, begun: set[int], full: bool) -> set[str]:
    """Which edge budget left something of the frontier unread. Where both end at one place and the node there is
    read to its end, the hop's is named, and the traversal's by the next hop."""
    last = rows[(rows["position"] == read) & rows["place"].isin(begun)]
    if last.empty:
        return set()
    place = last["place"].iloc[0]
    more_of_node = int((rows["place"] == place).sum()) > int(((rows["place"] == place) & (rows["position"] <= read)).sum()) or len(last) > 1
    if not more_of_node and (full or place == len(frontier) - 1):
        return set()
    return {name for name, ends in (("PER_HOP_FAN_OUT", per_hop == read), ("VISITED_EDGES", edges_left == read and (more_of_node or per_hop != read))) if ends}


def reachable(edges_: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``entity_id, depth``: what is reached without budgets; nodes are seen once.

    Each hop is one join of the frontier with the edges, and is stored, so that no hop computes an earlier one again.
    Give stored edges.
    """
    links = edges_.select(F.col("source_id").alias("entity_id"), "target_id")
    hops = [stored(starts.select("entity_id").distinct().withColumn("depth", F.lit(0)), "hop")]
    for hop in range(1, depth + 1):
        found = hops[-1].join(links, "entity_id").select(F.col("target_id").alias("entity_id")).distinct()
        for earlier in hops:
            found = found.join(earlier.select("entity_id"), "entity_id", "left_anti")
        hops.append(stored(found.withColumn("depth", F.lit(hop)), "hop"))
    return reduce(DataFrame.unionByName, hops)


def traverse_pinned(kept: SnapshotStore, snapshot: Snapshot, seeds_: list[str], relation_types: tuple[str, ...] = ADMITTED_RELATIONS, bounds: Bounds = Bounds()) -> Traversal:
    """``traverse`` over one generation: each hop reads the buckets of its frontier from that generation's folders, and
    the generation is the current one before and after, or StaleSnapshot is raised."""
    kept.prove(snapshot)
    found = traverse(lambda ids: kept.read(snapshot, "adjacency", keys=ids), seeds_, relation_types, bounds)
    kept.prove(snapshot)
    return found


# What a failure of the graph channel does to the whole answer.
DEGRADING = {
    "CAPABILITY_DISABLED": "DISABLED", "PROJECTION_NOT_READY": "NOT_READY", "PROJECTION_STALE": "DEGRADED", "CAPABILITY_UNAVAILABLE": "UNAVAILABLE",
    "PROJECTION_INCOMPATIBLE": "UNAVAILABLE", "BACKEND_LOCKED": "UNAVAILABLE", "FILESYSTEM_UNAVAILABLE": "UNAVAILABLE", "TRANSACTION_FAILURE": "UNAVAILABLE",
    "BACKEND_FAILURE": "UNAVAILABLE", "CONFIGURATION_INVALID": "UNAVAILABLE",
}
FAILING_CLOSED = ("PROJECTION_CORRUPT", "INVALID_PROJECTION_INPUT", "INVALID_PROVENANCE", "CROSS_WORKSPACE", "INVALID_TRAVERSAL_BOUNDS", "LOCAL_VALIDATION")


def failure_verdict(failure_type: str) -> tuple[str, str | None]:
    """DEGRADE with the channel's outcome, FAIL_CLOSED, or PROPAGATE for what no policy knows."""
    if failure_type in DEGRADING:
        return "DEGRADE", DEGRADING[failure_type]
    return ("FAIL_CLOSED" if failure_type in FAILING_CLOSED else "PROPAGATE"), None


NAVIGATION_ONLY = ("TAG", "CONCEPT")


def admitted(candidates: DataFrame, vertices_: DataFrame) -> DataFrame:
    """Candidates with ``score`` (1 / depth) and ``rejection``, as far as their entity's type decides it."""
    rows = candidates.join(vertices_.select("entity_id", "entity_type", "key"), "entity_id", "left")
    reason = (
        F.when(F.col("entity_type").isNull(), "AUTHORITY_MISSING")
        .when(F.col("entity_type").isin(*NAVIGATION_ONLY), "NON_EVIDENCE_ENTITY")
        .when(F.col("entity_type") == "SOURCE_DOCUMENT", "NON_CITATION_AUTHORITY")
    )
    return rows.withColumn("score", 1 / F.col("depth")).withColumn("rejection", reason)


def admission(candidates: DataFrame, vertices_: DataFrame, relations: DataFrame, pages: DataFrame, documents: DataFrame, chunks: DataFrame, workspace: int, version: str) -> DataFrame:
    """Candidates with ``score``, ``kind``, ``stable_id`` and ``content`` of the evidence they stand for, and
    ``rejection``: null where the canonical rows, read again, back them, else the first test that fails.

    candidates: ``seed_id, entity_id, depth, path`` (relation ids); vertices: ``entity_id, entity_type, key,
    workspace_id, projection_version, authority_kind, authority_id, eligible, content_hash, revision`` (their
    provenance); relations: ``relation_id, relation_type, workspace_id, projection_version``; pages:
    ``knowledge_id, revision, content_hash, body``; documents: ``document_id, eligible, sha256``; chunks:
    ``chunk_id, document_id, chunk_no, eligible, content_hash, content``. The tests are of the entity's workspace,
    eligibility and version, then of each relation of the path in order, of the key, and of the authority by type; of
    candidates for one piece of evidence the first counts. Left joins from the candidates, which are the small side.
    """
    provenance = vertices_.select("entity_id", "entity_type", "key", "workspace_id", "projection_version", "authority_kind", "authority_id", "eligible", "content_hash", "revision")
    rows = candidates.join(provenance, "entity_id", "left").withColumn("candidate", F.xxhash64("seed_id", "entity_id", F.array_join("path", " ")))

    steps = candidates.select(F.xxhash64("seed_id", "entity_id", F.array_join("path", " ")).alias("candidate"), F.posexplode("path").alias("step", "relation_id"))
    own = relations.select("relation_id", "relation_type", F.col("workspace_id").alias("own_workspace"), F.col("projection_version").alias("own_version"))
    wrong = F.when(~F.coalesce(F.col("relation_type").isin(*ADMITTED_RELATIONS), F.lit(False)), "DISALLOWED_RELATION").when(
        ~F.col("own_version").eqNullSafe(F.lit(version)) | ~F.col("own_workspace").eqNullSafe(F.lit(workspace)), "STALE_PROVENANCE"
    )
    steps = steps.join(own, "relation_id", "left").withColumn("wrong", wrong).where("wrong is not null")
    rows = rows.join(steps.groupBy("candidate").agg(F.min_by("wrong", "step").alias("wrong_step")), "candidate", "left")

    place = F.regexp_extract(F.col("authority_id"), r"^document:(\d{1,18})(?::chunk:(\d{1,18}))?$", 1)
    number = F.regexp_extract(F.col("authority_id"), r"^document:(\d{1,18}):chunk:(\d{1,18})$", 2)
    number_of = lambda c: F.when(c != "", c.cast("long"))
    is_kind = lambda kind: F.col("entity_type") == kind
    rows = rows.withColumn("at_page", F.when(is_kind("WIKI_PAGE"), F.col("authority_id"))).withColumn("at_document", number_of(place)).withColumn("at_chunk", F.when(is_kind("SOURCE_CHUNK"), number_of(number)))
    page = pages.select(F.col("knowledge_id").alias("at_page"), F.lit(True).alias("page_there"), F.col("revision").alias("page_revision"), F.col("content_hash").alias("page_hash"), "body")
    document = documents.select(F.col("document_id").cast("long").alias("at_document"), F.lit(True).alias("document_there"), F.col("eligible").alias("document_eligible"), F.col("sha256").alias("document_hash"))
    chunk = chunks.select(
        F.col("document_id").cast("long").alias("at_document"), F.col("chunk_no").cast("long").alias("at_chunk"), "chunk_id", F.lit(True).alias("chunk_there"),
        F.col("eligible").alias("chunk_eligible"), F.col("content_hash").alias("chunk_hash"), F.col("content").alias("chunk_content"),
    )
    rows = rows.join(page, "at_page", "left").join(document, "at_document", "left").join(chunk, ["at_document", "at_chunk"], "left")

    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    blank = lambda c: F.coalesce(X.is_blank(c), F.lit(True))
    other_kind = ~F.col("authority_kind").eqNullSafe(F.col("entity_type"))
    wiki = F.when(other_kind | F.col("revision").isNull() | F.col("content_hash").isNull(), "MALFORMED_PROVENANCE").when(no("page_there"), "AUTHORITY_MISSING").when(
        differs("revision", "page_revision") | differs("content_hash", "page_hash"), "AUTHORITY_STALE"
    ).when(blank("body"), "AUTHORITY_INELIGIBLE")
    of_document = F.when(other_kind | F.col("at_document").isNull() | F.col("content_hash").isNull(), "MALFORMED_PROVENANCE").when(no("document_there"), "AUTHORITY_MISSING").when(
        no("document_eligible"), "AUTHORITY_INELIGIBLE"
    )
    whole = of_document.when(differs("content_hash", "document_hash"), "AUTHORITY_STALE").otherwise("NON_CITATION_AUTHORITY")
    piece = (
        F.when(F.col("at_chunk").isNull(), "MALFORMED_PROVENANCE").when(of_document.isNotNull(), of_document).when(no("chunk_there"), "AUTHORITY_MISSING")
        .when(no("chunk_eligible"), "AUTHORITY_INELIGIBLE").when(differs("content_hash", "chunk_hash"), "AUTHORITY_STALE").when(blank("chunk_content"), "AUTHORITY_INELIGIBLE")
    )
    named = F.concat(F.lower("authority_kind"), F.lit(":"), "authority_id")
    reason = (
        F.when(F.col("entity_type").isNull(), "AUTHORITY_MISSING")
        .when(~F.col("workspace_id").eqNullSafe(F.lit(workspace)), "WORKSPACE_MISMATCH")
        .when(no("eligible"), "AUTHORITY_INELIGIBLE")
        .when(~F.col("projection_version").eqNullSafe(F.lit(version)), "STALE_PROVENANCE")
        .when(F.col("wrong_step").isNotNull(), F.col("wrong_step"))
        .when(~F.col("entity_type").isin(*NAVIGATION_ONLY) & ~F.col("key").eqNullSafe(named), "MALFORMED_PROVENANCE")
        .when(is_kind("WIKI_PAGE"), wiki).when(is_kind("SOURCE_CHUNK"), piece).when(is_kind("SOURCE_DOCUMENT"), whole)
        .otherwise("NON_EVIDENCE_ENTITY")
    )
    kind = F.when(is_kind("WIKI_PAGE"), "WIKI").when(is_kind("SOURCE_CHUNK"), "SOURCE_CHUNK")
    stable = F.when(is_kind("WIKI_PAGE"), F.col("at_page")).when(is_kind("SOURCE_CHUNK"), F.col("chunk_id").cast("string"))
    rows = rows.withColumn("reason", reason).withColumn("kind", kind).withColumn("stable_id", F.when(F.col("reason").isNull(), stable))
    first = Window.partitionBy("kind", "stable_id", F.when(F.col("reason").isNotNull(), F.col("candidate"))).orderBy("depth", "seed_id", "entity_id", F.array_join("path", " "))
    repeated = F.col("reason").isNull() & (F.row_number().over(first) > 1)
    return rows.select(
        *candidates.columns, "kind", "stable_id", (1 / F.col("depth")).alias("score"), F.coalesce(F.when(is_kind("WIKI_PAGE"), F.col("body")), F.col("chunk_content")).alias("content"),
        F.when(repeated, "DUPLICATE_IDENTITY").otherwise(F.col("reason")).alias("rejection"),
    )
