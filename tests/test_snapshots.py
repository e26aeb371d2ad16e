import json
import random

import pytest
from pyspark.sql import functions as F

from loreweave.operators import graph
from loreweave.sources import snapshots
from loreweave.sources.snapshots import Change, Keyed, SnapshotStore, StaleSnapshot

TABLES = {"rows": Keyed("key", ("key", "id"))}


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"), TABLES, buckets=8, files=2)


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, id int, value string")


def held(store, snapshot=None, keys=None):
    return sorted(tuple(r) for r in store.read(snapshot or store.snapshot(), "rows", keys).collect())


def test_publish_is_exclusive_and_whole(spark, tmp_path):
    path = str(tmp_path / "a" / "one.json")
    assert snapshots.publish(spark, path, "first") and not snapshots.publish(spark, path, "second")
    assert snapshots.text_of(spark, path) == "first"
    assert [n for n in snapshots.names_in(spark, str(tmp_path / "a")) if not n.startswith(".")] == ["one.json"]
    assert snapshots.names_in(spark, str(tmp_path / "nowhere")) == []


def test_generations_hold_what_a_dictionary_holds(spark, store):
    rng = random.Random(3)
    model, states = {}, {}
    for generation in range(1, 6):
        rows = {(f"k{rng.randrange(12)}", rng.randrange(5)): f"v{rng.randrange(100)}" for _ in range(15)}
        gone = {(f"k{rng.randrange(12)}",) for _ in range(2)}
        change = Change(table(spark, [(*k, v) for k, v in rows.items()]), spark.createDataFrame(sorted(gone), "key string") if generation > 1 else None)
        assert store.commit({"rows": change}).status == "APPLIED"
        if generation > 1:
            model = {k: v for k, v in model.items() if (k[0],) not in gone}
        model |= rows
        states[generation] = sorted((*k, v) for k, v in model.items())
    for generation, want in states.items():
        assert held(store, store.snapshot(generation)) == want
    assert held(store, keys=["k1", "k2", "none"]) == [r for r in states[5] if r[0] in ("k1", "k2")]
    assert held(store, keys=[]) == []


def test_only_touched_buckets_are_written(spark, store):
    first = store.commit({"rows": Change(table(spark, [(f"k{i}", i, "a") for i in range(50)]))}).snapshot
    second = store.commit({"rows": Change(table(spark, [("k1", 1, "b")]))}).snapshot
    before, after = first.tables["rows"]["buckets"], second.tables["rows"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()


def test_same_content_is_no_new_generation(spark, store):
    rows = table(spark, [("a", 1, "x"), ("b", 2, None), (None, 3, "no key")])
    assert store.commit({"rows": Change(rows)}).status == "APPLIED"
    assert store.commit({"rows": Change(rows.repartition(3))}).status == "NO_OP"
    assert store.commit({"rows": Change(gone=spark.createDataFrame([("zz",)], "key string"))}).status == "NO_OP"
    assert held(store) == [("a", 1, "x"), ("b", 2, None)] and store.generations() == [1]


def test_of_two_writers_one_is_too_late(spark, store):
    base = store.commit({"rows": Change(table(spark, [("a", 1, "x")]))}).snapshot
    assert store.commit({"rows": Change(table(spark, [("b", 1, "mine")]))}, base).status == "APPLIED"
    late = store.commit({"rows": Change(table(spark, [("c", 1, "theirs")]))}, base)
    assert late.status == "SUPERSEDED" and late.snapshot.generation == 2
    assert held(store) == [("a", 1, "x"), ("b", 1, "mine")]
    with pytest.raises(StaleSnapshot):
        store.prove(base)
    store.prove(store.snapshot())


def test_conflicting_rows_and_a_dead_writer(spark, store):
    with pytest.raises(ValueError, match="conflict"):
        store.commit({"rows": Change(table(spark, [("a", 1, "x"), ("a", 1, "y")]))})
    assert store.snapshot() is None  # its folders, if any, are named by no manifest
    assert store.commit({"rows": Change(table(spark, [("a", 1, "x"), ("a", 1, "x")]))}).status == "APPLIED"
    assert held(store) == [("a", 1, "x")]


def test_stale_rows_go_and_all_rows_go(spark, store):
    store.commit({"rows": Change(table(spark, [(k, i, "v") for k in "abc" for i in range(3)]))})
    store.retain({"rows": table(spark, [("a", 0, ""), ("b", 1, ""), ("b", 2, ""), ("q", 9, "")])})
    assert held(store) == [("a", 0, "v"), ("b", 1, "v"), ("b", 2, "v")]
    assert store.clear(store.snapshot()).status == "APPLIED" and held(store) == []
    store.commit({"rows": Change(table(spark, [("n", 1, "new")]))})
    store.vacuum(keep=1)
    assert store.generations() == [4] and held(store) == [("n", 1, "new")]


def test_nulls_may_follow_first_rows_that_can_hold_none(spark, store):
    parts = [F.array(F.lit(0.0)).alias("vector"), F.array(F.struct(F.lit(1).alias("n"))).alias("nested")]
    first = spark.createDataFrame([("a", 1), ("b", 1)], "key string, id int").select("key", "id", *parts)
    assert not first.schema["vector"].dataType.containsNull and not first.schema["nested"].dataType.elementType["n"].nullable
    store.commit({"rows": Change(first)})
    kind = "key string, id int, vector array<double>, nested array<struct<n: int>>"
    assert store.commit({"rows": Change(spark.createDataFrame([("a", 1, [None, 2.0], [(None,), None]), ("c", 1, None, None)], kind))}).status == "APPLIED"
    assert held(store) == [("a", 1, [None, 2.0], [(None,), None]), ("b", 1, [0.0], [(1,)]), ("c", 1, None, None)]


def test_a_manifest_without_nulls_takes_rows_with_nulls(spark, store):
    kind = "key string, id int, vector array<double>"
    base = store.commit({"rows": Change(spark.createDataFrame([("a", 1, [1.0])], kind))}).snapshot
    base.tables["rows"]["schema"] = json.loads(json.dumps(base.tables["rows"]["schema"]).replace('"containsNull": true', '"containsNull": false'))
    assert "false" in json.dumps(base.tables["rows"]["schema"])
    store.commit({"rows": Change(spark.createDataFrame([("a", 1, [None])], kind))}, base)
    assert held(store) == [("a", 1, [None])]


def test_traversal_reads_one_generation(spark, tmp_path):
    pairs = [("s", "a"), ("s", "b"), ("a", "c"), ("c", "d"), ("b", "s")]
    edges = spark.createDataFrame([(f"{a}{b}", "LINKS_TO", a, b) for a, b in pairs], "relation_id string, relation_type string, source_id string, target_id string")
    kept = graph.store(spark, str(tmp_path / "graph"), buckets=4)
    kept.commit({"vertices": Change(spark.createDataFrame([(c,) for c in "sabcd"], "entity_id string")), "adjacency": Change(edges)})
    pinned = kept.snapshot()
    assert graph.traverse_pinned(kept, pinned, ["s"]) == graph.traverse(edges, ["s"])
    kept.retain({"adjacency": edges.where(F.col("source_id") != "a")})
    with pytest.raises(StaleSnapshot):
        graph.traverse_pinned(kept, pinned, ["s"])
    assert [c[1] for c in graph.traverse(lambda ids: kept.read(pinned, "adjacency", keys=ids), ["s"]).candidates] == ["a", "b", "c"]
    assert [c[1] for c in graph.traverse_pinned(kept, kept.snapshot(), ["s"]).candidates] == ["a", "b"]
    with pytest.raises(ValueError, match="more seeds"):
        graph.traverse(edges, ["s", "a"], bounds=graph.Bounds(nodes=1))


def test_failures_of_the_graph_channel():
    assert graph.failure_verdict("PROJECTION_STALE") == ("DEGRADE", "DEGRADED")
    assert graph.failure_verdict("CROSS_WORKSPACE") == ("FAIL_CLOSED", None)
    assert graph.failure_verdict("TypeError") == ("PROPAGATE", None)
