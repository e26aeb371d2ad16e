import hashlib
import json

import pytest
from loreweave.operators import digests, embedding, evidence, fusion
from loreweave.plans import projection_queries
from loreweave.streaming import inbox


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(values, leaf):
    level = [sha("\x1e".join(values[i : i + leaf])) for i in range(0, len(values), leaf)] or [sha("")]
    while len(level) > 1:
        level = [sha("".join(level[i : i + leaf])) for i in range(0, len(level), leaf)]
    return level[0]


@pytest.mark.parametrize("n, leaf", [(0, 4), (1, 4), (4, 4), (5, 4), (300, 4), (300, 4096)])
def test_ordered_digest_is_a_tree_over_places(spark, monkeypatch, n, leaf):
    monkeypatch.setattr(digests, "LEAF", leaf)
    keys = [f"k{i * 7919 % 1000:04d}" for i in range(n)]
    rows = spark.createDataFrame([(k, f"v{k}") for k in keys], "key string, value string")
    want = tree([f"v{k}" for k in sorted(keys)], leaf)
    assert tuple(digests.ordered(rows).first()) == tuple(digests.ordered(rows.repartition(7)).first()) == (n, want)


def test_a_refresh_reads_changed_documents_alone(spark, tmp_path):
    chunk = lambda d, n, text: (d, f"{d}-{n}", n, text, sha(text))
    schema = "document_id string, chunk_id string, chunk_no long, normalized_content string, content_hash string"
    rows = [chunk(f"d{i}", n, f"text {i} {n}") for i in range(20) for n in (0, 1, 1024, 5000)]
    kept = digests.DocumentDigests(spark, str(tmp_path / "kept"), buckets=8)
    kept.refresh(spark.createDataFrame(rows, schema))
    before = kept.store.snapshot()
    rows = [r for r in rows if r[0] not in ("d3", "d4")] + [chunk("d3", 0, "new")]
    kept.refresh(spark.createDataFrame([r for r in rows if r[0] == "d3"], schema), spark.createDataFrame([("d4",)], "document_id string"))
    changed = [b for b, p in before.tables["digests"]["buckets"].items() if kept.store.snapshot().tables["digests"]["buckets"].get(b) != p]
    assert 1 <= len(changed) <= 2
    whole = {tuple(r) for r in digests.of_documents(digests.chunk_digests(spark.createDataFrame(rows, schema))).collect()}
    assert {tuple(r) for r in kept.fingerprints().collect()} == whole and len(whole) == 19
    assert {tuple(r) for r in kept.fingerprints(["d3", "d7"]).collect()} == {r for r in whole if r[0] in ("d3", "d7")}


def test_every_rejection_of_a_graph_candidate_occurs(spark):
    found = {r["rejection"] for r in projection_queries.graph_admission(spark, "/root/testdata/sf0.01").select("rejection").distinct().collect()}
    found |= {r["rejection"] for r in projection_queries.graph_fused_duplicates(spark, "/root/testdata/sf0.01").select("rejection").distinct().collect()}
    assert found == {
        None, "WORKSPACE_MISMATCH", "AUTHORITY_INELIGIBLE", "STALE_PROVENANCE", "DISALLOWED_RELATION", "MALFORMED_PROVENANCE", "AUTHORITY_MISSING", "AUTHORITY_STALE", "NON_EVIDENCE_ENTITY",
        "NON_CITATION_AUTHORITY", "DUPLICATE_IDENTITY",
    }


CONTRACT = embedding.Contract("p", "m", 2, "v")


def authority(spark, texts):
    return spark.createDataFrame([("WIKI", k, sha(t), t) for k, t in texts.items()], "kind string, stable_id string, content_hash string, content string")


def stored(kept):
    return {r["stable_id"]: (r["status"], r["failure"], r["generation"], r["embedding"]) for r in kept.read(kept.snapshot(), "projections").collect()}


def embedder():
    def lengths(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[float(len(t)), 1.0 if t != "short" else float("nan")] if t != "one" else [1.0] for t in texts]

    return lengths  # a function of its own goes to the executors by value


lengths = embedder()


def test_embeddings_fail_alone_and_are_tried_again(spark, tmp_path):
    kept = embedding.store(spark, str(tmp_path / "kept"), buckets=4)
    texts = {"a": "text", "b": "bad", "c": "short", "d": "one", "e": ""}
    plan, done = embedding.refresh(kept, lambda: authority(spark, texts), lengths, CONTRACT, 1)
    assert done.status == "APPLIED" and {r["action"] for r in plan.collect()} == {"MISSING"}
    assert stored(kept) == {"a": ("FRESH", None, 1, [4.0, 1.0]), "b": ("FAILED", "RuntimeError", 1, None), "c": ("FAILED", "INVALID_VECTOR", 1, None), "d": ("FAILED", "INVALID_VECTOR", 1, None), "e": ("FRESH", None, 1, [0.0, 1.0])}
    texts = {"a": "other", "b": "bad", "c": "longer", "e": ""}
    plan, _ = embedding.refresh(kept, lambda: authority(spark, texts), lengths, CONTRACT, 2)
    assert {r["stable_id"]: r["action"] for r in plan.collect()} == {"a": "CHANGED", "b": "FAILED", "c": "CHANGED", "d": "ORPHAN", "e": "CURRENT"}
    assert stored(kept) == {"a": ("FRESH", None, 2, [5.0, 1.0]), "b": ("FAILED", "RuntimeError", 2, None), "c": ("FRESH", None, 2, [6.0, 1.0]), "e": ("FRESH", None, 1, [0.0, 1.0])}


def test_embeddings_are_stored_under_guards(spark, tmp_path):
    kept = embedding.store(spark, str(tmp_path / "kept"), buckets=4)
    embedding.refresh(kept, lambda: authority(spark, {"a": "x", "b": "y", "c": "z"}), lengths, CONTRACT, 5)
    old = embedding.embedded(authority(spark, {"a": "late", "n": "then"}), lengths, CONTRACT, 4)
    orphans = spark.createDataFrame([("WIKI", "b"), ("WIKI", "c")], "kind string, stable_id string")
    embedding.write(kept, old, orphans, lambda: authority(spark, {"a": "late", "n": "now", "c": "z"}), 4)
    assert {k: v[2] for k, v in stored(kept).items()} == {"a": 5, "b": 5, "c": 5}  # an older generation and a text that moved on change nothing
    embedding.write(kept, embedding.embedded(authority(spark, {"n": "now"}), lengths, CONTRACT, 6), orphans, lambda: authority(spark, {"n": "now", "c": "z"}), 6)
    assert {k: v[2] for k, v in stored(kept).items()} == {"a": 5, "c": 5, "n": 6}


def test_a_writer_that_comes_late_decides_anew(spark, tmp_path):
    kept = embedding.store(spark, str(tmp_path / "kept"), buckets=4)
    embedding.refresh(kept, lambda: authority(spark, {"a": "x"}), lengths, CONTRACT, 1)
    calls = []

    def moving():
        calls.append(1)
        if len(calls) == 1:  # between this writer's reading and its commit another one commits
            embedding.write(kept, embedding.embedded(authority(spark, {"b": "y"}), lengths, CONTRACT, 3), authority(spark, {"q": "q"}), lambda: authority(spark, {"b": "y"}), 3)
        return authority(spark, {"a": "xx", "b": "yy"})

    rows = embedding.embedded(authority(spark, {"a": "xx", "b": "yy"}), lengths, CONTRACT, 2)
    assert embedding.write(kept, rows, authority(spark, {"q": "q"}), moving, 2).status == "APPLIED"
    assert len(calls) == 2 and {k: v[2] for k, v in stored(kept).items()} == {"a": 2, "b": 3}


def test_fused_trace_shows_every_fate(spark):
    rows = [("LEXICAL", "WIKI", i, n, 1, f"h{i}") for n, i in enumerate("abcdefg")] + [("LEXICAL", "WIKI", "a", 99, 1, "hx"), ("VECTOR", "WIKI", "x", 0, 2, "hx"), ("VECTOR", "WIKI", "c", 1, 1, "hc"), ("GRAPH", "WIKI", "z", 0, 1, "hz"), ("GRAPH", "WIKI", "y", 1, 1, "old")]
    candidates = spark.createDataFrame(rows, "channel string, kind string, stable_id string, ordinal int, workspace_id int, content_hash string")
    texts = {"a": "A" * 10, "b": "  ", "c": "C" * 5, "d": "D" * 30, "e": "E", "f": "F", "x": "X", "y": "Y", "z": "Z" * 4}
    own = spark.createDataFrame([("WIKI", k, 1, f"h{k}", k != "f", t) for k, t in texts.items()], "kind string, stable_id string, workspace_id int, content_hash string, eligible boolean, content string")
    now = own.where("stable_id <> 'c'").drop("content")
    trace = lambda **more: {r["stable_id"]: r for r in evidence.fused_trace(candidates, own, now, fusion.FUSION["fusion-rrf-v1"], 8, 32, **more).collect()}
    got = trace()
    assert {k: (r["disposition"], r["reason"], r["rejections"]) for k, r in got.items()} == {
        "a": ("SELECTED", None, None), "b": ("BUDGET_EXCLUDED", None, None), "c": ("REJECTED", "AUTHORITY_MISSING", None), "d": ("SELECTED", None, None), "e": ("NOT_REACHED", None, None),
        "f": ("REJECTED", "INELIGIBLE", "LEXICAL:INELIGIBLE"), "g": ("REJECTED", "AUTHORITY_MISSING", "LEXICAL:AUTHORITY_MISSING"), "x": ("REJECTED", "WORKSPACE_MISMATCH", "VECTOR:WORKSPACE_MISMATCH"),
        "y": ("REJECTED", "STALE_REVISION", "GRAPH:STALE_REVISION"), "z": ("SELECTED", None, None),
    }
    assert [got[k]["fused_rank"] for k in "cazbd"] == [1, 2, 3, 4, 5] and (got["c"]["lexical"], got["c"]["vector"], got["x"]["vector"]) == (3, 2, 1)
    assert got["d"]["evidence"] == "D" * 13 and got["c"]["evidence"] is None and got["a"]["modalities"] == "LEXICAL"
    assert trace(graph_current=False)["z"]["reason"] == "PROJECTION_STALE"
    told = {r["channel"]: (r["candidates"], r["rejected"], r["selected"], r["outcome"]) for r in evidence.outcomes(evidence.fused_trace(candidates, own, now, fusion.FUSION["fusion-rrf-v1"], 8, 32)).collect()}
    assert told == {"LEXICAL": (7, 2, 2, "CONTRIBUTED"), "VECTOR": (2, 1, 0, "CONTRIBUTED"), "GRAPH": (2, 1, 1, "CONTRIBUTED")}


def batch(spark, files):
    return spark.createDataFrame(list(files.items()), "source_path string, text string")


def test_a_batch_that_dies_between_its_writes_leaves_no_repeats(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    inbox.write_batch(batch(spark, {"a": "one\n\ntwo", "b": "one\n\ntwo"}), 0, out)
    files = {"c": "three\r\nfour", "d": "one\n\ntwo"}
    with monkeypatch.context() as patch:
        patch.setattr(inbox.snapshots, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            inbox.write_batch(batch(spark, files), 1, out)
    assert inbox.committed(spark, out) == [0] and inbox.table(spark, out, "documents").count() == 2
    for _ in range(2):  # the retry, and a retry of what is published
        inbox.write_batch(batch(spark, files), 1, out)
    documents = inbox.table(spark, out, "documents")
    assert sorted((r["source_path"], r["status"]) for r in documents.collect()) == sorted([("a", documents.where("source_path = 'a'").first()["status"]), ("b", documents.where("source_path = 'b'").first()["status"]), ("c", "PENDING")])
    assert {r["status"] for r in documents.where("source_path in ('a', 'b')").collect()} == {"PENDING", "DUPLICATE"}
    own = inbox.table(spark, out, "chunks")
    assert own.count() == own.dropDuplicates(["doc_id", "chunk_no"]).count() and own.select("doc_id").distinct().count() == 2
    assert json.loads(open(f"{out}/batches/{1:012d}.json").read())["tables"] == list(inbox.TABLES)


def test_documents_are_chunked_in_normal_form(spark):
    page = "Head\nbody {}\nfoot"
    _, own = inbox.process(batch(spark, {"a": "\f".join(page.format(i) for i in range(3)) + "  \r\n\x00"}), None)
    text = " ".join(r["content"] if "content" in r else r["normalized_content"] for r in (x.asDict() for x in own.collect()))
    assert "body 1" in text and "Head" not in text and "\x00" not in text
