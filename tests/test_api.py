import hashlib

import pytest
from pyspark.sql import functions as F

from loreweave import api
from loreweave.operators import digests, rewrite

TEXTS = {1: "alpha beta gamma", 2: "alpha beta beta delta", 3: "gamma ERR-1234 busy_timeout", 4: "alpha removed", 5: "epsilon 한국어"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def base(spark):
    chunks = spark.createDataFrame([(i, 10 + i % 2, i, t, t, sha(t), i != 4, None, None) for i, t in TEXTS.items()], "chunk_id long, document_id long, chunk_no long, content string, normalized_content string, content_hash string, eligible boolean, section string, page_no int")
    pages = spark.createDataFrame([("k1", "Alpha page", "about beta", sha("k1"), "CONCEPT", 1), ("k2", "Other", "alpha and epsilon", sha("k2"), "HOWTO", 1)], "knowledge_id string, title string, body string, content_hash string, page_type string, revision int")
    vectors = spark.createDataFrame([("1", "SOURCE_CHUNK", [1.0, 0.0]), ("3", "SOURCE_CHUNK", [0.9, 0.1]), ("4", "SOURCE_CHUNK", [1.0, 0.0]), ("k2", "WIKI", [0.0, 1.0])], "stable_id string, kind string, embedding array<double>")
    return api.KnowledgeBase(chunks, pages, vectors, lambda q: [1.0, 0.0])


def found(page):
    return [(r["kind"], r["stable_id"]) for r in page.items.collect()]


def test_search_pages_totals_and_filters(base):
    page = base.search("alpha")
    assert page.total == 4 and [k for k, _ in found(page)] == ["SOURCE_CHUNK", "WIKI"] * 2 and ("SOURCE_CHUNK", "4") not in found(page)
    assert found(base.search("alpha", page=1, size=3)) == found(page)[3:] and base.search("alpha", page=9).total == 4
    assert found(base.search("alpha", "WIKI", page_type="HOWTO")) == [("WIKI", "k2")]
    assert found(base.search("한국어")) == [("SOURCE_CHUNK", "5")]
    assert found(base.search(" \n")) == [] and base.search("   ").total == 0
    for bad in ({"corpus": "X"}, {"size": 0}, {"corpus": "WIKI", "document_id": 1}, {"document_id": 1}, {"corpus": "SOURCE", "page_type": "HOWTO"}):
        with pytest.raises(ValueError):
            base.search("alpha", **bad)
    with pytest.raises(ValueError):
        base.search("a\x07b")


def test_an_index_is_written_once(base):
    first = base.index("SOURCE")
    base.search("alpha"), base.search("beta")
    assert base.index("SOURCE") is first and first.generations() == [1]


def test_a_shorter_query_is_tried_within_a_document(base):
    page = base.search("gamma zeta ERR-1234", "SOURCE", document_id=11)
    assert page.query == "ERR-1234" and found(page) == [("SOURCE_CHUNK", "3")] and page.total == 1
    assert base.search("gamma zeta ERR-1234", "SOURCE").total == 0
    assert base.search("zeta eta", "SOURCE", document_id=11).total == 0


def test_the_gate_serves_current_documents_alone(spark, base, tmp_path):
    kept = digests.DocumentDigests(spark, str(tmp_path / "digests"), buckets=4)
    kept.refresh(base.chunks.where("eligible"))
    documents = spark.createDataFrame([(10, "PROCESSED", "PROCESSED"), (11, "PROCESSED", "PROCESSED")], "document_id long, status string, parse_status string")
    now = kept.fingerprints().withColumn("sync_status", F.lit("SYNCED")).withColumn("projection_version", F.lit("v1"))
    ledger = now.select("document_id", "sync_status", "projection_version", F.col("chunks").alias("eligible_count"), F.col("chunks").alias("indexed_count"), F.col("fingerprint").alias("canonical_fingerprint"), F.col("fingerprint").alias("indexed_fingerprint"))
    ledger = spark.createDataFrame(ledger.collect(), ledger.schema)
    gated = lambda rows: api.KnowledgeBase(base.chunks, base.pages, gate=api.Gate(documents, rows, kept, "v1"), indexes=base.indexes)
    assert sorted(found(gated(ledger).search("alpha", "SOURCE"))) == [("SOURCE_CHUNK", "1"), ("SOURCE_CHUNK", "2")]
    behind = ledger.withColumn("indexed_fingerprint", F.when(F.col("document_id") == 11, "old").otherwise(F.col("indexed_fingerprint")))
    page = gated(behind).search("alpha", "SOURCE")
    assert found(page) == [("SOURCE_CHUNK", "2")] and page.total == 1


def test_retrieval_keeps_a_trace_and_says_what_is_missing(spark, base):
    got = base.retrieve("alpha beta", "HYBRID_VECTOR")
    rows = {r["stable_id"]: r for r in got.trace.collect()}
    assert got.degraded == {} and rows["1"]["modalities"] == "LEXICAL,VECTOR" and rows["1"]["disposition"] == "SELECTED" and "4" not in rows
    assert [r["stable_id"] for r in got.evidence.collect()][:1] == ["k1"]  # words in the title
    lame = api.KnowledgeBase(base.chunks, base.pages, indexes=base.indexes)
    assert lame.retrieve("alpha beta", "HYBRID_GRAPH").degraded == {"VECTOR": "UNAVAILABLE", "GRAPH": "NOT_READY"}
    with pytest.raises(ValueError):
        lame.retrieve("alpha", "SEMANTIC_WIKI")
    broken = api.KnowledgeBase(base.chunks, base.pages, base.projections, lambda q: 1 / 0, indexes=base.indexes)
    assert broken.retrieve("alpha beta", "HYBRID_VECTOR").degraded == {"VECTOR": "ZeroDivisionError"}
    gone = spark.createDataFrame([("SOURCE_CHUNK", "4", 1), ("SOURCE_CHUNK", "99", 2), ("SOURCE_CHUNK", "5", 3)], "kind string, stable_id string, ord int")
    trace, outcome = base.inspect("alpha beta", "HYBRID_GRAPH", graph=gone)
    rows = {r["stable_id"]: (r["disposition"], r["reason"]) for r in trace.collect()}
    assert rows["4"] == ("REJECTED", "INELIGIBLE") and rows["99"] == ("REJECTED", "AUTHORITY_MISSING") and rows["5"] == ("SELECTED", None)
    assert {r["channel"]: r["outcome"] for r in outcome.collect()} == {"LEXICAL": "CONTRIBUTED", "VECTOR": "CONTRIBUTED", "GRAPH": "CONTRIBUTED"}


def test_a_second_stage_only_reorders(base):
    order = lambda rerank: [r["stable_id"] for r in base.retrieve("alpha", rerank=rerank).evidence.collect()]
    fused = order("none")
    assert order(lambda ids: ids[::-1]) == fused[::-1]
    assert order(lambda ids: ids[1:]) == order(lambda ids: 1 / 0) == fused


def test_ask_compacts_and_cites(base):
    answer = lambda q, blocks: {"answer": "yes", "citations": [blocks[0]["citation_id"]]}
    assert base.ask("alpha", answer)["status"] == "ANSWERED"
    assert base.ask("alpha", lambda q, blocks: {"answer": "?", "citations": ["E99"]})["status"] == "FAILED"
    seen = []
    base.ask("alpha", lambda q, blocks: seen.append(blocks) or {"insufficient": True}, compact=lambda blocks: blocks[:1])
    assert len(seen[0]) == 1
    assert base.ask("nothing here", answer)["status"] == "INSUFFICIENT_EVIDENCE"


def test_a_rewrite_joins_its_evidence(base):
    asked = "please tell zeta about ERR-1234"
    rows, status = base.rewritten(asked, lambda q, protected: f"busy_timeout {protected[0]}")
    assert status == "REWRITE_APPLIED"
    assert [(r["stable_id"], r["rank"]) for r in rows.collect()] == [("3", 1), ("1", 2), ("k2", 3)]
    assert base.rewritten(asked, lambda q, protected: "something else")[1] == "FALLBACK_EXACT_TOKEN_LOSS"
    assert base.rewritten(asked, lambda q, protected: 1 / 0)[1] == "FALLBACK_PROVIDER_UNAVAILABLE"
    assert base.rewritten("please find alpha beta", lambda q, protected: "x")[1] in ("NO_OP_NOT_APPLICABLE", "FALLBACK_PROVIDER_INVALID", "REWRITE_APPLIED")


def test_merged_evidence_keeps_first_places(spark):
    rows = lambda *items: spark.createDataFrame([("WIKI", k, n, t) for n, (k, t) in enumerate(items, 1)], "kind string, stable_id string, rank int, content string")
    got = rewrite.merged(rows(("a", "xx"), ("b", "xxxx"), ("c", "x")), rows(("c", "y"), ("d", "yyy"), ("e", "yyyyyyyyy"), ("f", "y")), 5, 12)
    assert [(r["stable_id"], r["rank"]) for r in got.collect()] == [("a", 1), ("b", 2), ("d", 3), ("c", 4), ("f", 5)]
    assert [r["stable_id"] for r in rewrite.merged(rows(("a", "xx")), rows(("b", "y"), ("c", "y")), 2, 99).collect()] == ["a", "b"]
