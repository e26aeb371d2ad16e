import json

from pyspark.sql import functions as F

from loreweave.operators import proposals as P
from loreweave.plans import serving_queries


def test_a_rerank_that_drops_or_adds_falls_back():
    assert P.reranked_or_baseline(["a", "b"], ["b", "a"]) == ["b", "a"]
    assert P.reranked_or_baseline(["a", "b"], ["b"]) == P.reranked_or_baseline(["a", "b"], None) == P.reranked_or_baseline(["a", "b"], ["a", "b", "b"]) == ["a", "b"]


def test_compaction_keeps_the_baseline_where_a_policy_breaks_a_rule():
    blocks = [{"citation_id": "E1", "block": "one two"}, {"citation_id": "E2", "block": "three"}]
    assert P.compacted(blocks, lambda b: [{**b[0], "block": "one"}], 10) == [{"citation_id": "E1", "block": "one"}]
    for bad in (lambda b: b[::-1], lambda b: [{**b[0], "block": "new"}], lambda b: 1 / 0, lambda b: b + b):
        assert P.compacted(blocks, bad, 100) == blocks
    assert P.compacted(blocks, lambda b: b[:1], 3) == blocks


def test_analysis_results_are_checked(spark):
    good = {"title": "T", "pageType": "HOWTO", "action": "CREATE", "summary": "", "tags": [], "evidence": [1]}
    cases = [(good, None), ({**good, "tags": ["a"], "evidence": []}, None), ({**good, "pageType": "X"}, "VALUE"), ({**good, "evidence": [3]}, "EVIDENCE"), ({**good, "more": 1}, "FIELDS"), ({**good, "title": " "}, "VALUE"), ([1], "NOT_JSON"), ({**good, "title": 5}, "TYPE"), ({**good, "tags": [1]}, "TYPE"), ({**good, "summary": None}, "TYPE"), ({**good, "evidence": ["1"]}, "TYPE")]
    rows = spark.createDataFrame([(json.dumps(c), [1, 2]) for c, _ in cases] + [("{", [1]), (None, [1])], "t string, a array<long>")
    found, reason = P.analysis("t", "a")
    got = rows.select(found.alias("f"), reason.alias("r")).collect()
    assert [r["r"] for r in got] == [want for _, want in cases] + ["NOT_JSON", "NOT_JSON"]
    assert got[0]["f"].asDict(True) == good and got[2]["f"] is None


def test_vectors_and_paths(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([float("nan")],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in rows.select(P.decoded_vector("v")).collect()] == [[1.0, 2.0], None, None, None]
    paths = ["vault/concepts/a.md", "vault/concepts/../a.md", "vault/x/a.md", "vault/people/a/b.md", "/vault/people/a.md", None]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in rows.select(P.valid_path(F.col("p"))).collect()] == [True, False, False, False, False, False]


def test_drafts_of_odd_proposals(spark):
    data = [None, "{", '{"sections":[{"heading":"A","content":" x\\r\\ny "}],"tags":["b"," A",null,"B"],"aliases":["c",null,"C"],"wikilinks":[{"label":"l"},{"targetTitle":"Z"}]}', "{}", "{}", "{}", '{"sections":[]}', "{}"]
    rows = [(i, "APPROVED", "CREATE", "CONCEPT", "..." if i == 4 else f"Title  {i}", "s", d, 9 if i == 5 else None) for i, d in enumerate(data)]
    lines = [(i, i * 10 + j, j, None, [3, None, 1, 3][j], ["a\r\n\nb ", None, "", " $1"][j]) for i in range(7) for j in (2, 0, 3, 1)] + [(3, None, 7, 1, 1, "x")]
    own = spark.createDataFrame(rows, "proposal_id long, status string, action string, candidate_type string, title string, summary string, data string, document_id long")
    got = {r["proposal_id"]: r for r in P.drafted(own, spark.createDataFrame(lines, "proposal_id long, chunk_id long, chunk_no int, page_no int, document_id long, excerpt string")).collect()}
    assert {i: r["refusal"] for i, r in got.items()} == {0: "INVALID_NORMALIZED_DATA", 1: "INVALID_NORMALIZED_DATA", 2: None, 3: "INVALID_EVIDENCE", 4: "PATH_CONTRACT_MISMATCH", 5: None, 6: "INVALID_NORMALIZED_DATA", 7: "INVALID_EVIDENCE"}
    assert all((r["markdown"] is None) == (r["refusal"] is not None) for r in got.values()) and "sourceDocumentIds:\n  - 9\nsourceChunkIds:\n  - 50\n" in got[5]["markdown"]
    assert got[2]["markdown"] == (
        '---\ntitle: "Title 2"\npageType: "CONCEPT"\nsummary: "s"\ntags:\n  - "a"\n  - "b"\naliases:\n  - "C"\n  - "c"\nsourceDocumentIds:\n  - 1\n  - 3\nsourceChunkIds:\n  - 20\n  - 21\n  - 22\n  - 23\n---\n\n'
        "# Title 2\n\n## A\n\nx\r\ny\n\n## Related Links\n\n- [[Z|Z]]\n\n## Evidence\n\n- sourceChunkId: 20, chunkNo: 0\n  > a\n  > \n  > b\n- sourceChunkId: 22, chunkNo: 2\n  > \n- sourceChunkId: 23, chunkNo: 3\n  > $1\n"
    )


def test_a_draft_is_judged_once_and_its_evidence_shuffled_once(spark, sf_dir):
    plan = serving_queries.proposal_drafts(spark, sf_dir)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("IN (FACT,PROCEDURE)") == 3  # for the page type, and twice in one CASE
    dealt = [line for line in plan.executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert dealt and not any("chunk_id" in line for line in dealt)
