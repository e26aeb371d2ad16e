import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from loreweave.operators import chunks, evidence, fusion, graph, ingest, lifecycle, vector, wiki
from loreweave.sources import files
from loreweave.streaming import inbox


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_registration_and_promotion(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "document_id long, sha256 string")
    own = ingest.register(docs)
    assert sorted(rows(own, "document_id", "status", "duplicate_of")) == [(1, "PENDING", None), (2, "PENDING", None), (3, "DUPLICATE", 1), (4, "DUPLICATE", 1)]
    assert rows(ingest.duplicate_clusters(own)) == [(1, 2, 3)]
    after = {r["document_id"]: (r["status"], r["duplicate_of"]) for r in ingest.promote(own, 1).collect()}
    placed = own.withColumn("source_path", F.concat(F.lit("f"), F.col("document_id").cast("string")))
    heirs = lambda *paths: [r["document_id"] for r in ingest.promote(placed, 1, spark.createDataFrame([(p,) for p in paths], "source_path string")).where("status = 'PENDING'").collect()]
    assert after == {1: ("DELETED", None), 2: ("PENDING", None), 3: ("PENDING", None), 4: ("DUPLICATE", 3)}
    assert heirs("f2", "f4") == [2, 4] and heirs("f3", "f4") == [2, 3] and heirs("f9") == [2, 3]


def test_uploads_get_free_names(spark):
    given = [(1, "a.txt", b"x"), (2, "dir/a.txt", b"y"), (3, "a-1.txt", b"x"), (4, " ", b"z"), (5, "..", b"z"), (6, "b", b""), (7, "c\\a.txt", b"live"), (8, ".hidden", b"h"), (9, ".hidden", b"i"), (10, None, b"z"), (11, "t.tar.gz", b"t"), (12, "b/", b"z")]
    uploads = spark.createDataFrame(given, "upload_id long, file_name string, content binary")
    used = spark.createDataFrame([("a.txt",), ("t.tar.gz",), ("t.tar-1.gz",)], "stored_name string")
    live = spark.createDataFrame([(7, "live", "PENDING"), (5, "y", "DELETED")], "document_id long, t string, status string").withColumn("sha256", F.sha2("t", 256))
    got = {r["upload_id"]: (r["outcome"], r["reason"] or r["stored_name"], r["duplicate_of"]) for r in ingest.landed(uploads, used, live).collect()}
    assert got == {
        1: ("STORED", "a-2.txt", None), 2: ("STORED", "a-3.txt", None), 3: ("DUPLICATE", "a-1.txt", None), 4: ("REJECTED", "BLANK_NAME", None), 5: ("REJECTED", "INVALID_NAME", None), 6: ("REJECTED", "EMPTY", None),
        7: ("DUPLICATE", "a-4.txt", 7), 8: ("STORED", ".hidden", None), 9: ("STORED", ".hidden-1", None), 10: ("REJECTED", "BLANK_NAME", None), 11: ("STORED", "t.tar-2.gz", None), 12: ("REJECTED", "INVALID_NAME", None),
    }


def test_chunk_eligibility(spark):
    good = spark.createDataFrame([(1, 1, None, "x")], "chunk_id long, chunk_no int, page_no int, normalized_content string").withColumn("content_hash", F.sha2("normalized_content", 256))
    bad = good.withColumn("content_hash", F.lit("no")).unionByName(good.withColumn("page_no", F.lit(0))).unionByName(good.withColumn("normalized_content", F.lit(" "))).unionByName(good.withColumn("normalized_content", F.lit("e\u0301")).withColumn("content_hash", F.sha2("normalized_content", 256)))
    assert good.where(ingest.chunk_eligible()).count() == 1 and bad.where(ingest.chunk_eligible()).count() == 0


def test_blocks_and_chunks(spark):
    text = "# One\n\nalpha\n\n## Two\n\nbeta\fgamma\n\n" + "word " * 3000
    own = chunks.blocks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t")
    out = rows(chunks.chunk(own).orderBy("chunk_no"), "chunk_no", "page_no", "heading_path", "content")
    assert [(a, b, c) for a, b, c, _ in out] == [(1, 1, "One"), (2, 1, "One > Two"), (3, 2, "One > Two"), (4, 2, "One > Two")]
    assert out[0][3] == "# One\n\nalpha" and out[3][3] == ("word " * 3000).strip()


def test_anchored_heading_keeps_its_paragraph(spark):
    text = "# Head\n\n" + "x" * 4000 + "\n\ntail"
    own = chunks.blocks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t")
    assert [len(r[0]) for r in rows(chunks.chunk(own).orderBy("chunk_no"), "content")] == [6, 4000, 4]
    assert [len(r[0]) for r in rows(chunks.chunk(own, "chunk-policy-v2-heading-anchored").orderBy("chunk_no"), "content")] == [4008, 4]


def test_repeated_edges(spark):
    docs = spark.createDataFrame([(1, "Head\na\nFoot\fHead\nb\nFoot"), (2, "x\fy")], "id long, t string")
    assert sorted(rows(chunks.edge_lines(docs, "id", "t"), "doc_id", "edge", "line")) == [(1, "footer", "Foot"), (1, "header", "Head")]
    assert chunks.edge_lines(docs, "id", "t", 3).count() == 0


def channel(spark, name, *ids):
    return fusion.channel(spark.createDataFrame([("WIKI", i, 1.0 / (n + 1)) for n, i in enumerate(ids)], "kind string, stable_id string, score double"), name)


def test_reciprocal_rank_fusion(spark):
    out = {r["stable_id"]: r["score"] for r in fusion.fuse([channel(spark, "LEXICAL", "exact", "shared"), channel(spark, "VECTOR", "shared", "semantic")]).collect()}
    assert out == {"shared": round(1 / 62 + 1 / 61, 12), "exact": round(1 / 61, 12), "semantic": round(1 / 62, 12)}


def test_fusion_ties_and_weights(spark):
    same = spark.createDataFrame([("WIKI", "b", 1.0), ("WIKI", "a", 1.0), ("WIKI", "a", 1.0), ("SOURCE_CHUNK", "a", 1.0)], "kind string, stable_id string, score double")
    assert rows(fusion.fuse([fusion.channel(same, "LEXICAL")]), "kind", "stable_id") == [("SOURCE_CHUNK", "a"), ("WIKI", "a"), ("WIKI", "b")]
    damped = fusion.fuse([channel(spark, "GRAPH", "g")], policy=fusion.FUSION["fusion-rrf-v2-graph-damped"]).first()
    assert damped["score"] == round(0.75 / 61, 12)


def test_rerank(spark):
    items = spark.createDataFrame([("a", 1, "other", "nothing"), ("b", 2, "ERR-1234 guide", "about ERR-1234")], "stable_id string, rank int, title string, content string")
    assert rows(fusion.rerank(items, "fix ERR-1234").orderBy("reranked"), "stable_id") == [("b",), ("a",)]
    assert rows(fusion.rerank(items.limit(1), "fix"), "reranked") == [(1,)]


def test_quality(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, stable_id string, rank int")
    truth = spark.createDataFrame([("q", "b"), ("q", "z"), ("r", "b")], "query_id string, stable_id string")
    assert sorted(rows(fusion.quality(ranked, truth, 2))) == [("q", 0.5, 0.5, 0.5), ("r", 0.0, 0.0, 0.0)]


def test_vectors(spark):
    p = spark.createDataFrame([("2", "WIKI", [1.0, 0.0]), ("10", "WIKI", [1.0, 0.0]), ("3", "SOURCE_CHUNK", [0.0, 1.0]), ("4", "WIKI", [1.0])], "stable_id string, kind string, embedding array<double>")
    assert rows(vector.nearest(p, [1.0, 0.0], 5), "stable_id") == [("10",), ("2",), ("3",)]
    assert rows(vector.candidates(p, p.where("stable_id <> '10'"), [1.0, 0.0], 1), "stable_id") == [("2",)]


def graph_of(spark, *pairs):
    return spark.createDataFrame([(f"{a}{b}", "LINKS_TO", a, b) for a, b in pairs], "relation_id string, relation_type string, source_id string, target_id string")


def test_bounded_traversal(spark):
    edges = graph_of(spark, ("s", "a"), ("s", "b"), ("a", "c"), ("c", "d"), ("b", "s"))
    out = graph.traverse(edges, ["s"])
    assert [(c[1], c[2]) for c in out.candidates] == [("a", 1), ("b", 1), ("c", 2)] and out.limits == {"DEPTH"}
    assert out.visited_edges == 4 and out.visited_nodes == 4
    narrow = graph.traverse(edges, ["s"], bounds=graph.Bounds(per_node=1))
    assert [c[1] for c in narrow.candidates] == ["a", "c"] and "PER_NODE_FAN_OUT" in narrow.limits
    few = graph.traverse(edges, ["s"], bounds=graph.Bounds(candidates=1))
    assert [c[1] for c in few.candidates] == ["a"] and few.limits == {"CANDIDATES"}
    assert sorted(rows(graph.reachable(edges, spark.createDataFrame([("s",)], "entity_id string"), 3), "entity_id", "depth")) == [("a", 1), ("b", 1), ("c", 2), ("d", 3), ("s", 0)]


def test_fingerprint_ignores_order(spark):
    a = graph_of(spark, ("a", "b"), ("b", "c"))
    assert graph.fingerprint(a, "source_id", "target_id").first() == graph.fingerprint(a.orderBy(F.desc("source_id")).repartition(3), "source_id", "target_id").first()


def test_revalidation_ladder(spark):
    c = spark.createDataFrame([("1", 1, "h", 1), ("2", 1, "h", 1), ("3", 1, "old", 1), ("4", 2, "h", 1), ("5", 1, "h", 1)], "stable_id string, workspace_id int, content_hash string, revision int")
    a = spark.createDataFrame([("1", "h", 1, True), ("3", "h", 1, True), ("4", "h", 1, True), ("5", "h", 1, False)], "stable_id string, content_hash string, revision int, eligible boolean")
    got = {r["stable_id"]: r["rejection"] for r in evidence.revalidated(c, a, 1).collect()}
    assert got == {"1": None, "2": "AUTHORITY_MISSING", "3": "STALE_REVISION", "4": "WORKSPACE_MISMATCH", "5": "INELIGIBLE"}


def test_budget_and_packing(spark):
    items = spark.createDataFrame([("a", 1, "x" * 10), ("a", 2, "again"), ("b", 3, "y" * 10), ("c", 4, "z")], "stable_id string, rank int, content string")
    out = rows(evidence.budgeted(items, 8, 15).orderBy("rank"), "stable_id", "evidence", "truncated")
    assert out == [("a", "x" * 10, False), ("b", "y" * 5, True)]
    packed = evidence.packed(items, 8, 4, 10)
    assert rows(packed.orderBy("rank"), "citation_id", "block") == [("E1", "xxxx"), ("E2", "yyyy"), ("E3", "z")]
    blank = spark.createDataFrame([("a", 1, " "), ("b", 2, "y")], "stable_id string, rank int, content string")
    assert evidence.budgeted(blank).count() == 0
    text = packed.groupBy().agg(F.collect_list(F.struct("citation_id", "stable_id", "block")).alias("blocks")).select(evidence.serialized("blocks", "q?")).first()[0]
    assert json.loads(text)["evidence"][0] == {"id": "E1", "identity": "a", "content": "xxxx"}


def test_lint(spark):
    pages = spark.createDataFrame(
        [(1, "k1", "One", ["two", "gone", "one"], "VALID", 7), (2, "k2", "Two", [], "VALID", 8), (3, "k3", "Three", ["one"], "INVALID", None)],
        "page_id long, knowledge_id string, title string, targets array<string>, content_status string, proposal_id long",
    )
    found = sorted(rows(wiki.lint(pages, spark.createDataFrame([(7,)], "proposal_id long")), "knowledge_id", "code"))
    assert found == [("k1", "BROKEN_INTERNAL_LINK"), ("k1", "ORPHAN_PAGE"), ("k2", "DANGLING_PROVENANCE"), ("k3", "CANONICAL_CONTENT_INVALID"), ("k3", "ORPHAN_PAGE")]


def test_status_fold_and_diff(spark):
    events = spark.createDataFrame([(1, 1, "DRAFT", "REVIEW"), (1, 2, "DRAFT", "REJECTED"), (1, 3, "REVIEW", "APPROVED"), (2, 1, "DRAFT", "APPROVED")], "p int, n int, from_status string, to_status string")
    assert sorted(rows(wiki.current_status(events, "p", "n"))) == [(1, "APPROVED"), (2, "DRAFT")]
    out = spark.createDataFrame([("a\nb", "a\nc")], "x string, y string").select(wiki.diff("x", "y")).first()[0]
    assert "-b" in out and "+c" in out


def test_health_and_generations(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, h string")
    p = spark.createDataFrame([(1, "x"), (2, "old"), (9, "w")], "id int, h string")
    assert tuple(lifecycle.index_health(a, p, "id", ("h",)).first()) == (3, 1, 1, 1, 0, "REBUILD_REQUIRED")
    assert lifecycle.index_health(a, a, "id", ("h",)).first()["status"] == "HEALTHY"
    ops = spark.createDataFrame([(1, "S", 2, "READY"), (1, "S", 1, "FAILED")], "workspace_id int, corpus string, generation int, state string")
    assert rows(lifecycle.latest_generation(ops)) == [(1, "S", 2, "READY")]
    assert sorted(rows(lifecycle.upsert(a, p.limit(1).withColumn("h", F.lit("new")), "id"))) == [(1, "new"), (2, "y"), (3, "z")]


def test_inbox_scan_and_stream(spark, tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    (folder / "a.txt").write_text("First\n\nSecond")
    (folder / "b.txt").write_text("First\n\nSecond")
    (folder / "c.bin").write_bytes(b"\x00")
    found = files.scan_inbox(spark, str(folder))
    assert sorted(rows(files.extracted(found), "file_name", "parse_status")) == [("a.txt", "PROCESSED"), ("b.txt", "PROCESSED"), ("c.bin", "UNSUPPORTED")]
    known = spark.createDataFrame([("inbox/gone.txt", "zz", "PENDING")], "source_path string, sha256 string, status string")
    assert sorted(rows(files.rescan(found, known))) == [("inbox/a.txt", "new"), ("inbox/b.txt", "duplicate"), ("inbox/c.bin", "new"), ("inbox/gone.txt", "removed")]
    (folder / "c.bin").unlink()
    for _ in range(2):
        inbox.run(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(rows(inbox.table(spark, str(tmp_path / "out"), "documents"), "status")) == [("DUPLICATE",), ("PENDING",)]
    assert inbox.table(spark, str(tmp_path / "out"), "chunks").count() == 1
