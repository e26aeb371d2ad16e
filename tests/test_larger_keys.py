import duckdb

from loreweave.operators import chunks, graph, lexical
from loreweave.plans import catalog, published_queries
from loreweave.sources import snapshots


def equals_its_sql(spark, folder, name, **tables):
    """A query over these tables (as SQL that makes them) against its SQL."""
    con = duckdb.connect()
    for table, made in tables.items():
        con.execute(f"CREATE TABLE {table} AS {made}")
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    own = catalog.queries()[name](spark, str(folder))
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, own.select(*names).collect())) == sorted(f"Row({', '.join(f'{n}={v!r}' for n, v in zip(names, r, strict=True))})" for r in want.fetchall())


def test_admission_of_orders_a_million_apart(spark, sf_dir, tmp_path):
    of = lambda t: f"SELECT * FROM '{sf_dir}/{t}.parquet'"
    orders = f"{of('orders')} UNION ALL SELECT * REPLACE (o_orderkey + 1000000 AS o_orderkey) FROM '{sf_dir}/orders.parquet'"
    equals_its_sql(spark, tmp_path, "graph_admission", orders=orders, customer=of("customer"), part=of("part"), nation=of("nation"))


def test_ids_are_made_after_repeats_are_gone(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "a long, b long")
    own = graph.edges(1, "CONTAINS", pairs, ("SOURCE_DOCUMENT", "a"), ("SOURCE_CHUNK", "b"))
    nodes = graph.vertices(1, SOURCE_DOCUMENT=(pairs, "a"))
    for rows, n in ((own, 2), (nodes, 1)):
        shuffled = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
        assert shuffled and not any("_id" in line.split("], [")[0] for line in shuffled) and rows.count() == n
    twice = graph.defects(nodes.unionByName(nodes), own.unionByName(own.limit(1)))
    assert sorted(r["defect"] for r in twice.collect()) == ["DUPLICATE_ENTITY", "DUPLICATE_RELATION", "ORPHAN_RELATION", "ORPHAN_RELATION"]


def test_packed_ids_come_back(spark):
    given = [None, "", "gr1_" + "0f" * 32, "gr1_" + "0F" * 32, "gr1_" + "0f" * 32 + "\n", "é" * 4 + "0f" * 32, "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    packed = snapshots._packed(rows)
    assert [t for _, t in sorted(map(tuple, snapshots._unpacked(packed, rows.schema).collect()))] == given
    assert packed.where("i = 2").selectExpr("length(t)").first()[0] == 37


def test_index_takes_as_many_tasks_as_its_texts_need(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lexical.FtsIndex, "TASK_BYTES", 2000)
    rows = spark.createDataFrame([(i, f"a{i % 7} b a{i % 7} " * 20, "b") for i in range(400)], "id long, body string, more string")
    own = lexical.FtsIndex(spark, str(tmp_path / "fts"), ["body", "more"])
    own.upsert(rows, "id")
    tasks = {p.name.split("-")[1] for p in (tmp_path / "fts").glob("data/*/postings/bucket=*/part-*.parquet")}
    assert len(tasks) > 4 * spark.sparkContext.defaultParallelism
    assert {(r["tf0"], r["tf1"], r["len"]) for r in own.postings(["b"]).collect()} == {(20, 1, 61)} and own.postings(["b"]).count() == 400


def test_whole_documents_reach_python_few_at_a_time(spark):
    blocks = chunks.blocks(spark.createDataFrame([(i, "x\n\ny") for i in range(3)], "id long, text string"), "id", "text")
    assert chunks.chunk(blocks).count() == 3
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) < 10_000


def test_files_are_checked_by_all_cores(spark, sf_dir):
    pages, files = published_queries._files(spark, sf_dir)
    assert pages.rdd.getNumPartitions() == files.rdd.getNumPartitions() == 4
