import math
import random

import pytest
from pyspark.sql import functions as F

from loreweave.llm import multi_index_ann as A

SCHEMA = "vec_id long, embedding array<float>, label int, entry long, cell int"


def brute(rows, is_query, k=20):
    """Every query against every row, in double precision."""
    fine = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in fine.items():
        if is_query(q):
            scored = sorted((-_product(a, b), i) for i, b in fine.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def _product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def clusters(n, seed=1, width=16):
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    points = (centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, width))).astype("float32")
    return [(i, [float(x) for x in p]) for i, p in enumerate(points)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, 7, 7) for i, v in rows], SCHEMA)


def test_recall_and_scores(spark):
    rows = clusters(1500)
    limits = A.IndexLimits(sample_rows=600, sample_queries=60, most_centroids=8, least_centroids=8, block_rows=128)
    got = {}
    for r in A.search(frame(spark, rows), F.col("vec_id") % 20 == 0, limits=limits).collect():
        got.setdefault(r["query_id"], []).append(r)
    want = brute(rows, lambda i: i % 20 == 0)
    vectors = dict(rows)
    hits = 0
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(r["score"] == _product(vectors[q], vectors[r["vec_id"]]) for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        hits += len({r["vec_id"] for r in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_copies_ties_and_rows_left_out(spark):
    one = [1.0, 0.5, 0.0, 2.0]
    rows = [(i, one) for i in range(60)] + [(100 + i, [float(i % 3), 1.0, 0.0, 1.0]) for i in range(30)]
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 1.0, 1.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0, 1.0]), (300, []), (None, one), (320, [1.0])]
    random.Random(3).shuffle(rows)
    got = {}
    for r in A.search(frame(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    rows = [x for x in rows if x[0] != 320]
    assert got == brute(rows, lambda i: i % 20 == 0)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (20, [1.0, 1.0])]])
def test_few_rows(spark, rows):
    got = {}
    for r in A.search(frame(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: v for q, v in brute(rows, lambda i: i % 20 == 0).items() if v}


def test_recall_on_test_data(spark):
    """The table of the query at a scale that fits brute force, with the production parameters."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 20 == 0)
    got = {}
    for r in A.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(got[q] & {i for i, _ in v}) for q, v in want.items()]
    assert all(len(v) == 20 for v in got.values()) and sum(hits) / (20 * len(want)) >= 0.9
