import math
import zlib
from collections import Counter

import pytest
from helpers import EDGES, empty, frame
from pyspark.sql import functions as F

from loreweave.llm import toxicity_nbsvm as X

LABELS = "doc_id long, quality int, toxic int, text string"


def is_held_out(doc):
    return zlib.crc32(str(doc).encode()) % 3 == 1


def auc(scored):
    ranked = sorted(scored)
    positives = [i for i, (_, y) in enumerate(ranked) if y]
    n, m = len(positives), len(ranked) - len(positives)
    return (sum(positives) - n * (n - 1) / 2) / (n * m)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = X.fit(docs.select("doc_id", "text"), labels)
    scored = X.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(X.held_out("doc_id")).select("loreweave_toxicity", "loreweave_toxic", "toxic").collect()
    assert auc([(r[0], r[2]) for r in scored]) >= 0.97
    clean, toxic = ([r for r in scored if r[2] == y] for y in (0, 1))
    assert sum(r[1] for r in clean) <= 0.02 * len(clean) and sum(r[1] for r in toxic) >= 0.8 * len(toxic)


def corpus():
    return [(i, ("you vile stupid idiot number " if i % 2 else "a calm and pleasant evening number ") + str(i)) for i in range(200)]


def test_held_out_labels_are_never_read(spark):
    docs, labels = frame(spark, corpus()), [(i, 1, i % 2, None) for i in range(200)]
    turned = [(i, q, 1 - t if is_held_out(i) else t, x) for i, q, t, x in labels]
    a, b = (X.fit(docs, spark.createDataFrame(rows, LABELS)) for rows in (labels, turned))
    assert (a.slots == b.slots).all() and (a.weights == b.weights).all() and a.bias == b.bias
    got = X.score(docs, a).select("doc_id", "loreweave_toxicity", X.held_out("doc_id").alias("h")).collect()
    assert all((r["loreweave_toxicity"] >= 0.5) == (r["doc_id"] % 2 == 1) and r["h"] == is_held_out(r["doc_id"]) for r in got)


def test_the_ratio_of_an_ngram_orders_scores(spark):
    docs, labels = frame(spark, corpus()), spark.createDataFrame([(i, 1, i % 2, None) for i in range(200)], LABELS)
    model = X.fit(docs, labels)
    low, mid, high = model.scores(["a calm and pleasant evening", "zzz", "you vile stupid idiot"])
    assert low < mid < high


@pytest.mark.parametrize("labels", [[], [(1, 1, 1, None)], [(None, 1, 1, None), (3, 1, None, None)], [(4, 1, 1, None), (4, 1, 0, None), (6, 0, 0, None)]])
def test_few_labels_and_edges(spark, labels):
    docs = frame(spark, EDGES)
    model = X.fit(docs, spark.createDataFrame(labels, LABELS))
    rows = X.score(docs, model)
    assert rows.columns[: len(docs.columns)] == docs.columns
    assert rows.count() == len(EDGES) and rows.where((F.col("loreweave_toxicity") >= 0) & (F.col("loreweave_toxicity") <= 1)).count() == len(EDGES)
    assert X.score(empty(spark), model).count() == 0


def slow_buckets(text):
    """The buckets of a text's n-grams, with plain integers."""
    text, out = f" {text.lower()} ", []
    for n in X.SIZES:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
            h ^= n * 0x9E3779B1 & 0xFFFFFFFF
            h = h * 0x85EBCA6B & 0xFFFFFFFF
            out.append((h ^ h >> 15) & (X.BUCKETS - 1))
    return out


PIECES = ["", "a", "Füße İx", "abcdefg" * 9, "你好吗 ok" * 5, "tail"]


@pytest.mark.parametrize("size", [1, 2, 5, 13, 64, 1 << 20])
def test_pieces_hold_every_ngram_once(size):
    found = {}
    for buffer in X._buffers(PIECES, size):
        for buckets, inside in buffer.grams():
            at = inside.nonzero()[0]
            for row, bucket in zip(buffer.rows_at(at).tolist(), buckets[at].tolist(), strict=True):
                found.setdefault(row, []).append(bucket)
    assert {row: sorted(found.get(row, [])) for row in range(len(PIECES))} == {row: sorted(slow_buckets(t)) for row, t in enumerate(PIECES)}


def test_ratios_and_features_equal_plain_counts(spark):
    """The kept buckets are those of the largest gain, and what a feature adds is its weight times its log-count ratio."""
    docs, labels = corpus(), [(i, 1, i % 2, None) for i in range(200)]
    limits = X.FitLimits(features=40)
    model = X.fit(frame(spark, docs), spark.createDataFrame(labels, LABELS), limits)
    counts = [Counter(), Counter()]
    for i, text in docs:
        if not is_held_out(i):
            counts[i % 2].update(slow_buckets(text))
    known = set(counts[0]) | set(counts[1])
    share = [{b: (c[b] + 1) / (sum(c.values()) + len(known)) for b in known} for c in counts]
    ratio = {b: math.log(share[1][b]) - math.log(share[0][b]) for b in known}
    gain = {b: abs(ratio[b] * (share[1][b] - share[0][b])) for b in known}
    kept = set(model.slots.nonzero()[0].tolist())
    least = min(gain[b] for b in kept)
    assert len(kept) == 40 and all(gain[b] <= least + 1e-12 for b in known - kept)
    for text in (docs[0][1], docs[1][1], "number"):
        z = model.bias + sum(model.weights[model.slots[b]] for b in set(slow_buckets(text)) & kept)
        assert abs(model.scores([text])[0] - 1 / (1 + math.exp(-z))) < 1e-9
    for b in kept:  # a feature's weight has the sign of its ratio or nothing of it: classes are told apart by their words
        assert model.weights[model.slots[b]] * ratio[b] >= -1e-6
