import hashlib
from collections import Counter

from helpers import EDGES, empty, frame, prose

from loreweave.llm import debruijn_dedup as D


def slow(docs, k=13):
    """Every window of every document, in one table."""
    split = [(t or "").encode().split() for _, t in docs]
    least = {}
    for (doc, _), words in zip(docs, split):
        for i in range(len(words) - k + 1):
            key = tuple(words[i : i + k])
            if doc is not None:
                least[key] = min(doc, least.get(key, doc))
    out = Counter()
    for (doc, _), words in zip(docs, split):
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            if doc is not None and least[tuple(words[i : i + k])] < doc:
                gone[i : i + k] = [True] * k
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[(doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def result(df):
    return Counter((r["doc_id"], r["loreweave_words"], r["loreweave_removed"], r["loreweave_sha256"]) for r in df.collect())


def passages():
    shared = [prose(1000 + i, 60) for i in range(4)]
    docs = [(10 + i, " ".join([prose(i, 40), shared[i % 4], prose(50 + i, 30), shared[(i + 1) % 4] if i % 2 else ""])) for i in range(24)]
    docs += [(60, shared[0]), (61, " ".join(shared[0].split()[:13])), (62, " ".join(shared[0].split()[:12])), (63, shared[1] + " " + shared[1])]
    docs += [(70, "a " * 40), (71, "a " * 20), (72, "b " + "a " * 13 + "c"), (73, "a " * 12), (9, "a b " * 30), (74, "b a " * 30)]
    return docs + [(64, docs[0][1]), (65, docs[0][1]), (65, docs[0][1]), (66, docs[1][1] + " tail"), (66, docs[2][1]), (None, docs[0][1])]


def test_equals_brute_force(spark):
    docs = passages() + EDGES
    want = slow(docs)
    assert sum(n for (_, _, removed, _), n in want.items() if removed) > 15
    assert result(D.remove_repeats(frame(spark, docs))) == want


def test_equals_brute_force_on_test_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert result(D.remove_repeats(docs)) == slow([tuple(r) for r in docs.collect()])


def test_columns_and_empty_table(spark):
    docs = frame(spark, passages())
    assert D.remove_repeats(docs).columns[: len(docs.columns)] == docs.columns
    assert D.remove_repeats(empty(spark)).count() == 0


def test_spans_are_compared_with_the_words_of_their_source(spark):
    """Paths come with the words at their source's coordinates; one whose words differ there removes nothing."""
    docs = frame(spark, [(5, "x " + " ".join(f"w{i}" for i in range(30))), (8, " ".join(f"w{i}" for i in range(30)) + " y"), (5, "another row of that id")])
    spans = D.repeated_spans(docs)
    (row,) = D.with_source_words(spans, docs).collect()
    (span,) = row["spans"]
    assert (row["doc"], span["start"], span["windows"], span["words"]) == (8, 0, 18, " ".join(f"w{i}" for i in range(30)))
    words = docs.where("doc_id = 8").first()["text"].encode().split()
    assert D._covered(words, [span], 13).tolist() == [True] * 30 + [False]
    assert not D._covered(words, [{**span.asDict(), "words": span["words"].replace("w7", "w77")}], 13).any()
    moved = spans.withColumn("source_slot", spans["source_slot"] - 1)  # wrong coordinates: the words there are others
    (wrong,) = D.with_source_words(moved, docs).collect()
    assert not D._covered(words, wrong["spans"], 13).any()
