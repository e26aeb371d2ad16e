"""Each stage on its own input against brute force, with nulls, repeated rows and clashing columns."""

import public_tokenizers
import pytest
from helpers import EDGES, empty, frame, rows_of
from test_near_copies import slow_survivors, survivors
from test_substring import passages, slow
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from loreweave.llm import toxicity_nbsvm

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs():
    return passages() + [x for x in EDGES if len(x[1] or "") < 60_000]


def test_toxicity_stage(spark, sf_dir, docs):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = STAGES["toxicity"](spark, own, sf_dir)
    model = toxicity_nbsvm.fit(own, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = sorted((r["doc_id"], r["text"]) for r in own.collect() if model.scores([r["text"]])[0] < 0.7)
    assert 0 < len(want) < own.count()
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == want and kept.columns == own.columns
    edges = STAGES["toxicity"](spark, frame(spark, docs), sf_dir)
    assert edges.columns == frame(spark, docs).columns and set(map(tuple, edges.collect())) <= set(rows_of(docs))


def test_near_copies_stage(spark, sf_dir, docs):
    kept = STAGES["simhash_near_dedup"](spark, frame(spark, docs), sf_dir)
    assert kept.columns == frame(spark, docs).columns
    assert survivors(kept.collect()) == slow_survivors(docs)


def test_repeats_stage(spark, sf_dir, docs):
    rows = STAGES["substring_dedup"](spark, frame(spark, docs), sf_dir).collect()
    assert len(rows) == len(docs)
    removed = {d for d, _, n, _ in slow(docs) if n}
    before = {}
    for d, t in docs:
        before.setdefault(d, []).append(t)
    for r in rows:
        if r["doc_id"] not in removed:
            assert r["text"] in before[r["doc_id"]]
    left = sum(len((r["text"] or "").encode().split()) for r in rows)
    assert left == sum(n * (words - gone) for (_, words, gone, _), n in slow(docs).items())


def test_packing_stage(spark, sf_dir, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    pieces = STAGES["packing"](spark, frame(spark, docs), sf_dir)
    assert "ids" not in pieces.columns and pieces.groupBy().sum("length").first()[0] == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, sf_dir, name):
    assert STAGES[name](spark, empty(spark), sf_dir).count() == 0


def test_run_and_registration(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "packing"]
    names = set(__spark_entry__.queries())
    assert {"pipeline"} < names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert __spark_entry__.queries()["pipeline"](spark, sf_dir).count() > 0
