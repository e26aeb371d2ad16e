"""The queries of the dealt operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import bm25_packing, bpe_transducer, conversation_repair, debruijn_dedup, html_wrapper, license_rules, mpeg_ts, multi_index_ann, shared, simhash_bktree, spelling_variants, token_rollup, toxicity_nbsvm, url_trust


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_text(_table(spark, sf_dir, "pages"))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(_table(spark, sf_dir, "documents"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bktree.groups(_table(spark, sf_dir, "documents"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: words and pieces are inserted; words are counted anew, without
    those that hold no letter or digit; copies of a text of a smaller id are deleted. Two batches come twice. A null
    text counts no tokens and is no copy; a row without an id is no copy either; repeated rows count as often as they
    occur; an empty table has no totals. Extra columns are ignored."""
    documents = _table(spark, sf_dir, "documents")
    counts = documents.select(
        "doc_id", "source", "lang", F.md5("text").alias("digest"),
        token_rollup.word_count().alias("words"), token_rollup.spelled_count().alias("spelled"), token_rollup.piece_count().alias("pieces"),
    )
    counts = shared.written(counts, "token-counts")
    first = counts.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id <> last_id")
    first = shared.written(first, "first-copies")  # a table, so that the join can be split where one text has very many copies
    copies = shared.written(counts.join(first, "digest").where("doc_id > first_id"), "copies")
    rollup = token_rollup.Rollup(spark, f"{shared.scratch_dir(spark)}/loreweave-rollup-{uuid.uuid4().hex}")
    words, pieces = token_rollup.inserted(counts, F.col("words"), "words"), token_rollup.inserted(counts, F.col("pieces"), "pieces")
    revised = token_rollup.revised(counts, F.col("words"), F.col("spelled"), "words")
    gone = token_rollup.deleted(copies, F.col("spelled"), "words").unionByName(token_rollup.deleted(copies, F.col("pieces"), "pieces"))
    for batch, changes in (("load-words", words), ("load-pieces", pieces), ("load-words", words), ("revise-words", revised), ("drop-copies", gone)):
        rollup.commit(batch, changes)
    rollup.compact()
    rollup.commit("revise-words", revised)
    return rollup.totals()


def op5_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_ts.features(mpeg_ts.store(_table(spark, sf_dir, "documents")))


def op6_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_nbsvm.fit(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity_nbsvm.score(documents, model)
    return scored.select("doc_id", F.coalesce(toxicity_nbsvm.held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("loreweave_toxicity").alias("score"), F.col("loreweave_toxic").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = debruijn_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.col("loreweave_words").alias("n_words"), F.col("loreweave_removed").alias("n_removed"), F.col("loreweave_sha256").alias("kept_sha256"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.vocabulary(_table(spark, sf_dir, "documents"), drop_every=31)
    return spelling_variants.variants(words)


URL_RULES = [
    url_trust.Rule("allow", "org", "/"),
    url_trust.Rule("block", "example.org", "/es/"),
    url_trust.Rule("block", "example.org", "/en/1"),
    url_trust.Rule("allow", "com", "/fr/"),
    url_trust.Rule("block", "com", "/de/"),
]


def op12_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults by the CRC-32 of ``conv_id:turn``, nulls being a space: of 20 rows one is dropped,
    one emptied, one loses its sentence ends, one is repeated and one becomes the user's."""
    spaced = {name: F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn", "role", "text")}
    rows = conversations.select(
        "conv_id", "turn", spaced["role"].alias("role"), spaced["text"].alias("text"),
        (F.crc32(F.concat_ws(":", spaced["conv_id"], spaced["turn"])) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    rows = rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("copy"))
    return rows.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    rows = conversation_repair.ordered(damaged(conversations))
    audits = shared.written(conversation_repair.audits(rows), "audits")
    digests = conversation_repair.digests(conversation_repair.repaired(rows, audits)).withColumnRenamed("conv_id", "hashed")
    found = audits.drop("roles", "signature").withColumnRenamed("conv_id", "own")
    everyone = conversations.select("conv_id").distinct()
    out = everyone.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").join(digests, F.col("conv_id").cast("string").eqNullSafe(F.col("hashed")), "left")
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_html_wrapper": op1_html_wrapper,
        "op2_license_rules": op2_license_rules,
        "op3_simhash_groups": op3_simhash_groups,
        "op4_token_rollup": op4_token_rollup,
        "op5_mpeg_ts": op5_mpeg_ts,
        "op6_bm25_packing": op6_bm25_packing,
        "op7_multi_index": op7_multi_index,
        "op8_toxicity": op8_toxicity,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_bpe_codec": op10_bpe_codec,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_url_trust": op12_url_trust,
        "op13_conversation_repair": op13_conversation_repair,
        "pipeline": pipeline,
    }


_TOKEN_ROLLUP = r"""
WITH counts AS (
  SELECT doc_id, source, lang, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS spelled_all,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D\p{L}\p{N}]*[\p{L}\p{N}][^\x20\x09-\x0D]*')), 0) AS words,
         coalesce(len(regexp_extract_all(text, '\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+')), 0) AS pieces,
         min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM documents),
kept AS (SELECT * FROM counts WHERE text IS NULL OR doc_id IS NULL OR doc_id = first_id)
SELECT source, lang, 'words' AS tokenizer, CAST(count(*) AS BIGINT) AS documents, CAST(sum(words) AS BIGINT) AS tokens FROM kept GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces', CAST(count(*) AS BIGINT), CAST(sum(pieces) AS BIGINT) FROM kept GROUP BY source, lang
"""


def oracle_sql() -> dict:
    return {
        "op2_license_rules": license_rules.oracle(),
        "op4_token_rollup": _TOKEN_ROLLUP,
        "op12_url_trust": url_trust.oracle(URL_RULES),
    }
