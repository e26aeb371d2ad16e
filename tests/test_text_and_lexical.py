import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.functions import vectors as V
from loreweave.operators import lexical
from loreweave.sources import snapshots


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("全文搜尋", ["全文", "文搜", "搜尋"]),
        ("甲", ["甲"]),
        ("系統SpringBoot與jOOQ全文搜尋", ["系統", "springboot", "與", "jooq", "全文", "文搜", "搜尋"]),
        ("Café 全文", ["café", "全文"]),
        ("", []),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, X.tokens(X.nfc(F.lit(text)))) == expected
    assert lexical.query_tokens(text) == expected


def test_projection_of_null_is_null(spark):
    assert one(spark, X.projected(F.lit(None).cast("string"))) is None


def test_index_tokens_fold_accents(spark):
    assert one(spark, X.index_tokens(F.lit("Café ÉCOLE übung 全文"))) == ["cafe", "ecole", "ubung", "全文"]
    assert one(spark, X.index_tokens(F.lit("Café ÉCOLE übung"))) == ["cafe", "ecole", "ubung"]


def test_match_expression_bounds():
    assert lexical.match_expression('" OR 1=1 --') == '"or" AND "1" AND "1"'
    assert len(lexical.query_terms("甲" * 65)) == 64
    for bad in ("甲" * 66, "a" * 257, "  ", "a\x00b", "!!"):
        with pytest.raises(ValueError):
            lexical.query_terms(bad)


@pytest.mark.parametrize(
    ("query", "expected"),
    [("busy_timeout 這個設定要怎麼調整", "busy_timeout"), ("busy_timeout", None), ("pkg.name busy_timeout 怎麼設定", "pkg.name busy_timeout"), ("", None)],
)
def test_fallback_by_technical_words(query, expected):
    assert lexical.fallback_query(query, set()) == expected


def test_fallback_by_vocabulary():
    assert lexical.fallback_query("alpha beta gamma", {"alpha", "gamma"}) == "alpha gamma"
    assert lexical.fallback_query("alpha beta", {"alpha"}) == "alpha"
    assert lexical.fallback_query("abc beta", {"abc"}) is None
    assert lexical.fallback_query("alpha beta", {"alpha", "beta"}) is None


def test_bm25_repeated_terms_and_weights(spark):
    docs = spark.createDataFrame([(1, "by", "by from by"), (2, "x", "by the from"), (3, "y", "none"), (4, "z", "nothing"), (5, "w", "at all")], "id long, title string, body string")
    plain = {r["doc_id"]: r["bm25"] for r in lexical.bm25(docs, "id", {"body": 1.0}, "by from").collect()}
    assert set(plain) == {1, 2} and plain[1] < plain[2] < 0
    twice = {r["doc_id"]: r["bm25"] for r in lexical.bm25(docs, "id", {"body": 1.0}, "by by from").collect()}
    assert twice[2] < plain[2]
    weighted = {r["doc_id"]: r["bm25"] for r in lexical.bm25(docs, "id", {"title": 8.0, "body": 1.0}, "by from").collect()}
    assert weighted[1] < plain[1]
    assert lexical.bm25(docs.limit(0), "id", {"body": 1.0}, "by").count() == 0


def test_postings_agree_with_the_scan(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "B c")], "id long, body string")
    rows = {(r["doc_id"], r["term"]): (r["tf"], r["doc_len"]) for r in lexical.postings(docs, "id", "body").collect()}
    assert rows == {(1, "a"): (2, 3), (1, "b"): (1, 3), (3, "b"): (1, 2), (3, "c"): (1, 2)}


def test_snippet_escapes_marks_and_bounds():
    assert lexical.snippet_text("a <b> by & by", "by") == "a &lt;b&gt; <mark>by</mark> &amp; <mark>by</mark>"
    assert "<mark>" not in lexical.snippet_text("bypass", "by")
    long = "x " * 500 + "needle" + " y" * 500
    cut = lexical.snippet_text(long, "needle")
    assert cut.startswith("…") and cut.endswith("…") and "<mark>needle</mark>" in cut
    assert len(cut.replace("<mark>", "").replace("</mark>", "")) == 282


def test_normalized_text(spark):
    text = "﻿a​b﻿ \t\r\nc\x07\r\n\r\n\r\n\r\nd"
    assert one(spark, X.normalized(F.lit(text))) == "﻿ab\nc\n\nd"


def test_titles_tags_links_and_paths(spark):
    assert one(spark, X.title_key(F.lit("  Two\t Words "))) == "two words"
    assert one(spark, X.slug(F.lit("Spring  Boot 3!"))) == "spring-boot-3"
    assert one(spark, X.slug(F.lit("!!"))) is None
    assert one(spark, X.wiki_path(F.lit("CONCEPT"), F.lit("A b"))) == "vault/concepts/a-b.md"
    assert one(spark, X.tags(F.array(*[F.lit(x) for x in (" B", "a  c", "b", "", "x" * 81)]))) == ["a c", "b"]
    assert one(spark, X.wikilinks(F.lit("[[A|x]] [[ b ]] [[a]]"))) == ["a", "b"]


def test_redaction(spark):
    clean = lambda s: one(spark, X.redacted(F.lit(s), "fallback"))
    assert clean("token=abc done") == "token=[REDACTED] done"
    assert clean("at /home/me/file.txt end") == "at [REDACTED] end"
    assert clean("SELECT x FROM y") == "fallback"
    assert clean("   ") == "fallback"
    assert clean(None) == "fallback"


def test_length_prefix_counts_bytes(spark):
    assert one(spark, X.length_prefixed(F.lit("é"), F.lit(None))) == "2:é;0:;"


def test_cosine(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, V.cosine(a, F.array(F.lit(2.0), F.lit(0.0)))) == 1.0
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, V.similarity(F.lit(3.0))) == 0.0


def test_a_stored_index_is_replaced_by_document(spark, tmp_path):
    """Writes, deletions and a rebuild leave what an index of the documents that are left would find."""
    docs = [(1, "by from by"), (2, "by the from"), (3, "none"), (4, "by"), (5, None)]
    index = lexical.FtsIndex(spark, str(tmp_path / "fts"), ["body"])
    index.upsert(spark.createDataFrame(docs, "id long, body string"), "id")
    index.upsert(spark.createDataFrame([(2, "nothing here"), (6, "from by")], "id long, body string"), "id")
    index.delete(spark.createDataFrame([(1,), (99,)], "id long"), "id")
    left = spark.createDataFrame([(2, "nothing here"), (3, "none"), (4, "by"), (5, None), (6, "from by")], "id long, body string")
    want = sorted(map(tuple, lexical.bm25(left, "id", {"body": 1.0}, "by from").collect()))
    assert [d for d, _ in want] == [6] and sorted(map(tuple, index.search("by from").collect())) == want
    assert index.generations() == [1, 2, 3]
    index.rebuild(left, "id")
    index.vacuum()
    assert index.generations() == [4] and sorted(map(tuple, index.search("by from").collect())) == want
    assert index.search("absent by").count() == 0


def test_query_and_index_agree_on_han(spark):
    """Iteration marks, the zero and radicals are Han to both."""
    texts = ["人々の話", "二〇二四年", "⼀⼆", "全文搜尋 spring", "Cafe\u0301 ﬁx"]
    for text in texts:
        assert one(spark, X.tokens(X.nfc(F.lit(text)))) == lexical.query_tokens(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    assert [r["doc_id"] for r in lexical.bm25(docs, "id", {"body": 1.0}, "人々").collect()] == [0]
    assert [r["doc_id"] for r in lexical.bm25(docs, "id", {"body": 1.0}, "café").collect()] == [4]


def test_fallback_columns_equal_the_function(spark):
    terms = ["alpha", "gamma", "abc", "busy", "timeout", "x", "y"]
    asked = ["alpha beta gamma", "alpha beta", "abc beta", "alpha gamma", "x y z", "alpha alpha", "busy_timeout how", "pkg.name busy_timeout how ERR-1234", "", "  ", "one", "alpha Alpha beta", "KEY-123 key-123 b"]
    rows = spark.createDataFrame([(q, terms) for q in asked] + [(None, terms), ("alpha beta", None)], "q string, t array<string>")
    got = [(r["q"], r["t"], r["fallback"]) for r in lexical.fallback(rows, "q", "t").collect()]
    assert len({f for _, _, f in got}) > 4
    assert all(f == lexical.fallback_query(q, set(t or ())) for q, t, f in got)


def test_composed_titles(spark):
    assert one(spark, X.title_key(F.lit("Cafe\u0301  Bar"))) == "café bar"
    assert one(spark, X.slug(F.lit("Cafe\u0301 Bar"))) == "café-bar"
    assert one(spark, X.tags(F.array(F.lit("Cafe\u0301"), F.lit("café"), F.lit(None)))) == ["café"]
    assert one(spark, X.wikilinks(F.lit("[[Cafe\u0301]] [[café]] [[\u212b]]"))) == ["café", "å"]


def test_repeated_page_edges(spark):
    clean = lambda s, n=2: one(spark, X.normalized(F.lit(s), edges=True) if n == 2 else X.without_edges(F.lit(s), n))
    two = "Head\nFirst page\nFoot\fHead\nSecond page\nFoot"
    assert clean(two) == "First page\fSecond page"
    assert clean(two, 3) == two
    assert clean("only\nHead") == "only\nHead"
    assert clean("Head\f\n\fHead\nx") == "\f\n\fx"
    assert clean("a\nb\fb\na") == "a\nb\fb\na"
    assert one(spark, X.without_edges(F.lit(None).cast("string"))) is None


def fts5(docs, query):
    """Ids that SQLite's own index finds, over projected texts."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i, " ".join(lexical.query_tokens(x))) for i, x in docs])
    return [r[0] for r in con.execute("SELECT rowid FROM t WHERE t MATCH ? ORDER BY rowid", (lexical.match_expression(query),))]


SCRIPTS = ["한국어 문서", "データベース 入門", "ガイド", "हिन्दी पाठ", "Café Ångström", "Ελλάδα ΟΔΟΣ", "ЁЖ йод", "naïve ầ ş", "全文搜尋", "ไทย", "עברית", "İstanbul Straße", "x̌y"]


@pytest.mark.parametrize("query", ["한국어", "データベース", "ガイド", "हिन्दी", "cafe", "CAFÉ", "ångström", "ελλάδα", "οδος", "ёж", "ЙОД", "naive", "a", "Ş", "全文", "搜尋", "ไทย", "עברית", "istanbul", "straße", "Ελλαδα", "еж"])
def test_scripts_are_found_as_sqlite_finds_them(spark, query):
    docs = list(enumerate(SCRIPTS))
    decomposed = [(i, unicodedata.normalize("NFD", x)) for i, x in docs]
    want = fts5(docs, query)
    for rows, asked in ((docs, query), (decomposed, query), (docs, unicodedata.normalize("NFD", query))):
        index = lexical.FtsIndex.over(spark.createDataFrame(rows, "id long, body string"), "id", ["body"])
        assert sorted(r["doc_id"] for r in index.search(asked).collect()) == want


def test_one_fold_for_index_and_query(spark):
    letters = [chr(i) for i in range(0x21, 0x30000) if unicodedata.category(chr(i))[0] == "L"]
    words = [f"a{c}b" for c in letters if ord(c) < 0x3000] + [f"a{c}b" for c in letters[::29]]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").where(F.col("w").rlike(r"^[\p{L}\p{M}]+$")).select("w", X.index_tokens("w").alias("t"))
    assert rows.count() > 4000  # letters that the JVM's version of Unicode has
    assert [(r["w"], r["t"]) for r in rows.collect() if r["t"] != [X.folded_term(t) for t in lexical.query_tokens(r["w"])]] == []


def test_composition_is_asked_for_where_it_may_change(spark):
    changed = [chr(i) for i in range(0x21, 0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.normalize("NFC", chr(i)) != chr(i)]
    changed += [unicodedata.normalize("NFD", chr(i)) for i in range(0xAC00, 0xAC00 + 2000)] + ["カ\u3099", "e\u0301", "\u0627\u0653"]
    rows = spark.createDataFrame([(c,) for c in changed], "c string").select("c", X.nfc("c").alias("n"))
    assert all(r["n"] == unicodedata.normalize("NFC", r["c"]) for r in rows.collect())


def test_writers_of_an_index_do_not_overwrite_each_other(spark, tmp_path):
    index = lexical.FtsIndex(spark, str(tmp_path / "fts"), ["body"])
    table = lambda *rows: spark.createDataFrame(list(rows), "id long, body string")
    one, two = index._written(table((1, "alpha")), "id"), index._written(table((2, "alpha")), "id")
    assert (index._publish(one), index._publish(two)) == (1, 2)
    assert sorted(r["doc_id"] for r in index.search("alpha").collect()) == [1, 2]
    late = index._written(table((3, "alpha")), "id")
    index.upsert(table((4, "alpha")), "id")
    with pytest.raises(snapshots.StaleSnapshot):  # a rebuild that another write overtook
        index._publish({**late, "replaces": [1, 2]}, 3)
    with pytest.raises(ValueError, match="repeated"):
        index.upsert(table((5, "a"), (5, "a")), "id")
    assert lexical.FtsIndex(spark, str(tmp_path / "empty"), ["body"]).search("alpha").count() == 0
