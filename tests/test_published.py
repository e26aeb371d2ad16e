import pytest
from pyspark.sql import functions as F

from loreweave.operators import prompts, published
from loreweave.plans import published_queries


def page(front, body="# T\n\nSee [[Other Page|x]] and [[ b ]]."):
    return f"---\n{front}---\n\n{body}"


GOOD = 'id: "k"\ntags:\n  - "B"\n  - " a "\n  - "B"\n  - "q\\"\\\\n\\\\"\nsources:\n  - "document:12"\n  - "document:3"\nrevision: 1\n'
CASES = {
    "nothing between": (page(""), "NO_FRONTMATTER"),
    "good": (page(GOOD), (["a", "b", 'q"\\n\\'], [3, 12], ["b", "other page"], None)),
    "empty lists": (page("tags: []\nsources: []\n", "none"), ([], [], [], None)),
    "no lists": (page("x: 1\n", "none"), ([], [], [], None)),
    "cut frontmatter": ("---\ntags: []\n", "NO_FRONTMATTER"),
    "no opening": ("x" + page("x: 1\n"), "NO_FRONTMATTER"),
    "null": (None, "NO_FRONTMATTER"),
    "value beside": (page("tags: x\n"), "MALFORMED_LIST"),
    "twice": (page("tags: []\ntags: []\n"), "MALFORMED_LIST"),
    "indented otherwise": (page('tags:\n  - "a"\n   - "b"\n'), "MALFORMED_LIST"),
    "unquoted": (page("tags:\n  - a\n"), "MALFORMED_LIST"),
    "bad escape": (page('tags:\n  - "a\\t"\n'), "MALFORMED_LIST"),
    "escape at the end": (page('tags:\n  - "a\\"\n'), "MALFORMED_LIST"),
    "blank tag": (page('tags:\n  - "  "\n'), "MALFORMED_TAG"),
    "tag of two lines": (page('tags:\n  - "a\\nb"\n'), "MALFORMED_TAG"),
    "long tag": (page(f'tags:\n  - "{"x" * 201}"\n'), "MALFORMED_TAG"),
    "long enough tag": (page(f'tags:\n  - "{"x" * 200}"\n', "none"), (["x" * 200], [], [], None)),
    "source zero": (page('sources:\n  - "document:0"\n'), "MALFORMED_SOURCE"),
    "source too large": (page('sources:\n  - "document:9999999999999999999"\n'), "MALFORMED_SOURCE"),
    "largest source": (page(f'sources:\n  - "document:{2**63 - 1}"\n', "none"), ([], [2**63 - 1], [], None)),
    "source word": (page('sources:\n  - "chunk:1"\n'), "MALFORMED_SOURCE"),
    "path link": (page("x: 1\n", "[[a/b]]"), "MALFORMED_LINK"),
    "anchor link": (page("x: 1\n", "[[a#b]]"), "MALFORMED_LINK"),
    "blank link": (page("x: 1\n", "[[ |b]]"), "MALFORMED_LINK"),
    "many tags": (page("tags:\n" + "".join(f'  - "t{i}"\n' for i in range(2001))), "TOO_MANY"),
    "many links": (page("x: 1\n", "[[a]] " * 2001), "TOO_MANY"),
    "just enough links": (page("x: 1\n", "[[a]] " * 2000), ([], [], ["a"], None)),
    "list last": (page('x: 1\ntags:\n  - "z"\n', "none"), (["z"], [], [], None)),
    "decomposed": (page('tags:\n  - "Café"\n', "[[Café  Bar]]"), (["café"], [], ["café bar"], None)),
}


def test_strict_parse(spark):
    from loreweave.functions import text as X

    rows = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "k string, t string").select("k", X.nfc("t").alias("t")).select("k", published.relations("t").alias("r"))
    got = {r["k"]: (list(r["r"]["tags"]), list(r["r"]["sources"]), list(r["r"]["links"]), r["r"]["error"]) for r in rows.collect()}
    assert got == {k: want if isinstance(want, tuple) else ([], [], [], want) for k, (_, want) in CASES.items()}


def test_vault_on_disk(spark, tmp_path):
    vault = tmp_path / "vault" / "howtos"
    vault.mkdir(parents=True)
    text = published.page_file(*[F.lit(x) for x in ("k1", "My Page", "HOWTO")], F.array(F.lit("t")), F.array().cast("array<string>"), F.array(F.lit(4)), F.lit("d"), F.lit("d"), F.lit(1), F.lit(2), F.lit(3), F.lit("# My Page\n\ntext [[Other]]"))
    made = spark.range(1).select(text.alias("t")).first()["t"]
    (vault / "my-page.md").write_text(made)
    (vault / "big.md").write_bytes(b"x" * (published.MAX_PAGE_BYTES + 1))
    files = published.files(spark, str(tmp_path / "vault"))
    assert {r["source_path"]: r["content"] is None for r in files.collect()} == {"vault/howtos/my-page.md": False, "vault/howtos/big.md": True}
    rows = [("k1", "My Page", "HOWTO", "vault/howtos/my-page.md"), ("k2", "Big", "HOWTO", "vault/howtos/big.md"), ("k3", "Gone", "HOWTO", "vault/howtos/gone.md")]
    pages = spark.createDataFrame(rows, "knowledge_id string, title string, page_type string, markdown_path string").withColumn("content_hash", F.sha2(F.lit(made), 256))
    got = {r["knowledge_id"]: (r["content_status"], r["reason"], r["body"]) for r in published.checked(pages, files).collect()}
    assert got == {"k1": ("VALID", None, "# My Page\n\ntext [[Other]]"), "k2": ("INVALID", "TOO_LARGE", None), "k3": ("INVALID", "FILE_MISSING", None)}


def test_every_reason_occurs(spark):
    found = {r["reason"] for r in published_queries.published_files(spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert found == {None, "PATH_NOT_CANONICAL", "FILE_MISSING", "TOO_LARGE", "UNREADABLE", "HASH_DIFFERS", "NOT_UTF8", "NO_FRONTMATTER", "METADATA_DIFFERS", "TITLE_DIFFERS"}


def test_templates():
    made = prompts.template("{{evidence}} {{ document.metadata }}")
    assert made.version.startswith("sha256:") and made.parts == ("", "evidence", " ", "document.metadata", "")
    assert prompts.template("<!-- prompt-version: v 2 -->\n{{evidence}}{{document.metadata}}").identifier == "document-analysis@v 2"
    for bad in ("", "  ", "{{evidence}}", "{{ document.metadata }}"):
        with pytest.raises(ValueError):
            prompts.template(bad)
    with pytest.raises(ValueError, match="unknown"):
        prompts.template("{{evidence}}{{document.metadata}}{{other}}").rendered({"evidence": None, "document.metadata": None})
