"""Query rewrites: when one is asked for, whether it may be used, and how its evidence joins the first."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.functions import text as X

# Words that hint at a question, and the limits of a rewrite.
FILLERS = ("怎麼", "如何", "請問", "預設值", "設定", "要怎樣", "what is", "how do", "please")
MAX_CHARACTERS, MAX_TERMS, LEAST_TERMS = 256, 64, 3


def protected_tokens(query: Column) -> Column:
    """Technical words, which must survive a rewrite."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(X.FALLBACK_ANCHOR), F.lit(0)))


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def applicability(query: Column, strategy: Column, lexical_empty: Column, evidence_there: Column) -> Column:
    """LEXICAL_MISS_CROWD_OUT where a rewrite is asked for, else why not. Queries are composed texts."""
    asks = F.lit(False)
    for word in FILLERS:
        asks = asks | F.lower(query).contains(word)
    shape = query.isNotNull() & F.coalesce(strategy.isin("HYBRID", "FUSED"), F.lit(False))
    return (
        F.when(~shape, "RETRIEVAL_SHAPE_UNSUPPORTED").when((F.size(X.composed_tokens(query)) < LEAST_TERMS) | ~asks, "QUERY_SHAPE_UNSUPPORTED")
        .when(~(lexical_empty & evidence_there), "RETRIEVAL_SHAPE_UNSUPPORTED").otherwise("LEXICAL_MISS_CROWD_OUT")
    )


def verdict(original: Column, rewritten: Column) -> Column:
    """REWRITE_APPLIED, or why a rewrite is not used: blank or with controls, too long, the same terms as before, or a
    protected word missing. Both are composed texts without white space around them."""
    before, after = X.composed_tokens(original), X.composed_tokens(rewritten)
    kept = F.forall(protected_tokens(original), lambda t: F.contains(rewritten, t))
    return (
        F.when(rewritten.isNull() | X.is_blank(rewritten) | rewritten.rlike(r"\p{Cc}"), "FALLBACK_PROVIDER_INVALID")
        .when((F.length(rewritten) > MAX_CHARACTERS) | (F.size(after) > MAX_TERMS), "FALLBACK_OUTPUT_OVER_LIMIT")
        .when((F.lower(rewritten) == F.lower(original)) | (before == after), "NO_OP_DUPLICATE")
        .when(~kept, "FALLBACK_EXACT_TOKEN_LOSS")
        .otherwise("REWRITE_APPLIED")
    )


def decisions(rows: DataFrame) -> DataFrame:
    """``rows`` (``query, strategy, lexical_empty, evidence_there, rewritten``) with ``applicability`` and ``status``."""
    own = rows.withColumn("loreweave_query", X.nfc("query")).withColumn("loreweave_rewritten", X.nfc("rewritten"))
    own = own.withColumn("loreweave_query", _clean(F.col("loreweave_query"))).withColumn("loreweave_rewritten", _clean(F.col("loreweave_rewritten")))
    own = own.withColumn("applicability", applicability(F.col("loreweave_query"), F.col("strategy"), F.col("lexical_empty"), F.col("evidence_there")))
    used = verdict(F.col("loreweave_query"), F.col("loreweave_rewritten"))
    own = own.withColumn("status", F.when(F.col("applicability") != "LEXICAL_MISS_CROWD_OUT", "NO_OP_NOT_APPLICABLE").otherwise(used))
    return own.drop("loreweave_query", "loreweave_rewritten")


def attempt(spark: SparkSession, query: str, strategy: str, lexical_empty: bool, evidence_there: bool, client: Callable[[str, list[str]], str | None]) -> tuple[str, str | None]:
    """The status of one rewrite by a caller's client, and the rewritten query if it may be used."""
    schema = "query string, strategy string, lexical_empty boolean, evidence_there boolean, rewritten string"
    plain = unicodedata.normalize("NFC", query.strip())
    one = lambda rewritten: decisions(spark.createDataFrame([(plain, strategy, lexical_empty, evidence_there, rewritten)], schema)).withColumn("protected", protected_tokens(F.col("query"))).first()
    asked = one(None)
    if asked["status"] == "NO_OP_NOT_APPLICABLE":
        return asked["status"], None
    try:
        rewritten = client(query, list(asked["protected"]))
    except ValueError:
        return "FALLBACK_PROVIDER_INVALID", None
    except Exception:  # noqa: BLE001 - a client is a caller's code; the first evidence answers
        return "FALLBACK_PROVIDER_UNAVAILABLE", None
    status = one(rewritten)["status"]
    return status, unicodedata.normalize("NFC", rewritten.strip()) if status == "REWRITE_APPLIED" else None


def merged(original: DataFrame, rewritten: DataFrame, max_items: int, max_characters: int) -> DataFrame:
    """Two evidence lists (``kind, stable_id, rank, content``) in turns, the first list first; what both have stays at its
    place in the first. An item for which there is no room is left out and the next one tried."""
    key = ["kind", "stable_id"]
    columns = [*key, "rank", "content"]
    first = Window.partitionBy(*key).orderBy("rank")
    lists = [rows.select(*columns).withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn") for rows in (original, rewritten.join(original.select(*key), key, "left_anti"))]
    rows = lists[0].withColumn("side", F.lit(0)).unionByName(lists[1].withColumn("side", F.lit(1)))
    items = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", "side", *key, F.length("content").alias("long")))).alias("items"))  # two bounded lists
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast("array<struct<kind:string,stable_id:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        fits = (state["n"] < max_items) & (state["used"] + x["long"] <= max_characters)
        return F.struct(
            F.when(fits, state["n"] + 1).otherwise(state["n"]).alias("n"), F.when(fits, state["used"] + x["long"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["out"], F.array(F.struct(x["kind"].alias("kind"), x["stable_id"].alias("stable_id"))))).otherwise(state["out"]).alias("out"),
        )

    taken = items.select(F.posexplode(F.aggregate("items", begin, step, lambda s: s["out"])).alias("place", "x")).select((F.col("place") + 1).alias("place"), "x.*")
    return rows.join(taken, key).select(*key, F.col("place").alias("rank"), "content").orderBy("rank")
