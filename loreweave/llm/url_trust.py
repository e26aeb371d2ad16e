"""URL filters: rules by host and path, and for what no rule names trust and distrust spread over the link graph.

A rule holds for its host and all subdomains where the path starts with the rule's path; of several the longest
holds. Pages that a rule allows make their host a trusted seed, pages that one blocks a blocked seed, one unit of
mass for each page. Both are spread over host edges as personalised PageRank with restarts at the seeds: trust
along links, from a host to those it links to, and distrust against them, from a host to those that link to it. In
each round a host hands 85 of 100 parts of what came to it in the round before to its neighbours in equal shares; a
host's trust and distrust are the sums of all that came to it. A host is blocked if its distrust exceeds its trust
and a least mass. Masses are integers (millionths of a page, divisions round down), so that the order of additions
is no matter and a host has the same masses on every cluster.

Edges are distinct pairs of hosts. A round joins the masses, one row per host, with the edges by host and sums by
host with partial sums, so that hubs are split: what moves is host edges, never pages. Each round's table is
written to the scratch folder; the rounds end when nothing moves any more, after ``rounds`` at the latest (what is
left then is 0.85 ** rounds of a seed's mass at most).

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and has no edges, and
the empty host has neither trust nor distrust; null html has no links; links to the host itself count nothing, and
neither do relative ones; repeated rows count as pages of their own; an empty table gives an empty result; without
seeds or links the masses are the seeds' own and everything else is allowed. Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm import shared


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


ALLOW, BLOCK = "allow", "block"
#: Rounds at most, parts of a hundred handed on, the mass of a page and the least mass that blocks a host.
ROUNDS, PASSED, UNIT, LEAST = 16, 85, 1_000_000, 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)<a[\x20\x09-\x0D](?:[^>]*?[\x20\x09-\x0D])?href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?([^"'\x20\x09-\x0D>]+)"""
_TARGET = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct of ``length``, ``rule`` and ``verdict`` of the longest rule that fits; null if none does."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path),
            F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.greatest(none, none, *fits)


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)``: a page of host ``src`` links to another host ``dst``."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("link"))
    target = F.translate(F.regexp_extract("link", _TARGET, 1), _UPPER, _LOWER)
    return found.select("src", target.alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def _channels(edges: DataFrame) -> DataFrame:
    """``(verdict, from, to, degree)``: trust goes along the edges, distrust against them."""
    ways = edges.select(F.lit(ALLOW).alias("verdict"), F.col("src").alias("from"), F.col("dst").alias("to"))
    ways = ways.unionByName(edges.select(F.lit(BLOCK).alias("verdict"), F.col("dst").alias("from"), F.col("src").alias("to")))
    degrees = shared.written(ways.groupBy("verdict", "from").agg(F.count("*").alias("degree")), "host-degrees")
    return ways.join(degrees, ["verdict", "from"])


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` from seeds ``(verdict, host, mass)`` over the edges ``(src, dst)``."""
    edges = shared.written(edges, "host-edges")
    state = shared.written(seeds.select("verdict", "host", F.col("mass").cast("long").alias("mass")), "host-masses")
    came, ways = [state], None
    for _ in range(rounds if not edges.isEmpty() else 0):
        if ways is None:
            ways = shared.written(_channels(edges), "host-channels")
        handed = state.join(ways, (state["verdict"] == ways["verdict"]) & (state["host"] == ways["from"]))
        handed = handed.select(ways["verdict"], F.col("to").alias("host"), F.expr(f"mass * {PASSED} div (100 * degree)").alias("mass")).where("mass > 0")
        state = shared.written(handed.groupBy("verdict", "host").agg(F.sum("mass").alias("mass")), "host-masses")
        if state.isEmpty():
            break
        came.append(state)
    masses = came[0]
    for more in came[1:]:
        masses = masses.unionByName(more)
    return masses.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("verdict") == ALLOW, F.col("mass"))), F.lit(0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("verdict") == BLOCK, F.col("mass"))), F.lit(0)).alias("distrust"),
    )


def judge(pages: DataFrame, rules: list[Rule], rounds: int = ROUNDS, least: int = LEAST) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the host's ``trust`` and ``distrust`` of every page."""
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    own = own.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    seeds = own.where("ruled is not null and host <> ''").groupBy(F.col("ruled").alias("verdict"), "host").agg((F.count("*") * UNIT).alias("mass"))
    hosts = shared.written(spread(seeds, host_edges(pages), rounds), "host-trust").withColumnRenamed("host", "named")
    judged = own.join(hosts, own["host"] == hosts["named"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    method = F.when((distrust > trust) & (distrust >= least), BLOCK).otherwise(ALLOW)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def oracle(rules: list[Rule], rounds: int = ROUNDS, least: int = LEAST) -> str:
    """DuckDB SQL for the rows of ``judge``, a common table expression per round."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def lower(text: str) -> str:
        return f"translate({text}, '{_UPPER}', '{_LOWER}')"

    listed = ", ".join(f"({quoted(r.verdict)}, {quoted(r.host)}, {quoted(r.path)})" for r in rules)
    steps, masses = [], ["SELECT * FROM mass0"]
    for k in range(1, rounds + 1):
        steps.append(
            f"mass{k} AS MATERIALIZED (SELECT verdict, host, CAST(sum(mass) AS BIGINT) AS mass FROM (SELECT w.verdict, w.dst AS host, "
            f"m.mass * {PASSED} // (100 * w.degree) AS mass FROM mass{k - 1} m JOIN ways w ON m.verdict = w.verdict AND m.host = w.src) "
            "WHERE mass > 0 GROUP BY verdict, host)"
        )
        masses.append(f"SELECT * FROM mass{k}")
    return f"""
WITH own AS MATERIALIZED (
  SELECT page_id, html, {lower(f"coalesce(regexp_extract(url, {quoted(_URL)}, 1), '')")} AS host, coalesce(regexp_extract(url, {quoted(_URL)}, 2), '') AS path FROM pages),
rules(ruled, rule_host, rule_path) AS (VALUES {listed}),
named AS MATERIALIZED (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(ruled, length(rule_host || rule_path)) AS ruled
  FROM (SELECT DISTINCT host, path FROM own) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
edges AS MATERIALIZED (
  SELECT DISTINCT src, dst FROM (SELECT host AS src, {lower(f"regexp_extract(link, {quoted(_TARGET)}, 1)")} AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, {quoted(_HREF)}, 1)) AS link FROM own)) WHERE src <> '' AND dst <> '' AND src <> dst),
ways AS MATERIALIZED (
  SELECT 'allow' AS verdict, src, dst, count(*) OVER (PARTITION BY src) AS degree FROM edges
  UNION ALL SELECT 'block', dst, src, count(*) OVER (PARTITION BY dst) FROM edges),
mass0 AS MATERIALIZED (
  SELECT ruled AS verdict, host, CAST(count(*) * {UNIT} AS BIGINT) AS mass FROM own JOIN named USING (host, path) WHERE host <> '' GROUP BY ruled, host),
{", ".join(steps)},
hosts AS (
  SELECT host, CAST(coalesce(sum(mass) FILTER (verdict = 'allow'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(mass) FILTER (verdict = 'block'), 0) AS BIGINT) AS distrust
  FROM ({" UNION ALL ".join(masses)}) GROUP BY host)
SELECT page_id, own.host, own.path, rule,
       coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) AND coalesce(distrust, 0) >= {least} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM own LEFT JOIN named ON own.host = named.host AND own.path = named.path LEFT JOIN hosts ON own.host = hosts.host
"""
