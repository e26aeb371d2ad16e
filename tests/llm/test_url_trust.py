import re

import duckdb
import pytest

from loreweave.llm import queries
from loreweave.llm import url_trust as U

SCHEMA = "page_id long, url string, html string, host string, trust string, verdict int, link string"


def table(spark, pages):
    return spark.createDataFrame([(i, url, html, "x", None, 1, "y") for i, url, html in pages], SCHEMA)


def split(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def slow(pages, rules, rounds=U.ROUNDS):
    """Masses by plain dictionaries of integers."""
    rows, edges, mass = [], set(), {}
    for page_id, url, html in pages:
        host, path = split(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        rows.append((page_id, host, path, rule))
        if rule:
            mass[rule.verdict, host] = mass.get((rule.verdict, host), 0) + U.UNIT
        for link in re.findall(r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?([^\"'\s>]+)", html or ""):
            target = re.match(r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", link)
            if target and target[1] and host and target[1].lower() != host:
                edges.add((host, target[1].lower()))
    ways = [(v, a, b) for s, d in edges for v, a, b in (("allow", s, d), ("block", d, s))]
    total, state = dict(mass), mass
    for _ in range(rounds):
        moved = {}
        for v, a, b in ways:
            share = state.get((v, a), 0) * 85 // (100 * sum(w[:2] == (v, a) for w in ways))
            moved[v, b] = moved.get((v, b), 0) + share
        state = moved
        for key, more in moved.items():
            total[key] = total.get(key, 0) + more
    out = set()
    for page_id, host, path, rule in rows:
        trust, distrust = (total.get((v, host), 0) for v in ("allow", "block"))
        verdict = rule.verdict if rule else "block" if distrust > trust and distrust >= U.LEAST else "allow"
        out.add((page_id, host, path, rule and rule.host + rule.path, verdict, trust, distrust))
    return out


def a(*links):
    return "<p>text</p>" + "".join(f'<A class="x" href="{link}">l</a>' for link in links)


PAGES = [
    (1, "https://good.org/x", a("http://friend.net/1", "http://FRIEND.net/2", "/own", "http://both.net")),
    (2, "http://bad.com/de/1?x#y", a("http://elsewhere.net/")),
    (3, "http://bad.com/en/1", None),
    (4, "http://farm.net/a", a("//bad.com/de/2", "https://farm2.net")),
    (5, "http://farm2.net", a("http://farm.net?u=http://good.org/", "http://friend.net/")),
    (6, "http://friend.net/", "<a href='http://far.net/z'>x</a><a title=1 HREF = http://third.net>y</a><abbr href='http://no.net'>"),
    (7, "http://far.net/q", ""),
    (8, "http://third.net?x", a("http://bad.com/")),
    (9, "http://www.Example.ORG/es/abc", a("http://both.net/")),
    (10, "http://example.org/en/17", ""), (11, "http://example.org/en/2", ""), (12, "http://notexample.org/es/", ""),
    (13, "http://example.org", ""), (14, "HTTP://x.com#/de/", ""), (15, "no scheme", a("http://bad.com/")), (16, None, a("http://bad.com/")), (17, "", None),
    (18, "http:///de/x", a("http://bad.com/")), (19, "http://both.net/a\nb", ""), (None, "http://good.org/y", ""), (1, "https://good.org/x", a("http://friend.net/1")),
    (20, "http://long.com/fr/" + "x" * 40_000, "<a " + "y " * 20_000 + 'href="http://end.net/">'), (21, "http://org/z", ""), (22, "http://a://b/c", ""), (23, "http://FÜR.org/é?", ""),
]


def rows_of(df):
    return [tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "trust", "distrust")) for r in df.collect()]


@pytest.mark.parametrize("rounds", [0, 1, U.ROUNDS])
def test_equals_plain_propagation(spark, rounds):
    got = rows_of(U.judge(table(spark, PAGES), queries.URL_RULES, rounds))
    assert len(got) == len(PAGES)
    assert set(got) == slow(PAGES, queries.URL_RULES, rounds)


def test_verdicts(spark):
    got = {r[0]: r for r in rows_of(U.judge(table(spark, PAGES), queries.URL_RULES))}
    assert got[1][3:5] == ("org/", "allow") and got[9][3:5] == ("example.org/es/", "block") and got[10][3:5] == ("example.org/en/1", "block")
    assert got[11][3] == "org/" and got[12][3] == "org/" and got[13][3] is None and got[14][3] is None
    assert got[4][3:5] == (None, "block") and got[6][4] == "allow" and got[3][4] == "block" and got[16][1:5] == ("", "", None, "allow")


def test_sql_gives_the_same(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    rel = con.sql(U.oracle(queries.URL_RULES))
    assert sorted(map(repr, rel.fetchall())) == sorted(map(repr, rows_of(U.judge(table(spark, PAGES), queries.URL_RULES))))


def test_empty_table_and_no_rules_that_fit(spark):
    assert rows_of(U.judge(table(spark, []), queries.URL_RULES)) == []
    assert {r[4] for r in rows_of(U.judge(table(spark, PAGES), [U.Rule("block", "nowhere.invalid", "/")]))} == {"allow"}


def test_a_hub_gives_equal_shares(spark):
    edges = spark.createDataFrame([("hub", f"h{i}") for i in range(1000)] + [(f"h{i}", "sink") for i in range(1000)], "src string, dst string")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in U.spread(spark.createDataFrame([("allow", "hub", 10**9), ("block", "sink", 10**9)], "verdict string, host string, mass long"), edges).collect()}
    assert got["h1"] == (850_000, 850_000) and got["sink"] == (722_500_000, 10**9) and got["hub"] == (10**9, 722_500_000)
