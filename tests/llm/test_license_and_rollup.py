import textwrap

import duckdb
import pytest
from helpers import EDGES, empty, frame

from loreweave.llm import license_rules as R
from loreweave.llm import queries, token_rollup

MIT = [R.SENTENCES[n][0] for n in ("mit-grant", "mit-notice", "mit-warranty")]


def test_rules_take_sequences_in_order(spark):
    docs = [
        (1, "Some code. " + R.SENTENCES["apache-under"][0] + ".\n" + R.SENTENCES["apache-comply"][0] + ". More."),
        (2, "MIT License\n\n" + "\n\n".join(s if s.endswith(":") else s + "." for s in MIT)),
        (3, "LICENSED   under the -- MIT license!"),
        (4, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
        (5, "Nothing here."),
        (6, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0. All rights reserved."),
    ]
    got = {r["doc_id"]: r for r in R.scan(frame(spark, docs + EDGES)).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert (got[1]["licenses"], got[1]["known_sentences"]) == ("Apache-2.0", "apache-under,apache-comply")
    assert (got[2]["licenses"], got[2]["unmatched"]) == ("MIT", "")
    assert got[3]["licenses"] == "MIT"
    assert (got[4]["licenses"], got[4]["unmatched"]) == ("", "bsd-source")
    assert got[6]["licenses"] == "CC-BY-NC-4.0,CC-BY-4.0,Proprietary"
    assert R.scan(empty(spark)).count() == 0


def wrapped(name, width, mark="", end="."):
    text = R.SENTENCES[name][0]
    return textwrap.fill(text if text[-1] in ":." else text + end, width, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False, break_long_words=False)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_sentences_are_known(spark, mark):
    blank = f"\n{mark.rstrip()}\n"
    mit, bsd = ["mit-grant", "mit-notice", "mit-warranty"], ["bsd-redistribute", "bsd-source", "bsd-binary"]
    header = f"""{mark}Copyright 2020 The Authors. All rights reserved.
{mark}Licensed under the Apache License, Version 2.0 (the "License");
{mark}you may not use this file except in compliance with the License.
{mark}You may obtain a copy of the License at
{mark.rstrip()}
{mark}    http://www.apache.org/licenses/LICENSE-2.0
{mark.rstrip()}
{mark}Unless required by applicable law or agreed to in writing, software
{mark}distributed under the License is distributed on an "AS IS" BASIS,
{mark}WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
    docs = [(i, f"{mark}MIT License" + blank + blank.join(wrapped(n, width, mark) for n in mit)) for i, width in enumerate((12, 40, 72, 80))]
    docs += [(10, "\n".join(wrapped(n, 76, mark) for n in bsd)), (11, wrapped("isc-grant", 79, mark).replace("\n", "\r\n")), (12, header), (12, header)]
    docs += [(13, f"{mark}This work is\n{mark}licensed under CC BY 4.0."), (14, blank.join(wrapped("mit-notice", 40, mark).split("\n"))), (15, wrapped("mit-notice", 40, mark).replace("substantial", "some"))]
    docs += [(16, "no sentence end |\nReleased under the MIT License.\nand on")]
    got = {r["doc_id"]: (r["licenses"], r["known_sentences"], r["unmatched"]) for r in R.scan(frame(spark, docs)).collect()}
    for i in range(4):
        assert got.pop(i) == ("MIT", "mit-title," + ",".join(mit), "")
    assert got == {
        10: ("BSD-2-Clause", ",".join(bsd), ""), 11: ("ISC", "isc-grant", ""), 12: ("Apache-2.0,Proprietary", "reserved,apache-under,apache-comply,apache-copy,apache-basis", ""),
        13: ("CC-BY-4.0", "cc-by-4", ""), 16: ("MIT", "mit-released", ""),
    }


def test_wordings_are_read_to_their_end(spark):
    tail = "\n\nThis program is distributed in the hope that it will be useful, but\nWITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nGeneral Public License for more details.\n"
    docs = [(i, wrapped("gpl-free" if i % 2 else "gpl2-free", width) + tail) for i, width in enumerate((72, 72, 2000, 2000))]
    docs += [(4, "This program is free software."), (5, R.SENTENCES["gpl-free"][0].replace("version 3", "version 4")), (6, R.SENTENCES["mpl-subject"][0] + "."), (7, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1")]
    got = {r["doc_id"]: (r["licenses"], r["known_sentences"], r["unmatched"]) for r in R.scan(frame(spark, docs)).collect()}
    two, three = (("GPL-2.0-or-later", "gpl2-free,gpl-hope,gpl-details", ""), ("GPL-3.0-or-later", "gpl-free,gpl-hope,gpl-details", ""))
    assert got == {0: two, 1: three, 2: two, 3: three, 6: ("MPL-2.0", "mpl-subject", "")}
    all_names = [(i, ".\n\n".join(x)) for i, x in enumerate(R.SENTENCES.values())]
    got = {r["doc_id"]: r["known_sentences"] for r in R.scan(frame(spark, all_names)).collect()}
    assert got == {i: ",".join([name] * len(x)) for i, (name, x) in enumerate(R.SENTENCES.items())}


MORE = {
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "// This program and the accompanying materials are made\n// available under the terms of the Eclipse Public License 2.0\n// which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MIT": "// SPDX-License-Identifier: MIT",
    "GPL-3.0-only": "/* SPDX-License-Identifier: GPL-3.0-only */\nint main;",
    "MIT OR Apache-2.0": "# SPDX-License-Identifier: MIT OR Apache-2.0\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007",
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n",
}


def sql_scan(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(map(str, con.execute(R.oracle()).fetchall()))


def test_more_licences_and_the_sql_reads_whole_wordings(spark):
    docs = list(enumerate(MORE.values())) + [(100, "SPDX-License-Identifier: MIT OR Apache-2.0 OR ISC"), (101, "SPDX-License-Identifier:\n\nMIT"), (102, None), (103, "")]
    got = {r["doc_id"]: r["licenses"] for r in R.scan(frame(spark, docs)).collect()}
    assert got == dict(enumerate(MORE))
    bsd = "\n".join(wrapped(n, 76, " * ") for n in ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"))
    docs += [(200, "MIT License\n\n" + "\n\n".join(wrapped(n, 72) for n in ("mit-grant", "mit-notice", "mit-warranty"))), (201, bsd), (202, bsd + "\n" + bsd), (203, MORE["MIT"] + "\n" + MORE["MIT"]), (204, wrapped("gpl2-free", 70)), (205, "All rights reserved. All rights reserved.")]
    docs += [(300 + i, ".\n\n".join(x)) for i, x in enumerate(R.SENTENCES.values())]
    rows = R.scan(frame(spark, docs)).select("doc_id", "licenses", "known_sentences", "unmatched").collect()
    assert sorted(str(tuple(r)) for r in rows) == sql_scan(docs) and len(rows) > len(R.SENTENCES)


def test_scan_stays_out_of_python(spark):
    plan = R.scan(frame(spark, EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


CHANGES = "source string, lang string, n long, m long, tokenizer string"


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", 5, 4, "x"), ("a", "en", 3, 3, "x"), (None, None, 2, 0, "x"), ("b", None, 1, 1, "x")], CHANGES)
    rollup = token_rollup.Rollup(spark, f"{tmp_path}/rollup")
    assert totals(rollup) == {}
    assert rollup.commit("one", token_rollup.inserted(rows, rows.n, "v1"))
    assert not rollup.commit("one", token_rollup.inserted(rows, rows.n, "v1"))
    first = {("a", "en", "v1"): (2, 8), (None, None, "v1"): (1, 2), ("b", None, "v1"): (1, 1)}
    assert totals(rollup) == first
    assert rollup.commit("two", token_rollup.revised(rows, rows.n, rows.m, "v1"))
    assert totals(rollup)[("a", "en", "v1")] == (2, 7)
    rollup.compact()
    assert not rollup.commit("two", token_rollup.revised(rows, rows.n, rows.m, "v1"))
    assert rollup.commit("three", token_rollup.deleted(rows.where("source = 'b'"), rows.m, "v1"))
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v1"): (2, 7), (None, None, "v1"): (1, 0)}
    assert rollup.commit("none", token_rollup.inserted(rows.limit(0), rows.n, "v1")) and not rollup.commit("one", token_rollup.inserted(rows, rows.n, "v1"))
    assert len(rollup.committed()) == 2


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    """Neither deltas that nobody entered nor an entry without content keep others from committing."""
    rows = spark.createDataFrame([("a", "en", 5, 4, "x")], CHANGES)
    rollup = token_rollup.Rollup(spark, f"{tmp_path}/rollup")
    token_rollup.Rollup._deltas(token_rollup.inserted(rows, rows.n, "v1")).write.parquet(f"{tmp_path}/rollup/staged-dead")
    (tmp_path / "rollup" / "log").mkdir()
    (tmp_path / "rollup" / "log" / "000000000000.json").write_text("")
    assert totals(rollup) == {} and rollup.commit("one", token_rollup.inserted(rows, rows.n, "v1"))
    (tmp_path / "rollup" / "log" / "000000000002.json").write_text('{"batch": "ha')
    assert rollup.commit("two", token_rollup.inserted(rows, rows.n, "v1")) and not rollup.commit("one", token_rollup.inserted(rows, rows.n, "v1"))
    assert totals(rollup) == {("a", "en", "v1"): (2, 10)} and rollup.committed() == ["one", "two"]
    assert rollup.compact() and totals(rollup) == {("a", "en", "v1"): (2, 10)} and rollup._numbers() == [4]


def test_of_two_writers_one_takes_the_next_entry(spark, tmp_path):
    """A writer that reads the log before another's entry finds its number taken, and its batch known or not."""
    rows = spark.createDataFrame([("a", "en", 5, 4, "x")], CHANGES)
    slow, fast = (token_rollup.Rollup(spark, f"{tmp_path}/rollup") for _ in range(2))
    folder = slow._written(token_rollup.inserted(rows, rows.n, "v1"))
    assert fast.commit("same", token_rollup.inserted(rows, rows.n, "v1"))
    assert not slow._entered(0, "same", folder) and slow._known("same", slow._live()[0])
    assert totals(slow) == {("a", "en", "v1"): (1, 5)}
    assert slow._entered(1, "other", folder) and totals(fast) == {("a", "en", "v1"): (2, 10)}


def test_the_log_is_folded_by_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_rollup, "FOLD_AFTER", 3)
    rows = spark.createDataFrame([("a", "en", 5, 4, "x")], CHANGES)
    rollup = token_rollup.Rollup(spark, f"{tmp_path}/rollup")
    for i in range(9):
        assert rollup.commit(f"batch{i}", token_rollup.inserted(rows, rows.n, "v1"))
        assert len(rollup._numbers()) <= 4
    assert totals(rollup) == {("a", "en", "v1"): (9, 45)}
    assert not any(rollup.commit(f"batch{i}", token_rollup.inserted(rows, rows.n, "v1")) for i in (0, 4, 8))


def test_rollup_query_on_edges(spark, tmp_path):
    """Nulls, very long texts, repeated rows, clashing columns and an empty table."""
    from helpers import EDGES, empty, frame

    from loreweave.llm import queries

    for name, rows in (("full", frame(spark, EDGES)), ("none", empty(spark))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = totals_of(queries.op4_token_rollup(spark, f"{tmp_path}/full"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/full/documents.parquet/*.parquet'")
    want = {tuple(r)[:3]: tuple(r)[3:] for r in con.execute(queries._TOKEN_ROLLUP).fetchall()}
    assert {k: v for k, v in got.items() if k[2] == "pieces"} and set(got) == {k for k, v in want.items() if any(v)}
    assert sum(v[0] for v in got.values()) == sum(v[0] for v in want.values())
    assert queries.op4_token_rollup(spark, f"{tmp_path}/none").count() == 0


def totals_of(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}
