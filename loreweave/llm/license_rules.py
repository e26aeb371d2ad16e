"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into fragments at line breaks and sentence ends, and each is normalised, which takes comment marks
away. A known sentence is a run of consecutive fragments whose words, in order, are all of its words, those after a
colon or semicolon too: it may be wrapped at any word, but not over a blank line, and it begins and ends where fragments do. Of known sentences of
which one lies within the other, the longer counts. The identifiers of a text, in order, are then matched against
licence rules, each a sequence of identifiers; rules are tried in their order, the more specific first, and what
a rule has matched is not matched again. Known sentences left over are reported as well.

The join with the word runs of the known sentences is a broadcast of a fixed table, so other fragments never
leave their task; only matches are grouped by text.

Defined results: texts without a known sentence give no row, so null and empty texts and an empty table give
none; rows that are equal in id and text give one row; a null id is reported as null. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm import shared

#: Known sentences by identifier. The wording of public licences.
SENTENCES = {
    "apache-under": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-title": ["Apache License Version 2.0, January 2004", "Apache License, Version 2.0"],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "mit-released": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License"],
    "mit-title": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "gpl3-under": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GPLv3"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl3-only-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"],
    "gpl2-only-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation"],
    "gpl2-under": ["Licensed under the GNU General Public License, version 2", "Licensed under the GPLv2"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "lgpl-details": ["See the GNU Lesser General Public License for more details"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-details": ["See the GNU Affero General Public License for more details"],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "epl2-title": ["Eclipse Public License - v 2.0"],
    "mpl-title": ["Mozilla Public License Version 2.0"],
    "mit-apache-either": ["Licensed under either of Apache License, Version 2.0 or MIT license at your option", "Licensed under either of Apache License, Version 2.0", "This project is dual-licensed under the MIT License and the Apache License, Version 2.0"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-4": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0"],
    "mpl-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}

#: Identifiers of public licences, as lines of the form ``SPDX-License-Identifier: <identifier>`` name them.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MPL-2.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "Zlib", "BSL-1.0", "MIT OR Apache-2.0", "Apache-2.0 OR MIT",
)
SENTENCES |= {f"spdx-{x.lower().replace(' ', '-')}": [f"SPDX-License-Identifier: {x}"] for x in SPDX}

#: Licence rules in the order in which they are tried.
RULES = [
    *[(x, [f"spdx-{x.lower().replace(' ', '-')}"]) for x in SPDX],
    ("MIT OR Apache-2.0", ["mit-apache-either"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("GPL-2.0-only", ["gpl2-only-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-only", ["gpl2-only-free"]),
    ("GPL-3.0-only", ["gpl3-only-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-only", ["gpl3-only-free"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("Apache-2.0", ["apache-under", "apache-comply", "apache-copy", "apache-basis"]),
    ("Apache-2.0", ["apache-under", "apache-comply"]),
    ("Apache-2.0", ["apache-under"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-title"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-3.0-only", ["gpl3-under"]),
    ("GPL-2.0-only", ["gpl2-under"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("Apache-2.0", ["apache-title"]),
    ("EPL-2.0", ["epl2-title"]),
    ("MPL-2.0", ["mpl-title"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense"]),
    ("Proprietary", ["reserved"]),
]

#: Where a fragment ends: each line break by itself, so that a blank line is a fragment without words.
_CUT = r"[.!?;:]+[ \t]*(?:\r\n|[ \t\n\r\f])|\r\n|[\n\r\f]"
_NOT_WORD = r"[^a-z0-9.+]+"


def normalised(sentence: str) -> str:
    """The form in which sentences are compared: lower case, letters, digits, points and plus signs, single blanks."""
    return re.sub(r"^[ .]+|[ .]+$", "", re.sub(_NOT_WORD, " ", sentence.lower()))


def _wordings() -> list[tuple[str, str]]:
    """Each wording whole, by its words as fragments have them: the points of a word that may end a fragment are not part of it."""
    return [(" ".join(w for w in (x.strip(".") for x in normalised(wording).split()) if w), name) for name, wordings in SENTENCES.items() for wording in wordings]


@lru_cache(maxsize=1)
def _word_runs() -> list[tuple[str, int, str, int, int, list[int]]]:
    """Every run of words of each known sentence: the run, the sentence's number, its name, both lengths and where the run
    begins."""
    found = []
    for number, (sentence, name) in enumerate(sorted(set(_wordings()))):
        words, starts = sentence.split(), defaultdict(list)
        for a in range(len(words)):
            for b in range(a, len(words)):
                starts[" ".join(words[a : b + 1])].append(a)
        found += [(run, number, name, run.count(" ") + 1, len(words), at) for run, at in starts.items()]
    return found


def _hits(documents: DataFrame) -> DataFrame:
    """``doc_id, digest, pos, last, name`` of the known sentences, by their first and last fragments.

    In fragments that follow each other, the words before a fragment less the words of the sentence before its run
    are the same for all parts of one occurrence; it is whole where the parts have as many words as the sentence."""
    known = documents.sparkSession.createDataFrame(_word_runs(), "fragment string, sentence int, name string, n int, total int, starts array<int>")
    rows = documents.select("doc_id", shared.text_digest().alias("digest"), F.posexplode(F.split(F.concat("text", F.lit(" ")), _CUT)).alias("pos", "raw"))
    parts = rows.select("doc_id", "digest", "pos", _sentence("raw").alias("fragment")).join(F.broadcast(known), "fragment").drop("fragment")  # a fixed table
    parts = parts.repartition("doc_id", "digest").dropDuplicates(["doc_id", "digest", "sentence", "name", "pos"])
    order = Window.partitionBy("doc_id", "digest", "sentence", "name").orderBy("pos")
    parts = parts.withColumn("island", F.col("pos") - F.row_number().over(order)).withColumn("before", F.sum("n").over(order) - F.col("n"))
    parts = parts.withColumn("at", F.explode("starts"))
    whole = parts.groupBy("doc_id", "digest", "sentence", "name", "total", "island", (F.col("before") - F.col("at")).alias("origin")).agg(F.sum("n").alias("n"), F.min("pos").alias("pos"), F.max("pos").alias("last"))
    return whole.where("n = total").select("doc_id", "digest", "pos", "last", "name")


def _sentence(column: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(column)), _NOT_WORD, " "), r"^[ .]+|[ .]+$", "")


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, licenses, known_sentences, unmatched``: licences by comma in rule order, the identifiers in text
    order, and those that no rule took."""
    earlier = Window.partitionBy("doc_id", "digest").orderBy("pos", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    hits = _hits(documents).withColumn("reached", F.max("last").over(earlier))
    hits = hits.where("reached is null or reached < last")  # what lies within a longer one is part of it
    named = hits.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("pos", "name"))).alias("hits"))  # no more than the text has sentences
    sequence = F.concat(F.lit("|"), F.array_join(F.transform("hits", lambda h: h["name"]), "||"), F.lit("|"))
    found = named.select("doc_id", "digest", sequence.alias("sequence"), sequence.alias("rest0"))
    taken = []
    for i, (name, parts) in enumerate(RULES):
        rule = "".join(f"|{p}|" for p in parts)
        taken.append(F.when(F.contains(F.col(f"rest{i}"), F.lit(rule)), F.lit(name)))
        found = found.withColumn(f"rest{i + 1}", F.replace(F.col(f"rest{i}"), F.lit(rule), F.lit("")))
    plain = lambda c: F.replace(F.trim(F.col(c), F.lit("|")), F.lit("||"), F.lit(","))
    licenses = F.array_join(F.array_distinct(F.array_compact(F.array(*taken))), ",")
    return found.select("doc_id", licenses.alias("licenses"), plain("sequence").alias("known_sentences"), plain(f"rest{len(RULES)}").alias("unmatched"))


def oracle() -> str:
    """The same scan in SQL. The fragments of a text stand in one string, each between two marks; a wording is known where
    its words follow each other, parted by a blank or by the end and the beginning of fragments, from a fragment's
    beginning to a fragment's end."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    patterns = {(name, "\x01" + "( |\x01\x01)".join(re.escape(w) for w in words.split()) + "\x01") for words, name in _wordings()}
    values = ", ".join(f"({quote(p)}, {quote(n)})" for n, p in sorted(patterns))
    rests, names = ["sequence AS rest0"], []
    for i, (name, parts) in enumerate(RULES):
        rule = quote("".join(f"|{p}|" for p in parts))
        names.append(f"CASE WHEN contains(rest{i}, {rule}) THEN {quote(name)} END")
        rests.append(f"replace(rest{i}, {rule}, '') AS rest{i + 1}")
    steps = "".join(f", r{i + 1} AS (SELECT *, {r} FROM r{i})" for i, r in enumerate(rests))
    last = len(RULES)
    ranked = " UNION ALL ".join(f"SELECT doc_id, digest, {i} AS ord, {n} AS name FROM r{last + 1}" for i, n in enumerate(names))
    return f"""
WITH known(pattern, name) AS (VALUES {values}),
split AS (SELECT DISTINCT doc_id, md5(text) AS digest, string_split_regex(text || ' ', '{_CUT}') AS parts FROM documents WHERE text IS NOT NULL),
plain AS MATERIALIZED (SELECT doc_id, digest, chr(1) || array_to_string(list_transform(parts, lambda x: regexp_replace(regexp_replace(lower(x), '{_NOT_WORD}', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')), chr(1) || chr(1)) || chr(1) AS line FROM split),
held AS (SELECT doc_id, digest, name, regexp_extract_all(line, pattern) AS found, string_split_regex(line, pattern) AS around FROM plain JOIN known ON regexp_matches(line, pattern)),
spans AS (SELECT DISTINCT h.doc_id, h.digest, h.name, sum(length(p.ahead)) OVER w + coalesce(sum(length(p.own)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(length(p.ahead) + length(p.own)) OVER w AS b
  FROM held h, LATERAL (SELECT unnest(h.found) AS own, unnest(h.around[1:len(h.found)]) AS ahead, unnest(range(len(h.found))) AS i) p WINDOW w AS (PARTITION BY h.doc_id, h.digest, h.name, h.found, h.around ORDER BY p.i)),
reach AS (SELECT *, max(b) OVER (PARTITION BY doc_id, digest ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans),
hits AS (SELECT DISTINCT doc_id, digest, a, name FROM reach WHERE reached IS NULL OR reached < b),
r0 AS (SELECT doc_id, digest, '|' || string_agg(name, '||' ORDER BY a, name) || '|' AS sequence FROM hits GROUP BY doc_id, digest){steps},
ranked AS ({ranked}),
firsts AS (SELECT doc_id, digest, name, min(ord) AS ord FROM ranked WHERE name IS NOT NULL GROUP BY ALL),
listed AS (SELECT doc_id, digest, string_agg(name, ',' ORDER BY ord) AS licenses FROM firsts GROUP BY ALL)
SELECT r.doc_id, coalesce(licenses, '') AS licenses, replace(trim(sequence, '|'), '||', ',') AS known_sentences,
       replace(trim(rest{last}, '|'), '||', ',') AS unmatched
FROM r{last + 1} r LEFT JOIN listed l ON r.doc_id IS NOT DISTINCT FROM l.doc_id AND r.digest = l.digest
"""
