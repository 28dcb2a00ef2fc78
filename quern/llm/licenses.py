"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences. Each normalised sentence (ASCII lower case, other characters as one
space) that is a known licence sentence gives its identifier, every run of other sentences gives
``_``. Sentences end at punctuation and blank lines; a line break, with the comment signs after it,
ends one too unless the lines together are a known sentence, so wrapped texts are read whole. A known
sentence is matched as a whole, also where it holds punctuation itself. The sequence of identifiers
is then matched against rules, which are ordered: the first rule that matches at a place takes it,
and rules may allow other sentences in between.

Texts without any of the ``CUES`` are passed over. Every known sentence holds a cue within one of
its words, so this changes no result.

Defined cases: null and empty texts have no sentence and no licence; long texts are read whole; a
licence that stands twice is named twice; where several known sentences begin at one place the
longest is taken, and ties between rules go to the rule listed first; repeated rows are scanned
alike; rows with a null id are scanned like others; an empty table gives an empty table; extra
columns pass through, and a column that has the name of an output is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers of the public list of licences that the one-line notice names.
SPDX = "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 Unlicense Zlib BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
#: Identifier and text of known licence sentences. ``<*>`` stands for any words of the sentence.
SENTENCES = {
    "mit_short": "Released under the MIT License.",
    "mit_short2": "Licensed under the MIT License.",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache_short": "Licensed under the Apache License, Version 2.0.",
    "apache_grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache_use": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3_short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3_grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl_grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl3_grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3_grant": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_see": "See the GNU General Public License for more details.",
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl_see": "See the GNU Lesser General Public License for more details.",
    "agpl_see": "See the GNU Affero General Public License for more details.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of <*> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2_grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc_by_nc_short": "Licensed under CC BY-NC 4.0.",
    "cc_by_short": "Licensed under CC BY 4.0.",
    "cc_by_sa_short": "Licensed under CC BY-SA 4.0.",
    "cc0_short": "Licensed under CC0 1.0.",
    "cc_by_grant": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc_by_sa_grant": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc_by_nc_grant": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense_grant": "This is free and unencumbered software released into the public domain.",
    "epl2_grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "reserved": "All rights reserved.",
} | {f"spdx_{name.lower().replace('-', '_').replace('.', '_')}": f"SPDX-License-Identifier: {name}" for name in SPDX}
#: Rules in order: licence and the sentences that show it. ``?`` after a sentence: it may be absent; ``_?``: other sentences may stand there.
RULES = (
    ("MIT", "mit_grant _? mit_notice _? mit_warranty mit_liability?"),
    ("MIT", "mit_short"),
    ("MIT", "mit_short2"),
    ("Apache-2.0", "apache_grant apache_use? _? apache_copy? _? apache_basis? apache_see?"),
    ("Apache-2.0", "apache_short"),
    ("AGPL-3.0", "agpl3_grant gpl_hope? _? agpl_see?"),
    ("GPL-3.0", "gpl3_grant gpl_hope? _? gpl_see?"),
    ("GPL-2.0", "gpl2_grant gpl_hope? _? gpl_see?"),
    ("LGPL-2.1", "lgpl_grant lgpl_hope? _? lgpl_see?"),
    ("LGPL-3.0", "lgpl3_grant lgpl_hope? _? lgpl_see?"),
    ("GPL-3.0", "gpl3_short"),
    ("BSD-3-Clause", "bsd_grant _? bsd_source _? bsd_binary _? bsd_names"),
    ("BSD-2-Clause", "bsd_grant _? bsd_source _? bsd_binary"),
    ("ISC", "isc_grant"),
    ("MPL-2.0", "mpl2_grant"),
    ("CC-BY-NC-4.0", "cc_by_nc_short"),
    ("CC-BY-NC-4.0", "cc_by_nc_grant"),
    ("CC-BY-SA-4.0", "cc_by_sa_short"),
    ("CC-BY-SA-4.0", "cc_by_sa_grant"),
    ("CC-BY-4.0", "cc_by_short"),
    ("CC-BY-4.0", "cc_by_grant"),
    ("CC0-1.0", "cc0_short"),
    ("Unlicense", "unlicense_grant"),
    ("EPL-2.0", "epl2_grant"),
    ("all-rights-reserved", "reserved"),
    *[(name, f"spdx_{name.lower().replace('-', '_').replace('.', '_')}") for name in SPDX],
)
#: Each known sentence holds one of these within a word.
CUES = ("licen", "copyright", "permi", "redistribut", "warrant", "rights", "unencumbered")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def sentence_pattern(sentence: str) -> str:
    """A known sentence over marked words: ``S`` where it is cut by its own punctuation, a space or ``L`` between words."""
    cut = [" ".join(normal(gap) or "<*>" for gap in re.split("(<\\*>)", part)) for part in re.split(r"(?<=[.!?;:])[ \n\r\t]+", sentence)]
    return "S".join(part.strip().replace(" ", "[ L]").replace("<*>", "[a-z0-9 L]+?") for part in cut)


def rule_pattern(rule: str) -> str:
    """A rule as a regular expression over identifiers that are each followed by a space."""
    words = [(word.rstrip("?"), word.endswith("?")) for word in rule.split()]
    return "".join(f"(?:{name} )?" if free else f"{name} " for name, free in words)


def sequence(text: Column) -> Column:
    """The identifiers of a text's sentences, each followed by a space; runs of others as ``_``.

    The text becomes words with ``S`` at each end of a sentence or blank line and ``L`` at each other
    line break; a known sentence stands between such marks and may have an ``L`` for any of its spaces.
    """
    known = sorted(((sentence_pattern(s), name) for name, s in SENTENCES.items()), key=lambda p: -len(p[0]))
    every = "(?<![^SL])(?:" + "|".join(p for p, _ in known) + ")(?![^SL])"
    words = F.translate(text, UPPER, LOWER)
    # no pattern repeats a group: on long runs Java would run out of stack
    for pattern, mark in ((r"\n[^a-z0-9]*\n", "S"), (r"\n[^a-z0-9S]*", "L"), (r"[.!?;:](?=[ \r\tLS])", "S"), ("[^a-z0-9SL]+", " "), ("[ L]*S[ SL]*", "S"), (" ?L ?", "L")):
        words = F.regexp_replace(words, pattern, mark)
    words = F.trim(words)
    others = F.transform(F.split(words, every), lambda s: F.when(s.rlike("[a-z0-9]"), F.lit("_ ")).otherwise(""))
    plain = F.create_map(*[F.lit(x) for p, name in known if "+?" not in p for x in (p.replace("[ L]", " "), f"{name} ")])
    loose = [(f"^{p}$", f"{name} ") for p, name in known if "+?" in p]
    named = lambda hit: F.coalesce(plain[F.translate(hit, "L", " ")], *[F.when(hit.rlike(p), F.lit(name)) for p, name in loose])
    hits = F.transform(F.regexp_extract_all(words, F.lit(every), F.lit(0)), named)
    joined = F.array_join(F.zip_with(others, hits, lambda o, h: F.concat(o, F.coalesce(h, F.lit("")))), "")
    return F.when(F.translate(text, UPPER, LOWER).rlike("|".join(CUES)), joined).otherwise("")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sentences`` (identifiers in order) and ``licenses`` (names in order of place)."""
    patterns = [(name, rule_pattern(rule)) for name, rule in RULES]
    every = "|".join(f"(?:{p})" for _, p in patterns)
    rest = [c for c in docs.columns if c not in ("sentences", "licenses", "_ids")]
    rows = docs.select(*rest, sequence(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_ids"))
    found = F.regexp_extract_all("_ids", F.lit(f"(?<![^ ])(?:{every})"), F.lit(0))

    def name(hit: Column) -> Column:
        return F.coalesce(*[F.when(hit.rlike(f"^(?:{p})$"), F.lit(n)) for n, p in patterns])

    names = F.when(F.col("_ids").rlike("[a-z]"), F.transform(found, name)).otherwise(F.array().cast("array<string>"))
    ids = F.when(F.col("_ids").rlike("[a-z]"), F.filter(F.split("_ids", " "), lambda s: ~s.isin("", "_"))).otherwise(F.array().cast("array<string>"))
    return rows.select(*rest, ids.alias("sentences"), names.alias("licenses"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"))


def op1_sql() -> str:
    """The same scan for DuckDB, written for itself: marks stand twice there, so that neighbours can share one."""
    forms = {}
    for name, sentence in SENTENCES.items():
        words = re.findall(r"<\*>|[a-z0-9]+|[.!?;:](?= )", sentence.lower())
        forms[name] = re.sub(" ?[.!?;:] ?", "SS", " ".join(words)).replace(" ", "( |LL)").replace("<*>", "[a-z0-9 L]+?")
    every = "[SL](?:" + "|".join(sorted(forms.values(), key=len, reverse=True)) + ")[SL]"
    values = ", ".join(f"('{name}', '{form}')" for name, form in forms.items())
    rules = [(name, "".join(f"({w[:-1]} )?" if w.endswith("?") else f"{w} " for w in rule.split())) for name, rule in RULES]
    names = " ".join(f"WHEN regexp_full_match(hit, '{rule}') THEN '{name}'" for name, rule in rules)
    return f"""
WITH known(name, form) AS (VALUES {values}),
a AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\n[^a-z0-9]*\\n', 'S', 'g'), '\\n[^a-z0-9S]*', 'L', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[.!?;:]([ \\r\\tLS])', 'S\\1', 'g'), '[^a-z0-9SL]+', ' ', 'g') AS t FROM b),
d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[ L]*S[ SL]*', 'S', 'g'), ' ?L ?', 'L', 'g'), ' ') AS t FROM c),
e AS (SELECT doc_id, 'SS' || replace(replace(t, 'S', 'SS'), 'L', 'LL') || 'SS' AS t FROM d),
f AS (SELECT doc_id, regexp_extract_all(t, '{every}') AS hits, string_split_regex(t, '{every}') AS gaps FROM e),
g AS (SELECT doc_id, generate_subscripts(gaps, 1) AS place, unnest(gaps) AS gap, hits FROM f),
h AS (SELECT doc_id, place, CASE WHEN regexp_matches(gap, '[a-z0-9]') THEN '_ ' ELSE '' END AS other, substr(hits[place], 2, length(hits[place]) - 2) AS hit FROM g),
i AS (SELECT DISTINCT hit, name FROM (SELECT DISTINCT hit FROM h WHERE hit IS NOT NULL) JOIN known ON regexp_full_match(hit, form)),
j AS (SELECT doc_id, string_agg(other || coalesce(name || ' ', ''), '' ORDER BY place) AS ids, coalesce(string_agg(name, ',' ORDER BY place), '') AS sentences FROM h LEFT JOIN i USING (hit) GROUP BY 1),
k AS (SELECT doc_id, sentences, list_transform(regexp_extract_all(ids, '{"|".join(f"(?:{rule})" for _, rule in rules)}'), lambda hit: CASE {names} END) AS licenses FROM j)
SELECT doc_id, sentences, coalesce(array_to_string(licenses, ','), '') AS licenses, coalesce(len(licenses), 0)::BIGINT AS n_licenses FROM k"""
