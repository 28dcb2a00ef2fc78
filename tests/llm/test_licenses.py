"""License scans against SQL and on whole licence texts."""

import textwrap

import duckdb

from quern.llm import licenses as lic


def words_of(name):
    return lic.SENTENCES[name].replace("<*>", "the copyright holder")


def text_of(*names, gap=""):
    return f"\n{gap}\n".join(words_of(n) for n in names)


CASES = [
    (None, []),
    ("", []),
    ("Nothing of the kind. No licence at all.", []),
    ("x y z.\nReleased under the MIT License.", ["MIT"]),
    ("RELEASED  under the\tmit license!! Licensed under CC BY-NC 4.0. Released under the MIT License.", ["MIT", "CC-BY-NC-4.0", "MIT"]),
    (text_of("mit_grant", "mit_notice", "mit_warranty", "mit_liability"), ["MIT"]),
    (text_of("mit_grant", "mit_notice", "mit_warranty", gap="A line between. And another."), ["MIT"]),
    (text_of("mit_notice", "mit_grant"), []),
    (text_of("apache_grant", "apache_use", "apache_copy", "apache_basis", "apache_see", gap=""), ["Apache-2.0"]),
    (text_of("bsd_grant", "bsd_source", "bsd_binary"), ["BSD-2-Clause"]),
    (text_of("bsd_grant", "bsd_source", "bsd_binary", "bsd_names"), ["BSD-3-Clause"]),
    (text_of("gpl3_grant", "gpl_hope", "gpl_see", "mit_short"), ["GPL-3.0", "MIT"]),
    ("mit_grant mit_notice mit_warranty", []),
    ("This program is free software; enjoy it.", []),
    ("This program is free software; enjoy it. All rights reserved. See v. 2.0. for more", ["all-rights-reserved"]),
    ("Use v. 2.0. of it, with permission.", []),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;", ["GPL-2.0-or-later"]),
    ("# SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: MIT OR ISC\n", ["MIT"]),
    ("This is free and unencumbered software released into the\n public domain.", ["Unlicense"]),
    ("filler words here. " * 30_000 + "Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)] * 2, "doc_id long, text string, licenses string")
    got = lic.scan(df).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert r.licenses == CASES[r.doc_id][1], r.doc_id
    assert lic.scan(df.limit(0)).count() == 0


def test_each_sentence_is_a_rule_or_part_of_one():
    used = {w.rstrip("?") for _, rule in lic.RULES for w in rule.split()} - {"_"}
    assert used == set(lic.SENTENCES)


BSD = """Copyright (c) 1994, The Some Authors. All rights reserved.

   Redistribution and use in source and binary forms, with or without
   modification, are permitted provided that the following conditions are met:

   1. Redistributions of source code must retain the above copyright notice,
      this list of conditions and the following disclaimer.
   2. Redistributions in binary form must reproduce the above copyright notice,
      this list of conditions and the following disclaimer in the documentation
      and/or other materials provided with the distribution.
   3. Neither the name of the Some Company nor the names of its contributors may
      be used to endorse or promote products derived from this software without
      specific prior written permission.
"""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
GPL = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
WHOLE = [(BSD, ["all-rights-reserved", "BSD-3-Clause"]), (MIT, ["MIT"]), (GPL, ["GPL-2.0"]), (GPL.replace("# ", "").replace("#", ""), ["GPL-2.0"])]


def test_whole_licence_texts(spark):
    got = lic.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WHOLE)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [want for _, want in WHOLE]


def test_cues_stand_within_words():
    for name, sentence in lic.SENTENCES.items():
        assert any(c in word for c in lic.CUES for word in lic.normal(sentence.replace("<*>", "")).split()), name


def test_sql_on_cases(spark):
    """The query and the SQL agree on wrapped, commented and cut texts too."""
    texts = [t for t, _ in CASES + WHOLE] + [APACHE, "s l S L Released under the MIT License"] + [wrapped(*names, lead=lead, width=44, items=True) for names, _ in WRAPPED for lead in ("", "# ")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.sql(lic.op1_sql()).select("doc_id, sentences, licenses").fetchall()
    found = lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, ",".join(r.sentences), ",".join(r.licenses)) for r in found) == sorted(want)


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(lic.op1_sql()).select("doc_id, sentences, licenses, n_licenses").fetchall()
    got = [tuple(r) for r in lic.op1_licenses(spark, sf).select("doc_id", "sentences", "licenses", "n_licenses").collect()]
    assert sorted(got) == sorted(want) and any(r[3] for r in got)


def wrapped(*names, lead="", width=72, items=False):
    lines = []
    for k, n in enumerate(names):
        lines += [*textwrap.wrap((f"{k}. " if items and k else "") + words_of(n), width), ""]
    return "\n".join((lead + x).rstrip() for x in lines)


WRAPPED = [
    (("mit_grant", "mit_notice", "mit_warranty", "mit_liability"), ["MIT"]),
    (("apache_grant", "apache_use", "apache_copy", "apache_basis", "apache_see"), ["Apache-2.0"]),
    (("bsd_grant", "bsd_source", "bsd_binary"), ["BSD-2-Clause"]),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_names"), ["BSD-3-Clause"]),
    (("gpl3_grant", "gpl_hope", "gpl_see"), ["GPL-3.0"]),
    (("lgpl_grant",), ["LGPL-2.1"]),
    (("isc_grant",), ["ISC"]),
    (("mpl2_grant",), ["MPL-2.0"]),
    (("cc_by_sa_grant",), ["CC-BY-SA-4.0"]),
]
APACHE = """/*
 * Copyright 2020 Some Authors
 * Licensed under the Apache License, Version 2.0 (the "License"); you may not
 * use this file except in compliance with the License. You may obtain a copy of
 * the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
 * WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
 * License for the specific language governing permissions and limitations under
 * the License.
 */
int x;"""


def test_wrapped_texts(spark):
    cases = [(wrapped(*names, lead=lead, width=width, items=True).replace("\n", end), want) for names, want in WRAPPED for lead in ("", " * ", "# ", "// ", ";; ") for width in (40, 76) for end in ("\n", "\r\n")]
    cases += [(APACHE, ["Apache-2.0"]), ("Some title\nReleased under the MIT License\nmore", ["MIT"]), ("Released under\n\nthe MIT License.", []), ("\n * " * 50_000 + "Released under the\nMIT License.", ["MIT"])]
    got = lic.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    for r in got:
        assert r.licenses == cases[r.doc_id][1], cases[r.doc_id][0][:400]
    assert "apache_copy" in got[len(cases) - 4].sentences and "apache_see" in got[len(cases) - 4].sentences
