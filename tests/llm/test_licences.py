import math
import re
from collections import Counter

from bazaar.llm import licences as L

FILES = [(1, "a/LICENSE", "The licence\n" + L.TEMPLATES["MIT"]), (2, "a/b/c.py", "x = 1"), (3, "a/b/d.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
         (4, "z.txt", "nothing"), (5, None, None), (6, "a/b/e/COPYING.txt", L.TEMPLATES["GPL-3.0"]), (7, "a/b/e/f/g.c", ""), (8, "LICENSE", "no terms here"),
         (3, "a/b/d.py", "# Licensed under the Apache License, Version 2.0.\ncode"), (9, "q/r.c", "word " * 20_000 + "\nReleased under the MIT License.")]


def test_notices_and_inheritance(spark):
    df = spark.createDataFrame([(*f, "x") for f in FILES], "row long, path string, text string, licence string")
    rows = L.scan(df).collect()
    assert len(rows) == len(FILES)  # the row that stands twice is there twice
    got = {r.row: (r.licence, r.origin, r.from_path) for r in rows}
    assert got == {1: ("MIT", "file", "a/LICENSE"), 2: ("MIT", "inherited", "a/LICENSE"), 3: ("Apache-2.0", "header", "a/b/d.py"),
                   4: (None, "none", None), 5: (None, "none", None), 6: ("GPL-3.0", "file", "a/b/e/COPYING.txt"),
                   7: ("GPL-3.0", "inherited", "a/b/e/COPYING.txt"), 8: (None, "none", None), 9: ("MIT", "header", "q/r.c")}


def test_cosines_equal_brute_force(spark):
    lines = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
             "the GNU public way of the license version", "Released under the MIT License today, we think", "plain words only"]
    df = spark.createDataFrame([(i, f"d/{i}", t) for i, t in enumerate(lines)], "row long, path string, text string")

    def words(t):
        return re.findall(r"[^\W_](?:[\w.-]*[^\W_])?", t.lower())

    n, df_of = len(lines), Counter(w for t in lines for w in set(words(t)))
    known = {w for t in L.TEMPLATES.values() for w in words(t)}

    def vector(t):
        return {w: c * (math.log((n + 1) / ((df_of[w] if w in known else 0) + 1)) + 1) for w, c in Counter(words(t)).items()}

    def cosine(a, b):
        a, b = vector(a), vector(b)
        return sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    wanted = {}
    for i, t in enumerate(lines):
        if len(set(words(t)) & set(L.informative())) >= 2:
            for c, name in sorted(((-round(cosine(t, x), 6), re.sub(r" \(.*", "", name)) for name, x in L.TEMPLATES.items())):
                holds, lacks = L.DEMANDS.get(name, ([], []))
                if all(re.search(p, t) for p in holds) and not any(re.search(p, t) for p in lacks) and -c >= L.THRESHOLD:
                    wanted[i] = (name, -c)
                    break
    got = {r.row: (r.licence, r.cosine) for r in L.scan(df).where("origin = 'header'").collect()}
    assert got.keys() == wanted.keys() and all(got[i][0] == wanted[i][0] and abs(got[i][1] - wanted[i][1]) < 2e-6 for i in got)


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "row long, path string, text string")).collect() == []


HEAD = """This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as
published by the Free Software Foundation{mark2} either version {n} of the License, or (at your option) any later version."""
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def comment(text, width=70):
    import textwrap
    return "int x;\n/*\n" + "\n".join(" * " + x for x in textwrap.wrap(" ".join(text.split()), width)) + "\n *\n * It is distributed in the hope that it will be useful.\n */\nint y;"


FAMILIES = [
    ("GPL-2.0", HEAD.format(what="program", mark=";", mark2=";", kind="", n="2")), ("GPL-3.0", HEAD.format(what="program", mark=":", mark2=",", kind="", n="3")),
    ("LGPL-2.1", HEAD.format(what="library", mark=";", mark2=";", kind="Lesser ", n="2.1")),
    ("LGPL-3.0", HEAD.format(what="program", mark=":", mark2=",", kind="Lesser ", n="3")),
    ("AGPL-3.0", HEAD.format(what="program", mark=":", mark2=",", kind="Affero ", n="3")),
    (None, HEAD.format(what="program", mark=";", mark2=";", kind="", n="4")),
    ("Apache-2.0", L.TEMPLATES["Apache-2.0"]), ("MIT", L.TEMPLATES["MIT (whole)"]), ("MPL-2.0", L.TEMPLATES["MPL-2.0 (whole)"])]


def test_members_of_families(spark, documents):
    rows, want = [], []
    for licence, text in FAMILIES:
        for t in (text, " ".join(text.split()), comment(text), comment(text, 40)):
            rows.append((f"h{len(rows)}/x.c", t))
            want.append(licence)
    for licence, text in [("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD + THIRD), ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only\nint x;"),
                          ("EPL-2.0", "# SPDX-License-Identifier: EPL-2.0"), ("LGPL-2.1", "/* SPDX-License-Identifier: LGPL-2.1-or-later */")]:
        rows.append((f"h{len(rows)}/x.c", text))
        want.append(licence)
    for licence, text in [("GPL-3.0", "      GNU GENERAL PUBLIC LICENSE\n        Version 3, 29 June 2007\n\n" + "Some long text of terms.\n" * 300),
                          ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007\n"), ("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD + THIRD)]:
        rows.append((f"h{len(rows)}/LICENSE", text))
        want.append(licence)
    n = len(rows)
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, path string, text string")
    background = L.paths_of(documents).withColumn("row", L.F.col("row") + 1000)
    got = {r.row: r.licence for r in L.scan(files.unionByName(background)).where(f"row < {n}").collect()}
    assert [got[i] for i in range(n)] == want


def test_rows_that_share_an_id_are_scanned_each(spark):
    rows = [(1, "a/x", L.TEMPLATES["MIT"]), (1, "a/x", L.TEMPLATES["CC-BY-SA-4.0"]), (None, None, L.TEMPLATES["ISC"]), (None, None, None)]
    got = L.scan(spark.createDataFrame(rows, "row long, path string, text string")).collect()
    assert sorted(str(r.licence) for r in got) == ["CC-BY-SA-4.0", "ISC", "MIT", "None"]
