"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

1. Every line of every text, and every block of lines between lines without letters, is a *notice* candidate if it holds two different
   words that tell licences apart (``informative``).  For a file whose name says that it is a licence file, its whole text is one
   candidate too.
2. Words are weighted by term frequency times the logarithm of inverse document frequency.  Document frequencies of all words
   that occur in templates are counted over the whole table; any other word weighs as one that occurs in no document.
3. A candidate's licence is the template with the largest cosine, ``THRESHOLD`` or more (of equal ones the first name), among those whose
   ``DEMANDS`` it meets: members of a family are near to one another in words, so a version, or a word like Lesser or Affero, has to be
   there before a member is named.  The weights of the templates, a list whose size the templates fix, are broadcast.
4. A tag ``SPDX-License-Identifier:`` names its licence itself, with cosine 1.
5. A file's own notice is the candidate with the largest cosine (of equal ones the first line).  Files without
   one inherit from the licence file of the nearest directory above them: distinct directories are spread to their
   ancestors, joined by path, and the deepest match is taken; a directory with a million files is one row there.

Null and empty texts have no notice but inherit like others; a null path has no directory.  Rows that repeat an id and a path
are scanned each by their own text.  Of several licence files in one directory the one with the largest cosine counts, then the first path.
Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.common import stored

THRESHOLD = 0.6

#: Names of public licences and the notices by which texts refer to them; ``short`` ones, headers, titles of full texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
    "Apache-2.0 (short)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (title)": "Apache License Version 2.0, January 2004",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files, to deal in the Software without restriction",
    "MIT (whole)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                   "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
                   "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
                   "persons to whom the Software is furnished to do so, subject to the following conditions",
    "MIT (short)": "Released under the MIT License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met",
    "BSD-2-Clause (whole)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                            "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
                            "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
                            "copyright notice, this list of conditions and the following disclaimer in the documentation",
    "BSD-2-Clause (short)": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met",
    "BSD-3-Clause (third)": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                            "products derived from this software without specific prior written permission.",
    "BSD-3-Clause (whole)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                            "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
                            "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
                            "copyright notice, this list of conditions and the following disclaimer in the documentation. Neither the name "
                            "of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                            "from this software without specific prior written permission.",
    "BSD-3-Clause (short)": "Licensed under the BSD 3-Clause License.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-2.0 (title)": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-2.0 (short)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-3.0 (title)": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-3.0 (short)": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                "Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "LGPL-2.1 (title)": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-2.1 (short)": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                "Public License as published by the Free Software Foundation, either version 3 of the License",
    "LGPL-3.0 (title)": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0 (short)": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                "Public License as published by the Free Software Foundation, either version 3 of the License",
    "AGPL-3.0 (title)": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "AGPL-3.0 (short)": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0 (whole)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                       "distributed with this file, You can obtain one at mozilla.org/MPL/2.0",
    "MPL-2.0 (title)": "Mozilla Public License Version 2.0",
    "CC-BY-4.0 (short)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (short)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (short)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
_LESSER, _AFFERO, _THIRD = r"(?i)\blesser\b|\blibrary\s+general", r"(?i)\baffero\b", r"(?i)neither\W+the\W+names?\b|\b3-clause"
_SHARE, _TRADE = r"(?i)share-?alike|\bby-(?:nc-)?sa\b", r"(?i)non-?commercial|\bby-nc\b"
_VERSION_2, _VERSION_3 = (rf"(?i)\b(?:version|v\.?|gpl-?v?)\s*{n}(?!\.?[1-9])" for n in "23")
#: What a notice must hold (and must not hold) to be of a licence; for the BSD family, what the whole file must.
DEMANDS = {
    "Apache-2.0": ([r"2\.0"], []), "MPL-2.0": ([r"2\.0"], []), "BSD-2-Clause": ([], [_THIRD]), "BSD-3-Clause": ([_THIRD], []),
    "GPL-2.0": ([_VERSION_2], [_LESSER, _AFFERO]), "GPL-3.0": ([_VERSION_3], [_LESSER, _AFFERO]),
    "LGPL-2.1": ([_LESSER, r"2\.1"], []), "LGPL-3.0": ([_LESSER, _VERSION_3], []), "AGPL-3.0": ([_AFFERO, _VERSION_3], []),
    "CC-BY-4.0": ([r"4\.0"], [_SHARE, _TRADE]), "CC-BY-SA-4.0": ([r"4\.0", _SHARE], [_TRADE]), "CC-BY-NC-4.0": ([r"4\.0", _TRADE], [_SHARE]),
}
_VARIANT = r" \(\w+\)$"
_SPDX = r"SPDX-License-Identifier:\s*\(?([A-Za-z0-9][A-Za-z0-9.+-]*)"
#: Words of templates that also stand in any other text.
_COMMON = frozenset("a all and any are as at by can either for form forms has in into is it may not of on or other possible that the "
                    "this to under use used with without work you following met file files person source program author "
                    "2 3 1 0 2.0 3 4.0 1.0 v version extent above law following associated related purpose "
                    "including limitation rights copies copy do so subject persons whom provided must list from name names nor neither its "
                    "specific prior written products if one was be library code january february june november 29 19 1991 1999 2004 2007 "
                    "2.1 notice conditions document".split())
_WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?"
_LICENCE_FILE = r"(?i)^(un)?(licen[sc]es?|copying|copyright|notice)([.-][^/]*)?$"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _weights(files: DataFrame) -> tuple[DataFrame, float]:
    """(word, idf, weights: map template -> weight) of the templates' words, and the idf of a word that is in no file."""
    spark = files.sparkSession
    templates = spark.createDataFrame(sorted(TEMPLATES.items()), "template string, notice string")
    terms = templates.select("template", F.explode(words(F.col("notice"))).alias("word")) \
        .groupBy("template", "word").agg(F.count("*").alias("tf"))
    vocabulary = [r[0] for r in terms.select("word").distinct().collect()]  # as many as the templates have
    here = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    df = stored(files.select(F.explode(here).alias("word")).groupBy("word").agg(F.count("*").alias("df")), "licence-words")
    n = files.count()
    rarest = float(_log(n + 1)) + 1
    idf = terms.join(F.broadcast(df), "word", "left") \
        .withColumn("idf", F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)  # vocabulary words at most
    norm = F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).over(Window.partitionBy("template")))
    weighted = idf.withColumn("w", F.col("tf") * F.col("idf") / norm)
    return weighted.groupBy("word").agg(F.max("idf").alias("idf"), F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("template", "w")))).alias("weights")), rarest


def _log(x: float) -> float:
    from math import log

    return log(x)


def informative() -> list[str]:
    found = {w for t in TEMPLATES.values() for w in re.findall(r"[^\W_](?:[\w.-]*[^\W_])?", t.lower())}
    return sorted(found - _COMMON)


def _allowed(notice: Column, third: Column) -> Column:
    """The licences whose demands a notice meets; ``third``: whether the file has a third clause of the BSD family."""
    meets = {_THIRD: third} | {p: notice.rlike(p) for holds, lacks in DEMANDS.values() for p in holds + lacks if p != _THIRD}
    names = sorted({re.sub(_VARIANT, "", t) for t in TEMPLATES})
    cases = []
    for name in names:
        holds, lacks = DEMANDS.get(name, ([], []))
        good = reduce(lambda a, b: a & b, [meets[p] for p in holds] + [~meets[p] for p in lacks], F.lit(True))
        cases.append(F.when(good, F.lit(name)))
    return F.array_compact(F.array(*cases))


def notices(files: DataFrame) -> DataFrame:
    """(path, row, own, file, licence, cosine, line): the best notice of each of ``files`` (path, row, own, text) that has one;
    ``own`` is a hash of the text, ``file`` tells licence files."""
    weights, rarest = _weights(files)
    telling = F.array(*map(F.lit, informative()))
    is_file = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(_LICENCE_FILE), F.lit(False))
    lines = F.split("text", r"\R")
    blocks = F.filter(F.split("text", r"\R[^\p{L}\r\n]*\R"), lambda b: F.trim(b).rlike(r"\R"))  # a block of one line is that line
    parts = F.concat(lines, blocks)
    third = F.col("text").rlike(_THIRD)
    candidates = (files.select("path", "row", "own", is_file.alias("file"), third.alias("third"), F.posexplode(
        F.when(is_file, F.concat(F.array("text"), parts)).otherwise(parts)).alias("line", "notice"))
        .where(F.col("notice").rlike(r"\p{L}"))
        .withColumn("words", words(F.col("notice")))
        .where(F.size(F.array_intersect("words", telling)) >= 2)
        .withColumn("allowed", _allowed(F.col("notice"), F.col("third"))))
    of_line = ["path", "row", "own", "file", "line", "allowed"]
    terms = candidates.select(*of_line, F.explode("words").alias("word")).groupBy(*of_line, "word").agg(F.count("*").alias("tf"))
    terms = terms.join(F.broadcast(weights), "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rarest)))
    length = terms.groupBy(*of_line).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = terms.select(*of_line, "x", F.explode("weights").alias("template", "w")) \
        .groupBy(*of_line, "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in of_line]
    cosine = dots.alias("a").join(length.alias("b"), same).select(
        *(f"a.{c}" for c in of_line), F.regexp_replace("a.template", _VARIANT, "").alias("licence"),
        F.round(F.col("a.dot") / F.col("b.length"), 6).alias("cosine")).where(F.col("cosine") >= THRESHOLD)
    cosine = cosine.where(F.array_contains("allowed", F.col("licence"))).drop("allowed")
    tag = F.regexp_replace(F.regexp_extract("notice", _SPDX, 1), r"(?:-only|-or-later|\+)$", "")
    tags = files.where(F.col("text").contains("SPDX-License-Identifier")).select(
        "path", "row", "own", is_file.alias("file"), F.posexplode(lines).alias("line", "notice")).withColumn("licence", tag).where("licence != ''")
    found = cosine.unionByName(tags.select(*cosine.columns[:-2], "licence", F.lit(1.0).alias("cosine")))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("line"), F.col("licence"))).alias("m")
    return found.groupBy("path", "row", "own", "file").agg(best).select(
        "path", "row", "own", "file", "m.licence", (-F.col("m.c")).alias("cosine"), "m.line")


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, down from the root, which is the empty path."""
    parts = F.split(directory, "/")
    return F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """(row, path, licence, cosine, origin, from_path) of each row of ``files`` (row, path, text).

    ``row`` tells rows apart; ``origin`` is file, header, inherited or none.
    """
    files = files.select("row", "path", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    own = stored(notices(files), "notices")
    in_directory = own.where("file").withColumn("dir", directory(F.col("path"))).groupBy("dir").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path"), F.col("licence"))).alias("m"))
    spread = files.select(directory(F.col("path")).alias("dir")).where("dir is not null").distinct() \
        .withColumn("above", F.explode(ancestors(F.col("dir"))))
    nearest = F.max(F.struct(F.length("above").alias("depth"), F.col("m")))
    given = spread.join(in_directory.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(nearest.alias("n")) \
        .select("dir", F.col("n.m.licence").alias("i_licence"), F.col("n.m.path").alias("i_path"), (-F.col("n.m.c")).alias("i_cosine"))
    rows = files.select("row", "path", "own").withColumn("dir", directory(F.col("path")))
    # Written, so that both sides of the join are dealt out for it and a hot directory can be split.
    rows = rows.join(stored(given, "given-licences"), "dir", "left")
    o = own.select(F.col("row").alias("_row"), F.col("path").alias("_path"), F.col("own").alias("_own"), "file", "licence", "cosine")
    rows = rows.join(o, F.col("row").eqNullSafe(F.col("_row")) & F.col("path").eqNullSafe(F.col("_path")) & (F.col("own") == F.col("_own")), "left")
    has = F.col("licence").isNotNull()
    return rows.select(
        "row", "path", F.coalesce("licence", "i_licence").alias("licence"), F.coalesce("cosine", "i_cosine").alias("cosine"),
        F.when(has & F.col("file"), "file").when(has, "header").when(F.col("i_licence").isNotNull(), "inherited")
        .otherwise("none").alias("origin"), F.when(has, F.col("path")).otherwise(F.col("i_path")).alias("from_path"))


def paths_of(documents: DataFrame) -> DataFrame:
    """(row, path, text): documents have no paths, so they are laid out as source/lang/doc_id.txt; one that consists
    of a single line of 30 words or fewer about a licence is taken for that directory's licence file."""
    alone = (F.size(F.split(F.trim("text"), r"\s+")) <= 30) & ~F.trim("text").contains("\n") & F.col("text").rlike("(?i)licen[sc]e")
    name = F.when(alone, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))) \
        .otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select(F.col("doc_id").alias("row"), F.concat_ws("/", "source", "lang", name).alias("path"), "text")
