"""Licences of files by sparse TF-IDF cosine to templates, inherited from the nearest ancestor directory.

DataFrame functions only.  A file is compared as its lines, as its paragraphs (lines up to the next one
without a letter or digit, comment marks not counting, which is what a wrapped header is) and as a
whole (a licence file).  Templates are notices, headings and full short licences.

A unit's weights are (1 + ln tf) * idf (idf over the templates; terms of no template weigh most).  With K the
norm of its terms that any template has and N the norm of all, no cosine exceeds K / N
(Cauchy-Schwarz); a unit for which that bound is below the threshold goes, within its row, before
anything is exploded.  That loses nothing, and few units are left.  Their terms are exploded once per
distinct text, and dot products come from an equi-join with the constant template table.

A file whose licence units are at least half of its bytes, or whose name says so (license, licence,
copying, unlicense) and that has a licence unit, is a licence file and speaks for its directory: of
several the largest cosine, then the least path.  Files without a unit of their own take the licence
of the nearest ancestor directory that has one; that is resolved once per distinct directory, then
joined to the files by directory, so a directory with a third of the files is no hot group.

Defined cases: a null or empty text has no units and can still inherit; a null path gets no
inheritance; ties between templates go to the first by name; repeated rows each get a row, also where
one id has several texts; extra columns are dropped.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
NAMED = r"(?i)^(un)?licen[sc]e(\.[a-z]+)?$|^copying(\.[a-z]+)?$"

MIT_WHOLE = """MIT License

Copyright (c) year name

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "ISC License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", MIT_WHOLE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

SPLIT = "[^a-z0-9]+"
PARAGRAPH = "\\n[^A-Za-z0-9]*\\n"


def weights(templates=None) -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """(template key, term, unit weight) rows, idf by term, and the idf of any other term."""
    templates = templates or TEMPLATES
    terms = [[t for t in re.split(SPLIT, text.lower()) if t] for _, text in templates]
    df: dict[str, int] = {}
    for t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    n = len(templates)
    idf = {x: math.log((1 + n) / (1 + d)) + 1 for x, d in df.items()}
    rows = []
    for i, t in enumerate(terms):
        w = {x: (1 + math.log(t.count(x))) * idf[x] for x in set(t)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        rows += [(f"{templates[i][0]}#{i:03d}", x, v / norm) for x, v in sorted(w.items())]
    return rows, idf, math.log(1 + n) + 1


def _units(text, idf: dict[str, float], other: float, threshold: float):
    """The text's units (kind, number, bytes, terms) that the bound K / N lets pass, as an array column."""
    paragraphs = F.split(text, PARAGRAPH)

    def unit(kind, number, x):
        return F.struct(F.lit(kind).alias("kind"), number.alias("number"), F.octet_length(x).alias("bytes"), F.filter(F.split(F.lower(x), SPLIT), lambda t: t != "").alias("terms"))

    blocks = F.transform(F.filter(paragraphs, lambda x: x.contains("\n")), lambda x, i: unit("block", i, x))
    once = F.when(F.size(paragraphs) > 1, F.array(unit("whole", F.lit(0), text))).otherwise(F.array())
    units = F.concat(F.transform(F.split(text, "\n"), lambda x, i: unit("line", i, x)), blocks, once)
    by_idf: dict[float, list[str]] = {}
    for t, w in sorted(idf.items()):
        by_idf.setdefault(w, []).append(t)

    def idf2(t):
        out = None
        for w, ts in sorted(by_idf.items()):
            out = (F.when if out is None else out.when)(t.isin(ts), F.lit(w * w))
        return out

    known = F.transform(units, lambda u: F.struct(*(u[c].alias(c) for c in ("kind", "number", "bytes", "terms")), F.filter(u["terms"], lambda t: t.isin(sorted(idf))).alias("mine")))
    least = (threshold - 1e-6) ** 2

    def passes(u):
        def square(run):  # of the damped count
            return F.when(run > 0, F.pow(1 + F.log(run), F.lit(2.0))).otherwise(0.0)

        def add(s, t):  # over the sorted terms, each run adds up to the square of its damped length
            run = F.when(s["last"] == t, s["run"] + 1).otherwise(F.lit(1))
            return F.struct(t.alias("last"), run.alias("run"), (s["k2"] + idf2(t) * (square(run) - square(run - 1))).alias("k2"))

        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("k2"))
        strange = (F.size(F.array_distinct(u["terms"])) - F.size(F.array_distinct(u["mine"]))) * (other * other)
        return F.aggregate(F.array_sort(u["mine"]), start, add, lambda s: s["k2"] * (1 - least) >= strange * least)

    return F.filter(known, lambda u: (F.size(u["mine"]) > 0) & passes(u))


def lines(files: DataFrame, threshold: float = THRESHOLD, templates=None) -> DataFrame:
    """The best unit of each distinct text that has one: (key, license, cosine, licence bytes).

    files: (key, text), key the text's digest.  Bytes are the greatest of those of lines, blocks, whole.
    """
    spark = files.sparkSession
    rows, idf, other = weights(templates)
    values = ", ".join(f"('{k}', '{t}', {w!r}D, {idf[t]!r}D)" for k, t, w in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, term, w, idf)")  # a local table, no Python anywhere
    unit = ["key", "kind", "number"]
    own = files.select("key", F.explode(_units(F.col("text"), idf, other, threshold)).alias("u")).select("key", "u.kind", "u.number", "u.bytes", "u.terms").dropDuplicates(unit)
    terms = own.select(*unit, "bytes", F.explode("terms").alias("term"))
    tf = terms.groupBy(*unit, "bytes", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    known = F.broadcast(table.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("template", "w")).alias("in_templates")))
    q = tf.join(known, "term", "left").select(*unit, "bytes", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("q"), "in_templates")
    norm = q.groupBy(*unit).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("norm"))
    dots = q.select(*unit, "bytes", "q", F.explode("in_templates").alias("t")).groupBy(*unit, "bytes", F.col("t.template").alias("template")).agg(F.sum(F.col("q") * F.col("t.w")).alias("dot"))
    cosines = dots.join(norm, unit).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= threshold)
    first = F.struct((-F.col("cosine")).alias("far"), "template")
    best = cosines.groupBy(*unit).agg(F.min(first).alias("best"), F.first("bytes").alias("bytes"))
    size = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("bytes"))), F.lit(0)) for k in ("line", "block", "whole")]
    found = best.groupBy("key").agg(F.min("best").alias("best"), F.greatest(*size).alias("bytes"))
    return found.select("key", F.substring_index("best.template", "#", 1).alias("license"), (-F.col("best.far")).alias("cosine"), "bytes")


def scan(files: DataFrame, threshold: float = THRESHOLD, templates=None) -> DataFrame:
    """files (id, path, text) to (id, path, license, cosine, inherited, from_dir)."""
    found = lines(files.select(F.md5("text").alias("key"), "text"), threshold, templates)
    names = files.select("id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.md5("text").alias("key"))
    named = names.join(found, "key", "left")
    speaks = F.col("license").isNotNull() & F.col("path").isNotNull() & (F.regexp_extract("path", "([^/]*)$", 1).rlike(NAMED) | (F.col("bytes") * 2 >= F.col("size")))
    voices = named.where(speaks).groupBy("dir").agg(F.min_by(F.struct("license", "cosine"), F.struct(-F.col("cosine"), "path")).alias("x")).select(F.col("dir").alias("from_dir"), "x.*")
    # the ancestors of each distinct directory, itself first; joined by path
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/")) - 1), lambda i: F.struct(i.alias("up"), F.array_join(F.slice(F.split("dir", "/"), 1, F.size(F.split("dir", "/")) - i), "/").alias("from_dir")))
    dirs = names.where("path is not null").select("dir").distinct().select("dir", F.explode(up).alias("a")).select("dir", "a.up", "a.from_dir")
    near = dirs.join(voices, "from_dir").groupBy("dir").agg(F.min_by(F.struct("license", "cosine", "from_dir"), "up").alias("inh"))
    out = named.join(near, "dir", "left")
    return out.select(
        "id",
        "path",
        F.coalesce("license", "inh.license").alias("license"),
        F.coalesce("cosine", "inh.cosine").alias("cosine"),
        (F.col("license").isNull() & F.col("inh").isNotNull()).alias("inherited"),
        F.when(F.col("license").isNull(), F.col("inh.from_dir")).alias("from_dir"),
    )


def sql(threshold: float = THRESHOLD) -> str:
    """The query op6 in DuckDB SQL: every unit of every text, without the bound."""
    rows, idf, other = weights()
    values = ", ".join(f"('{k}', '{t}', {w!r}::double, {idf[t]!r}::double)" for k, t, w in rows)
    return f"""
WITH t(template, term, w, idf) AS (VALUES {values}),
files AS (SELECT doc_id AS id, text, '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path,
  '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS dir FROM documents),
blocks AS (SELECT id, string_split_regex(text, '{PARAGRAPH}') AS ps FROM files WHERE text IS NOT NULL),
units AS (SELECT id, 'line' AS kind, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM files WHERE text IS NOT NULL
  UNION ALL SELECT id, 'block', unnest(ps), generate_subscripts(ps, 1) FROM blocks
  UNION ALL SELECT id, 'whole', text, 0 FROM files JOIN blocks USING (id) WHERE len(ps) > 1),
own AS (SELECT id, kind, number, u, strlen(u) AS bytes FROM units WHERE kind <> 'block' OR contains(u, chr(10))),
terms AS (SELECT id, kind, number, bytes, unnest(string_split_regex(lower(u), '{SPLIT}')) AS term FROM own),
tf AS (SELECT id, kind, number, bytes, term, 1 + ln(count(*)) AS tf FROM terms WHERE term <> '' GROUP BY ALL),
q AS (SELECT id, kind, number, bytes, tf.term, tf * coalesce(k.idf, {other!r}::double) AS q FROM tf LEFT JOIN (SELECT DISTINCT term, idf FROM t) k USING (term)),
norm AS (SELECT id, kind, number, sqrt(sum(q * q)) AS norm FROM q GROUP BY ALL),
cosines AS (SELECT q.id, q.kind, q.number, q.bytes, template, round(sum(q * w) / any_value(norm), 6) AS cosine FROM q
  JOIN norm ON q.id = norm.id AND q.kind = norm.kind AND q.number = norm.number JOIN t ON q.term = t.term GROUP BY ALL),
best AS (SELECT id, kind, number, bytes, max(cosine) AS cosine, arg_min(template, (-cosine, template)) AS template FROM cosines WHERE cosine >= {threshold} GROUP BY ALL),
found AS (SELECT id, max(cosine) AS cosine, split_part(arg_min(template, (-cosine, template)), '#', 1) AS license,
  greatest(coalesce(sum(bytes) FILTER (kind = 'line'), 0), coalesce(sum(bytes) FILTER (kind = 'block'), 0), coalesce(sum(bytes) FILTER (kind = 'whole'), 0)) AS bytes FROM best GROUP BY id),
named AS (SELECT files.id, path, dir, strlen(coalesce(text, '')) AS size, license, cosine, bytes FROM files LEFT JOIN found USING (id)),
voices AS (SELECT dir AS from_dir, arg_min(license, (-cosine, path)) AS license, max(cosine) AS cosine FROM named WHERE license IS NOT NULL AND bytes * 2 >= size GROUP BY ALL),
dirs AS (SELECT DISTINCT dir FROM files),
up AS (SELECT dir, dir AS from_dir, 0 AS up FROM dirs UNION ALL SELECT dir, regexp_replace(dir, '/[^/]*$', ''), 1 FROM dirs UNION ALL SELECT dir, '', 2 FROM dirs),
near AS (SELECT dir, arg_min(struct_pack(license := voices.license, cosine := voices.cosine, from_dir := voices.from_dir), up.up) AS inh FROM up JOIN voices ON up.from_dir = voices.from_dir GROUP BY dir)
SELECT id AS doc_id, path, coalesce(license, inh.license) AS license, coalesce(cosine, inh.cosine) AS cosine,
  license IS NULL AND inh IS NOT NULL AS inherited, CASE WHEN license IS NULL THEN inh.from_dir END AS from_dir
FROM named LEFT JOIN near USING (dir)"""
