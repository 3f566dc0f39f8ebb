import collections
import functools
import math
import re
import textwrap

import pytest

from roadlens.llm import licenses as lic


ROWS, IDF, OTHER = lic.weights()
MINE = {}
for _key, _term, _w in ROWS:
    MINE.setdefault(_key, {})[_term] = _w


@functools.cache
def cosines(unit):
    tf = collections.Counter(t for t in re.split(lic.SPLIT, unit.lower()) if t)
    q = {t: (1 + math.log(n)) * IDF.get(t, OTHER) for t, n in tf.items()}
    norm = math.sqrt(sum(v * v for v in q.values())) or 1.0
    return [(-round(sum(q[t] * mine.get(t, 0) for t in q) / norm, 6), k) for k, mine in sorted(MINE.items())]


def units(text):
    """(kind, unit) of a text: lines, paragraphs of several lines, and the whole where it has several."""
    paragraphs = re.split(lic.PARAGRAPH, text)
    out = [("line", x) for x in text.split("\n")] + [("block", x) for x in paragraphs if "\n" in x]
    return out + ([("whole", text)] if len(paragraphs) > 1 else [])


def brute(files):
    found = {}
    for n, (_, _, text) in enumerate(files):
        best, size = [], {"line": 0, "block": 0, "whole": 0}
        for kind, unit in units(text or ""):
            c = [x for x in cosines(unit) if -x[0] >= lic.THRESHOLD]
            if c:
                best.append(min(c))
                size[kind] += len(unit.encode())
        if best:
            c, k = min(best)
            found[n] = (k.split("#")[0], -c, max(size.values()))
    voices = {}
    for n, (_, path, text) in enumerate(files):
        if path and n in found:
            name = path.rsplit("/", 1)[-1]
            if re.search(lic.NAMED, name) or found[n][2] * 2 >= len((text or "").encode()):
                voices.setdefault(path.rsplit("/", 1)[0], []).append((-found[n][1], path, found[n][0]))
    out = []
    for n, (i, path, _) in enumerate(files):
        if n in found:
            out.append((i, found[n][0], found[n][1], False, None))
            continue
        d = path.rsplit("/", 1)[0] if path else None
        while d is not None and d not in voices:
            d = d.rsplit("/", 1)[0] if "/" in d else None
        if d is None:
            out.append((i, None, None, False, None))
        else:
            c, _, name = min(voices[d])
            out.append((i, name, -c, True, d))
    return sorted(out, key=lambda g: (g[0], str(g[1]), g[3]))


GPL3 = next(i for i, (k, t) in enumerate(lic.TEMPLATES) if k == "GPL-3.0" and t.startswith("This program"))
FILES = [
    (1, "/a/LICENSE", "Released under the MIT License.\n" + "word " * 200),
    (2, "/a/b/x.txt", "nothing here"),
    (3, "/a/b/c/y.txt", "plain\nLicensed under the Apache License, Version 2.0.\nmore " + "word " * 50),
    (4, "/a/b/c/z.txt", "All rights are wrong"),
    (5, "/d/e.txt", "x"),
    (6, "/d/GPL.txt", "This work is licensed under the GNU General Public License, version 3."),
    (7, "/d/f/g/h.txt", None),
    (8, "/d/f/LICENCE.md", "All rights reserved.\nLicensed under CC BY-NC 4.0.\n" + "filler " * 90),
    (9, None, "Licensed under CC BY 4.0."),
    (10, None, None),
    (11, "/top.txt", ""),
    (12, "/a/b/copying", "no licence line in this file that would count"),
    (13, "/d/f/g/i.txt", "Copyright. LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!!"),
    (14, "/r/LICENSE", "unrelated words " * 40),
    (15, "/w/main.c", "/*\n * " + "\n * ".join(textwrap.wrap(dict(enumerate(lic.TEMPLATES))[GPL3][1], 60)) + "\n */\n\nint main;\n" + "int x;\n" * 30),
    (16, "/m/COPYING", lic.MIT_WHOLE.replace("year name", "2019 somebody")),
    (17, "/m/x/y.c", "int y;"),
    (20, "/twice/1", "Released under the MIT License."),
    (20, "/twice/1", "unlike text"),
    (20, "/twice/1", "Released under the MIT License."),
    (21, "/long.txt", "the of and this work is to any person\n" * 200 + "Licensed under CC BY 4.0.\n" + "w " * 100_000),
    (22, "/g/LICENSE", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone may copy this.\n"),
    (23, "/i/one.txt", "MIT License  Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (24, "/b/LICENSE", "BSD 3-Clause License\n\nCopyright"),
    (25, "/x/LICENSE", "Mozilla Public License, version 2.0"),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame(FILES, "id long, path string, text string").selectExpr("*", "1 as license", "'x' as cosine").repartition(3)
    order = lambda g: (g[0], str(g[1]), g[3])
    got = sorted(((r["id"], r["license"], r["cosine"], r["inherited"], r["from_dir"]) for r in lic.scan(df).collect()), key=order)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in brute(FILES)]
    for g, w in zip(got, brute(FILES), strict=True):
        assert g[2] == (None if w[2] is None else pytest.approx(w[2], abs=2e-6))


def test_standard_licences_are_found(spark):
    df = spark.createDataFrame(FILES, "id long, path string, text string")
    got = {r["path"]: r["license"] for r in lic.scan(df).collect()}
    want = {"/w/main.c": "GPL-3.0", "/m/COPYING": "MIT", "/m/x/y.c": "MIT", "/g/LICENSE": "GPL-3.0", "/b/LICENSE": "BSD-3-Clause", "/x/LICENSE": "MPL-2.0", "/long.txt": "CC-BY-4.0"}
    assert {p: got[p] for p in want} == want


def test_one_id_with_several_texts(spark):
    rows = [(1, "/q/1", "Released under the MIT License."), (1, "/q/1", "no licence"), (None, "/z/2", "Licensed under CC BY 4.0."), (None, None, None)]
    got = lic.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()
    assert len(got) == 4 and sorted(str(r["license"]) for r in got) == ["CC-BY-4.0", "MIT", "MIT", "None"]


def test_empty_and_repeated(spark):
    schema = "id long, path string, text string"
    assert lic.scan(spark.createDataFrame([], schema)).collect() == []
    many = [(i, f"/p/{i}.txt", "Released under the MIT License.") for i in range(5)]
    assert {r["license"] for r in lic.scan(spark.createDataFrame(many, schema)).collect()} == {"MIT"}
