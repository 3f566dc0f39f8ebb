import hashlib
import re

from roadlens.llm import decontaminate as d
from tests.llm import fixtures as fx

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return WORD.findall(t)


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if m := wins.get(tuple(w[k : k + n])):
                    found |= m
                    hit |= set(range(k, k + n))
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out)


def case():
    docs = [(r[0], r[1]) for r in fx.odd_documents()]
    base = words(docs[8][1]) + words(docs[9][1])
    items = [(1, " ".join(base[:25])), (2, " ".join(base[5:15])), (3, "A"), (4, None), (5, ""), (6, " ".join(base[3:7])), (7, " ".join(base[5:15])), (10, "zz " * 30)]
    docs += [(900, "x y " + " ".join(base[2:14]).upper() + "!! " + " ".join(base[5:14])), (901, " ".join(base[5:14])), (902, "zz " * 50), (903, " ".join(base[5:15]))]
    return docs, items


def run(spark, docs, items, **kw):
    from pyspark.sql import functions as F

    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("item_id", F.lit("clash")).withColumn("n_words", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    return a, b, sorted(tuple(r)[:6] for r in d.decontaminate(a, b, **kw).collect())


def test_against_brute_force(spark):
    docs, items = case()
    a, b, got = run(spark, docs, items)
    assert got == brute(docs, items)
    clean = sorted(r["doc_id"] for r in d.drop_contaminated(a, b).collect())
    assert clean == sorted(x[0] for x in brute(docs, items) if not x[5])
    assert d.drop_contaminated(a, b).columns == a.columns


def test_blocks_give_the_same(spark):
    docs, items = case()
    assert run(spark, docs, items, block_windows=7)[2] == brute(docs, items)


def test_empty_tables(spark):
    docs, items = case()
    assert run(spark, [], items)[2] == []
    assert run(spark, docs, [])[2] == brute(docs, [])
