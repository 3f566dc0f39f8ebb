import hashlib
import random

import corpus_pipeline as p
from roadlens.llm import scratch, simhash, toxicity
from tests.llm import fixtures as fx
from tests.llm import test_decontaminate as dc
from tests.llm import test_pack as pk
from tests.llm import test_simhash as sh
from tests.llm import test_suffix as sx

SF = fx.SF


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, toxicity.training(spark.read.parquet(f"{SF}/labels.parquet")))
    marked = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    one = p.toxic(spark, docs, SF)
    assert one.columns == docs.columns and rows(one) == [r for r in rows(docs) if r[0] not in marked]
    two = p.near_duplicates(spark, one, SF)
    assert two.columns == docs.columns
    assert [r[0] for r in rows(two)] == sorted((r[0] for r in sh.brute(rows(one)) if r[2]), key=str)
    three = p.repeated_strings(spark, two, SF)
    assert three.schema.simpleString() == docs.schema.simpleString()
    want = {r[0]: (r[1] - r[2], r[4]) for r in sx.brute(rows(two), 100)}
    for i, t in rows(three):
        exact = hashlib.sha256(t.encode()).hexdigest() == want[i][1]
        assert exact or len(t.encode()) < want[i][0]  # half characters at an edge are dropped
    four = p.decontaminated(spark, three, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in dc.brute(rows(three), items) if r[5]}
    assert rows(four) == [r for r in rows(three) if r[0] not in bad] and bad
    five = p.packed(spark, four, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in five) == pk.brute(rows(four))
    pk.filled(five)
    whole = sorted(map(tuple, p.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert whole == pk.brute(rows(four))


def test_odd_rows_and_extra_columns(spark):
    data = fx.odd_documents() + [(None, "a null id", "en", None, 3)]
    docs = fx.frame(spark, data, clash=("score", "key", "kept", "predicted", "z"))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = rows(out)
        assert (None, "a null id") in got and (10_000, None) in got
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert len(rows(p.near_duplicates(spark, docs, SF))) < len(data)
    assert p.packed(spark, docs, SF).count() >= len(data)


def test_unrelated_documents_are_not_fetched_as_near_ones(spark, monkeypatch):
    """At 50 bits one in a hundred pairs is near by chance, as is a pair for every text of millions at 36."""
    rng = random.Random(9)
    data = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(400)]
    near, whole = [], scratch.table

    def table(df, tag):
        out = whole(df, tag)
        if tag == "near":
            near.extend(out.collect())
        return out

    monkeypatch.setattr(scratch, "table", table)
    monkeypatch.setattr(simhash, "NEAR", 50)
    out = p.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), SF)
    assert rows(out) == sorted(data, key=str) and not near
