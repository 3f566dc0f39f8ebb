"""The queries as registered: columns, folds, one row per document or piece, rows without an id."""

import zlib

import pyarrow.parquet as pq
import pytest

from roadlens.llm import decontaminate, langid, pack, ppm, registry, shard, toxicity
from tests.llm import fixtures as fx

COLUMNS = {
    "op1_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_pack": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_simhash": {"doc_id": "bigint", "class_id": "bigint", "kept": "boolean"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_suffix": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_licenses": {"doc_id": "bigint", "license": "string", "inherited": "boolean"},
    "op7_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_shard": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_ppm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
}
FOLDS = {"op1_langid": (4, 2), "op4_toxicity": (5, 0), "op9_ppm": (7, 2)}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    df = registry.QUERIES[name](spark, fx.SF)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    table, key = ("embeddings", "vec_id") if name == "op7_vectors" else ("documents", "doc_id")
    ids = sorted(pq.read_table(f"{fx.SF}/{table}.parquet").column(key).to_pylist())
    assert sorted(r[key] for r in rows if name != "op2_pack" or r["piece"] == 0) == ids
    if name in FOLDS:
        n, held = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == held) for r in rows)


def test_rows_without_an_id(spark):
    rows = [(None, "the words of a text without an id", "en", "s", 1), (None, None, None, None, None), (1, "the words of another text", "en", "s", 1)]
    docs = fx.frame(spark, rows)
    assert len(langid.predict(docs, langid.fit(docs)).collect()) == 3
    assert pack.pack(docs).where("piece = 0").count() == 3
    assert shard.by_bytes(docs).count() == 3
    assert ppm.score(docs, docs).count() == 3
    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 3
    items = spark.createDataFrame([(7, "the words of a text")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).count() == 3


def test_bytes_are_balanced(spark):
    sizes = {}
    for r in registry.op8_shard(spark, "/root/testdata/sf0.01").collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 0.001 * max(sizes.values())
