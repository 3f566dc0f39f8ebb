import zlib

import numpy as np

from roadlens.llm import shard
from tests.llm import fixtures as fx


def test_difference_balances():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 10_000, 3000)
    where, sums = shard.difference(x, 24)
    back = np.bincount(where, x, 24)
    assert sorted(back) == sorted(sums) and back.max() - back.min() <= 5
    m = rng.integers(0, 1000, (7, 24))
    perm, total = shard.difference(m, 24)
    assert all(sorted(p) == list(range(24)) for p in perm)
    back = np.zeros(24, int)
    for row, p in zip(m, perm, strict=True):
        np.add.at(back, p, row)
    assert sorted(back) == sorted(total)
    assert shard.difference(np.array([5, 5]), 3)[1].tolist() == [0, 5, 5]


def test_rows(spark):
    rows = fx.odd_documents() + [(30_000 + i, "same text again", None, None, 1) for i in range(40)] + [(40_000 + i, None, None, None, 1) for i in range(30)]
    for each in (100_000, 20):
        got = shard.by_bytes(fx.frame(spark, rows, clash=("size", "group", "shard")), groups_per_task=each).collect()
        want = sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
        assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        text = {r[0]: r[1] for r in rows}
        homes = {}
        for r in got:
            if text[r["doc_id"]] is not None:
                homes.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        assert all(len(x) == 1 for x in homes.values())
    assert len({r["shard"] for r in got if 40_000 <= r["doc_id"]}) > 1


def test_empty(spark):
    assert shard.by_bytes(spark.createDataFrame([], fx.SCHEMA)).collect() == []
