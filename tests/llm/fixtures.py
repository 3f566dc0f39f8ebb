"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"


def documents(n=None):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return rows[:n]


def odd_documents():
    """Rows (doc_id, text, lang, source, n_chars) with odd cases beside ordinary ones."""
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in documents(60)]
    words = [f"w{i}" for i in range(500)]
    long_text = " ".join(rng.choice(words) for _ in range(40_000))
    extra = [None, "", " ", "!!!", "a", "it's she'll I've 'tis don''t 42nd x²", "你好 世界 \U0001f600 café ΣΑΣ", "éa <|endoftext|> b", long_text, long_text, "\x00\x01 nul"]
    rows += [(10_000 + i, t, None if i % 2 else "en", None, 0) for i, t in enumerate(extra)]
    rows.append(rows[0])
    rows.append((20_000, rows[1][1], "en", "src1", 1))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, clash=()):
    """A DataFrame of rows; each name of clash becomes an extra column."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in clash}) if clash else df
