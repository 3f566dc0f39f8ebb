"""The queries of this subpackage: name to function of (spark, sf_dir), and the SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from . import scratch

    scratch.bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(doc_id: str, n: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each whole text, learned from the rows outside the held-out fold."""
    from . import langid

    docs = _read(spark, sf_dir, "documents")
    held = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    out = langid.predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 2048 tokens."""
    from . import pack

    return pack.pack(_read(spark, sf_dir, "documents")).drop("copy")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from . import simhash

    return simhash.classes(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each whole text, learned from labels outside the held-out fold."""
    from . import toxicity

    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training(_read(spark, sf_dir, "labels")))
    held = F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), model)


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each whole text left after removing repeated 100-byte strings."""
    from . import suffix

    return suffix.dedup(_read(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of each document as a file /source/lang/doc_id.txt, by its lines or its directories."""
    from . import licenses

    docs = _read(spark, sf_dir, "documents")
    none = F.lit("none")
    path = F.concat(F.lit("/"), F.coalesce("source", none), F.lit("/"), F.coalesce("lang", none), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return licenses.scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal label with cosine 0.93 or more."""
    from . import vectors

    return vectors.link(_read(spark, sf_dir, "embeddings"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes, equal texts together."""
    from . import shard

    return shard.by_bytes(_read(spark, sf_dir, "documents"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and unigram log10 probabilities of each whole text."""
    from . import ppm

    docs = _read(spark, sf_dir, "documents")
    held = F.coalesce(_remainder("doc_id", 7) == 2, F.lit(False))
    out = ppm.score(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside occurring benchmark windows."""
    from . import decontaminate

    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_pack, op3_simhash, op4_toxicity, op5_suffix, op6_licenses, op7_vectors, op8_shard, op9_ppm, op10_decontaminate)}


def _oracle() -> dict[str, str]:
    from . import licenses, oracles

    return {"op6_licenses": licenses.sql(), **oracles.ORACLE}


ORACLE: dict[str, str] = _oracle()
