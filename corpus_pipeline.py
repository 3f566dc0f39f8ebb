"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs.  ``run`` writes what a stage returns as Parquet and rereads it as the next stage's docs.

Defined cases are those of the operators: null and empty texts pass every filter and end as a piece of
one closing id; rows of one doc_id are versions of one document, of which the one whose text has the
least digest stays, once; extra columns travel along to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm import decontaminate, pack, scratch, simhash, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bounded(stage):
    """A stage whose Arrow batches stay small, also where it is called on its own."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.bounded(spark)
        return stage(spark, docs, sf_dir)

    return run


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not mark; it learns from the labels' training fold."""
    model = toxicity.fit(_table(spark, sf_dir, "documents"), toxicity.training(_table(spark, sf_dir, "labels")))
    names = [c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]  # no clash with the score's columns
    scored = toxicity.score(docs.toDF(*names), model, with_text=True)
    return scored.where("predicted = 0").select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of least id; rows without an id stay."""
    gone = simhash.classes(docs).where(F.col("class_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    ids = docs.where("doc_id is not null").select("doc_id")
    if ids.count() == ids.distinct().count():
        return left
    # versions of one document: always the same one stays
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    some = left.where("doc_id is not null").withColumn("_digest", digest)
    least = some.groupBy("doc_id").agg(F.min("_digest").alias("_digest"))
    one = some.join(least, ["doc_id", "_digest"], "left_semi").dropDuplicates(["doc_id", "_digest"])
    return one.select(*(F.col(f"`{c}`") for c in docs.columns)).union(left.where("doc_id is null"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that an earlier document or place has."""
    keep = [c for c in docs.columns if c != "text"]
    left = suffix.strip(docs, keep)
    left = left.select(*(F.col(f"`{c}`") for c in keep), F.col("_kept").alias("text"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of any benchmark item."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens."""
    return pack.pack(docs).drop("copy")


STAGES = [(name, _bounded(f)) for name, f in (("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("decontamination", decontaminated), ("packing", packed))]

#: SQL can express neither the classifier nor tokens; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch.scope() as keep:  # a stage's own tables go with it, and its input
            docs = keep(scratch.table(stage(spark, docs, sf_dir), name))
        if hasattr(before, "scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
