"""Corpus pipeline: quality rules, near and substring de-duplication, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns the columns of
documents, but for the last, which returns the pieces of packed sequences. run() writes each stage to the shared folder
and reads it again, so a lost executor costs at most one stage.

n_chars follows the text wherever a stage changes it. Near-dedup goes by the text alone and keeps one row of each group;
a doc_id may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.llm._common import passing, stored
from pagelake.llm.neardup import near_classes, text_key
from pagelake.llm.packing import pack
from pagelake.llm.quality import V1, accepted
from pagelake.llm.secrets import family_cut, masker
from pagelake.llm.substring import cleaned
from pagelake.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps."""
    return accepted(docs, V1)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest doc_id, a null one last, and of that the smallest text.

    Texts are near from a Jaccard similarity of 0.8. The group goes with the text, so a doc_id may repeat or be null.
    """
    by = Window.partitionBy("_group")
    rows = docs.select("doc_id", text_key().alias("_key")).join(near_classes(docs).withColumnRenamed("key", "_key"), "_key", "left")
    rows = rows.groupBy("_key", "doc_id", F.coalesce("root", "_key").alias("_group")).agg(F.count("*").alias("n"))
    several = rows.groupBy("_group").agg(F.sum("n").alias("_n")).where("_n > 1")
    rows = stored(rows.join(several, "_group"), "neardup-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")).over(by)
    first = rows.withColumn("least", least).where(F.col("doc_id").eqNullSafe(F.col("least.doc_id")))
    first = first.select("_key", F.col("doc_id").alias("_id"), "_group")
    # a row alone in its group stays where it is; only the others' texts are shuffled
    met, alone = passing(docs.withColumn("_key", text_key()), "_key", rows.select("_key"))
    alone = alone.unionByName(met.join(rows.select("_key"), "_key", "left_anti"))
    found = met.join(first, (met["_key"] == first["_key"]) & met["doc_id"].eqNullSafe(first["_id"])).drop("_key", "_id")
    found = found.withColumn("_n", F.row_number().over(by.orderBy("text"))).where("_n = 1")
    return alone.select(*docs.columns).unionByName(found.select(*docs.columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of words that a document of smaller doc_id has."""
    return cleaned(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    text = masker(family_cut(docs))(F.col("text"))
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: Packing, minimizers and fingerprints have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
