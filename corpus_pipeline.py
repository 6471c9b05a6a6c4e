"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``; each works
on everything that its predecessor kept. ``run`` applies them to ``documents``.

1. quality: documents that the classifier rejects go;
2. near_duplicates: of each group the document with the smallest id stays;
3. decontamination: documents of which benchmark passages make up 1/20 go;
4. secrets: base and entropy spans are replaced by a mark, n_chars follows;
5. packing: token pieces with their sequence and offset.

Null text counts as empty in every stage, an empty table gives an empty result,
columns beyond those of ``documents`` pass through until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontam, hyperminhash, packing, quality_knn, secret_scan
from strata.llm.common import shipped, table
from strata.operators.materialize import materialize


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.keep_first(docs)


@shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@shipped
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out


@shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", pack)]

#: The classifier and the tokenizer can't be expressed in SQL; the tests hold
#: the pipeline against a brute-force version.
ORACLE_SQL = None


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
