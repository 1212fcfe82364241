"""A corpus pipeline: each stage takes the documents that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import delete, shared_root
from tabulith.llm.decontam import drop_leaks
from tabulith.llm.jaccard_join import jaccard_groups
from tabulith.llm.line_dedup import dedup_lines
from tabulith.llm.mixing import mix
from tabulith.llm.quality import quality_rules
from tabulith.llm.queries import test_items, trusted_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules(docs, trusted_ids(spark, sf_dir)).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; n_chars is that of the new text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the least id (null last), of several texts of one id that of least hash.

    Rows of one id and one text are one document; rows of one id and different texts are judged each for itself.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    groups = jaccard_groups(keyed, id_col="_row").select("_row", "component_id").distinct()
    ids = keyed.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("order")).distinct()
    stay = groups.join(ids, "_row").groupBy("component_id").agg(F.min("order")["_row"].alias("_row")).select("_row")
    return keyed.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_leaks(docs, test_items(spark, sf_dir))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn, with their topic, tokens, probability and weight."""
    return mix(docs).filter("drawn").drop("drawn", "rate")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontaminate), ("mixing to target weights", mixture)]

#: Hashed log-likelihood ratios and searches are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder, read by the next and then deleted."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}")
        if k:
            delete(spark, f"{root}/{k - 1}")
    return docs
