"""From raw documents to packed sequences: quality classifier, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of `docs`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.mixing import mix
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.quality import keep_good
from quillgraph.llm.simhash import keep_one
from quillgraph.llm.tables import table
from quillgraph.plans.cut import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learnt from `labels`, does not reject. A null text scores as an empty one."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, null ids last."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix draws them: not at all, or up to three times."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each drawn document, with its sequence and its place there."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier, the hashes and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table of documents. Of the stages' files those of the last one stay; the others go when the next stage is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    docs, old = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        new = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(new)
        if old:
            files.delete(path(old), True)
        docs, old = spark.read.parquet(new), new
    return docs
