"""A corpus pipeline of the text operators: each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm.common import table, without
from terrafold.llm.decontaminate import find_leaks
from terrafold.llm.jaccard import jaccard_join
from terrafold.llm.packing import best_fit_packing
from terrafold.llm.quality import keep_good
from terrafold.llm.secrets import redact
from terrafold.session import ready, shared_folder


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    return keep_good(docs, table(ready(spark), sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that Jaccard links (five words, 0.8) connect.

    Rows with one doc_id stay or go together; rows without a doc_id stay.
    """
    groups = jaccard_join(docs, words=5, limit=80)
    others = groups.filter("doc_id != component_id").select("doc_id").distinct()
    return without(docs, others)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without(docs, leaks)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens."""
    return best_fit_packing(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]
#: The classifier, the alignment and the packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    out, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
    return docs
