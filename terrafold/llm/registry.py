"""The queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm.common import table
from terrafold.llm.decontaminate import find_leaks
from terrafold.llm.divergence import source_divergence
from terrafold.llm.fingerprints import fingerprints
from terrafold.llm.html import extract_text
from terrafold.llm.jaccard import jaccard_join
from terrafold.llm.language_model import language_model_scores
from terrafold.llm.licenses import license_scan
from terrafold.llm.oracles import ORACLE_SQL
from terrafold.llm.packing import best_fit_packing
from terrafold.llm.prefix_trie import prefix_trie
from terrafold.llm.quality import quality_scores
from terrafold.llm.secrets import secret_scan
from terrafold.llm.tokens import token_counts
from terrafold.llm.warc import archive_pages


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = language_model_scores(table(spark, sf_dir, "documents"), order=3)
    return scores.withColumns({"score": F.round("score", 4), "mean_score": F.round("mean_score", 6)})


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), words=3, limit=90)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


OPERATORS = (
    op1_document_fingerprints, op2_quality_classifier, op3_lm_scoring, op4_ngram_jaccard_join, op5_license_scan, op6_secret_scan,
    op7_benchmark_decontamination, op8_html_extraction, op9_best_fit_packing, op10_token_counts,
    op11_source_divergence_audit, op12_conversation_prefix_trie, op13_warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
