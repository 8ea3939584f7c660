"""Documents to training tokens: quality, near duplicates, decontamination, personal data, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of their input; the last adds n_tokens, ids and the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cyclelake.llm import bpe, decontaminate, jaccard, pii, quality
from cyclelake.llm.common import fold, free_names, stored, table
from cyclelake.llm.queries import THRESHOLD, VOCABULARY

TOKEN_COLUMNS = ["n_tokens", "ids", "decoded"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the classifier learns from the labelled ones among them."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    (score,) = free_names(docs, "score")
    scored = quality.score(docs, weights, docs.columns, name=score)
    return scored.where(F.col(score) >= THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more: candidates from SimHash
    segments, then from prefix shingles, all verified."""
    return jaccard.one_per_component(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    selector = pii.fit(stored(pii.scan(docs, [])))
    clean = pii.redact(docs, selector)
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return clean.withColumn("n_chars", length)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text decoded from them; they replace columns of these names."""
    keep = [c for c in docs.columns if c not in TOKEN_COLUMNS]
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), keep)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("bpe", encode_tokens),
]

# Training, hashing and tokenising have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
