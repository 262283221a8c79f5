"""Documents to tokens: quality rules, line and document deduplication, mixing, byte-level BPE.

Each stage takes the documents that the one before kept and returns the columns of
documents; the last one adds the token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import bpe, jaccard, lines, mixing, rules
from wavemill.llm.common import cut_lineage, table

#: Documents of this Jaccard similarity or more are near-duplicates.
LEAST_ALIKE = 0.8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the learned list rejects go; a null or empty text
    goes (no words); repeated rows are judged alike."""
    learned = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.judge(docs, learned).filter("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came before go; n_chars follows the text. No document goes, an emptied or null one
    included; repeated rows stay alike."""
    out = lines.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one document stays: that of the lowest doc_id (null last).

    Links are SimHash tiles and minima keys, verified by a Jaccard similarity of five-word
    shingles of LEAST_ALIKE or more. A row without a doc_id goes if another row stands for
    it; of rows with the same doc_id and text one stays; empty and null texts are alike.
    """
    return jaccard.representatives(docs, LEAST_ALIKE).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it; without words, or with a null text, not at all."""
    measured = mixing.measure(docs)
    slim = cut_lineage(measured.select("source", *mixing.MEASURES))
    return mixing.repeat(mixing.mix(measured, mixing.plan(slim))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the token ids of its whole text; none for null and empty ones. Repeated rows stay."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: Edit distances and token ids are beyond SQL, so tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir)) if stage is not tokens else stage(spark, docs, sf_dir)
    return docs
