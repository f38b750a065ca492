"""From raw documents to packed token sequences, as stages over Parquet.

1. toxicity: documents that the language models call toxic go.
2. line_dedup: lines of any length that an earlier line equals or nearly equals go; a document goes when no word of it is left.
3. jaccard_join: one document of each group of near copies stays.
4. decontamination: documents that hold a benchmark item go.
5. packing: what is left is tokenised and packed into sequences of 1024 tokens.

Every stage reads all that its predecessor kept.  Defined results: null and empty texts pass all filters and are packed as end
tokens; of rows that repeat a doc_id and a text one stays, rows that share a doc_id or have none are judged by their own text;
empty tables give no rows (without labels nothing is toxic, without items nothing is contaminated).  Columns beyond those of
``documents`` pass all stages but packing; only one named ``n_lines`` or ``n_removed`` is replaced on the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffloom.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from staffloom.llm.common import WORD, stored
from staffloom.llm.queries import byte_bpe, table


#: Words of a shingle and percent of similarity from which documents are near copies.
NEAR_COPY = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup(docs, line_dedup.WIDE)
    kept = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*(f"`{c}`" for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, *NEAR_COPY)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"), by_text=True)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_documents),
]

#: Trained models, tokenising and alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
