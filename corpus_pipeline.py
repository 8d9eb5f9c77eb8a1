"""The corpus pipeline: toxicity, quality, near-duplicates, decontamination, packing.

Each stage takes the documents its predecessor kept and returns rows with the same columns; the
last returns the pieces of packed sequences with their token ids. run() writes what each stage returns to the shared
folder and reads it back, so no stage is worked out twice and lost executors cost one stage's
tasks at most.

Rows with a null or empty text go through every stage like others; rows with a null doc_id are
never dropped as copies, since their group can't name one to stay. Of equal rows, and of rows
alike in doc_id and text, one stays; of copies with equal ids the one of the least set of
shingles. Other columns, of any names, come through all stages but the last, which returns the
columns of packing alone. An empty table gives an empty table. Each stage asks the session for
small Arrow batches, which bounds its tasks' memory.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import quality, toxicity
from pairloom.llm.common import small_batches, table
from pairloom.llm.decontamination import drop_contaminated
from pairloom.llm.near_copies import drop_near_copies
from pairloom.llm.packing import pack_documents
from pairloom.plans.scratch import drop_scratch, materialise


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    small_batches(spark)
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies: similarity 0.8 or more of five-word shingles."""
    small_batches(spark)
    return drop_near_copies(docs, similarity=0.8, words_per_shingle=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with their ids."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: The classifiers and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        drop_scratch(before)
    return docs
