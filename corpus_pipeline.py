"""A training corpus from raw documents in five stages; each keeps the columns of its input but for the last."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtally.llm import contamination, jaccard, packing, substrings, toxicity
from rowtally.llm.queries import TOKENIZER, table
from rowtally.session import scratch_folder, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Learnt from all labels of these documents."""
    machine = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    score = toxicity.free_name(docs)
    return toxicity.with_score(docs, machine, score).filter(F.col(score) < 0.5).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles the smallest doc_id stays. Rows without
    doc_id stay; of rows that share a doc_id all stay or go."""
    groups = jaccard.jaccard_groups(docs, n=5, percent=80)
    gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of 20 words are cut out of the texts. A text without repeats stays as it is; one of which nothing is left goes."""
    cut = substrings.remove_repeats(docs, window=20, texts=True)
    out = cut.filter("n_removed = 0 OR kept_text <> ''").withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    leaks = contamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of at most 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# The classifier, hashed windows and tokens of the stages are nothing SQL can state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), scratch_folder(spark, name))
    return STAGES[-1][1](spark, docs, sf_dir)
