"""Operator 5: the exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtally.llm.encoding import encoder
from rowtally.llm.words import batches_of
from rowtally.session import scratch_folder, stored

BLOCK = 1024


def token_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Encoded length ``n_tokens`` and number ``documents`` of texts of that length, per task and batch."""

    def count(batches):
        for batch in batches_of(batches, text, 12 << 20):
            _, bounds = encoder(tokenizer).encode(batch.column(text))
            lengths, n = np.unique(np.diff(bounds), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(n, pa.int64())], ["n_tokens", "documents"])

    return docs.select(text).mapInArrow(count, "n_tokens long, documents long")


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row per encoded length that occurs; null texts count as empty, an empty table gives no row.

    ``documents``, ``tokens`` of that length; ``documents_up_to``, ``tokens_up_to`` of at most that length;
    ``documents_over`` of a greater length; ``truncated_tokens``: what is left of all documents when each is cut to this
    length. Counts travel as (length, count) pairs summed in each task, so that copies and hot sources weigh nothing.
    Running sums go over blocks of 1,024 lengths first, then within a block.
    """
    n = F.col("n_tokens")
    by_length = token_lengths(docs, tokenizer, text).groupBy("n_tokens").agg(F.sum("documents").alias("documents"))
    by_length = by_length.select("n_tokens", "documents", (n * F.col("documents")).alias("tokens"), F.floor(n / BLOCK).alias("_block"))
    by_length = stored(by_length, scratch_folder(docs.sparkSession, "lengths"))
    blocks = by_length.groupBy("_block").agg(F.sum("documents").alias("_d"), F.sum("tokens").alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_block", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
        F.sum("_d").over(whole).alias("_all"))
    within = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = by_length.join(blocks, "_block").select(
        "n_tokens", "documents", "tokens", "_all",
        (F.col("_d0") + F.sum("documents").over(within)).alias("documents_up_to"),
        (F.col("_t0") + F.sum("tokens").over(within)).alias("tokens_up_to"))
    over = F.col("_all") - F.col("documents_up_to")
    return out.select("n_tokens", "documents", "tokens", "documents_up_to", "tokens_up_to", over.alias("documents_over"),
                      (F.col("tokens_up_to") + over * n).alias("truncated_tokens"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: tokens left when every document is cut to it, tokens lost, and documents cut."""
    n, d = F.col("n_tokens"), F.col("documents")
    limit = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    rows = histogram.select("n_tokens", "documents", limit)
    kept = F.least(n, F.col("context_limit")) * d
    return rows.groupBy("context_limit").agg(
        F.sum(kept).alias("tokens"), F.sum(n * d - kept).alias("lost_tokens"), F.sum(F.when(n > F.col("context_limit"), d).otherwise(0)).alias("cut_documents"))


def length_quantiles(histogram: DataFrame, fractions: list[float]) -> DataFrame:
    """The smallest length that at least this share of the documents doesn't exceed."""
    total = F.col("documents_up_to") + F.col("documents_over")
    fraction = F.explode(F.array(*[F.lit(float(x)) for x in fractions])).alias("fraction")
    rows = histogram.select("n_tokens", "documents_up_to", total.alias("_all"), fraction)
    return rows.filter(F.col("documents_up_to") >= F.col("fraction") * F.col("_all")).groupBy("fraction").agg(F.min("n_tokens").alias("n_tokens"))
