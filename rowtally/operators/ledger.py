"""The key ledger: which keys each side holds. Reads key columns only.

``raw_keys`` and ``ledger_side`` aggregate map-side first, so a key holding a third of all rows
reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtally.functions.keys import with_key
from rowtally.functions.values import strip

PAIR = ["_key", "_file"]  # the key first: sorts and hashes start on the selective column


def raw_keys(rows: DataFrame) -> DataFrame:
    """``rows(_file, _raw, _ord)`` to one row per spelling, with its row count and first position."""
    return rows.groupBy("_file", "_raw").agg(F.count("*").alias("rows"), F.min("_ord").alias("_ord"))


def ledger_side(spellings: DataFrame, **key_options) -> DataFrame:
    """One row per comparison key: rows, non-empty spellings and the spelling seen first.

    Rows without a key stay, under the key '', so that row counts come from the same pass.
    """
    return (
        with_key(spellings, "_raw", "_key", keep_blank=True, **key_options)
        .groupBy(*PAIR)
        .agg(
            F.sum("rows").alias("rows"),
            F.count_if(F.col("_raw") != "").alias("spellings"),
            strip(F.min_by("_raw", "_ord")).alias("raw_sku"),
        )
    )


def key_ledger(side_1: DataFrame, side_2: DataFrame) -> DataFrame:
    """Full outer join of both sides' keys; a side's columns are null where it lacks the key."""
    cols = ["rows", "spellings", "raw_sku"]
    one = side_1.select(*PAIR, *[F.col(c).alias(f"{c}_1") for c in cols])
    two = side_2.select(*PAIR, *[F.col(c).alias(f"{c}_2") for c in cols])
    return one.join(two, PAIR, "full_outer")


def key_presence(ledger: DataFrame) -> DataFrame:
    """Each key with ``both``, ``only_1`` or ``only_2``."""
    where = F.when(F.col("rows_2").isNull(), "only_1").when(F.col("rows_1").isNull(), "only_2").otherwise("both")
    return ledger.select("_file", F.col("_key").alias("sku"), where.alias("presence"))


def common_keys(ledger: DataFrame) -> DataFrame:
    return _keys(ledger, F.col("rows_1").isNotNull() & F.col("rows_2").isNotNull())


def only_in_1(ledger: DataFrame) -> DataFrame:
    return _keys(ledger, F.col("rows_2").isNull())


def only_in_2(ledger: DataFrame) -> DataFrame:
    return _keys(ledger, F.col("rows_1").isNull())


def _keys(ledger: DataFrame, condition) -> DataFrame:
    return ledger.filter(condition).select("_file", F.col("_key").alias("sku"))


def missing_keys(ledger: DataFrame) -> DataFrame:
    """Keys of one side only, in the spelling first seen there. Order when writing, not here."""
    gone_from_1 = F.col("rows_1").isNull()
    return ledger.filter(gone_from_1 | F.col("rows_2").isNull()).select(
        "_file",
        F.when(gone_from_1, 1).otherwise(2).cast("string").alias("missing_in"),
        F.col("_key").alias("sku"),
        F.coalesce("raw_sku_1", "raw_sku_2").alias("raw_sku"),
    )


def key_counts(ledger: DataFrame) -> DataFrame:
    """Per file: rows, distinct raw keys, keys of each side, shared keys, surplus rows of repeated keys.

    ``duplicates_*`` count over all keys of a side, ``common_duplicates_*`` over shared keys only.
    """
    r1, r2 = F.col("rows_1"), F.col("rows_2")
    key = F.col("_key") != ""
    both = key & r1.isNotNull() & r2.isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return ledger.groupBy("_file").agg(
        total(r1).alias("rows_1"),
        total(r2).alias("rows_2"),
        total(F.col("spellings_1")).alias("raw_distinct_1"),
        total(F.col("spellings_2")).alias("raw_distinct_2"),
        F.count_if(key & r1.isNotNull()).alias("keys_1"),
        F.count_if(key & r2.isNotNull()).alias("keys_2"),
        F.count_if(both).alias("common"),
        F.count_if(key & r2.isNull()).alias("only_1"),
        F.count_if(key & r1.isNull()).alias("only_2"),
        total(F.when(key, r1 - 1)).alias("duplicates_1"),
        total(F.when(key, r2 - 1)).alias("duplicates_2"),
        total(F.when(both, r1 - 1)).alias("common_duplicates_1"),
        total(F.when(both, r2 - 1)).alias("common_duplicates_2"),
    )
