"""First row per key on each side, joined on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rowtally.operators.ledger import PAIR


def first_per_key(keyed: DataFrame) -> DataFrame:
    """Keep the first row of every key in ``_ord`` order.

    Spark limits each task to one row per key before the shuffle, so duplicates of a hot key never
    travel, and the result stays partitioned and sorted for the join that follows.
    """
    order = Window.partitionBy(*PAIR).orderBy("_ord")
    return keyed.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_ord")


def align(first_1: DataFrame, first_2: DataFrame) -> DataFrame:
    """Shared keys with both sides' cells. At most one row per key and side, so the join cannot skew."""
    return first_1.join(first_2, PAIR, "inner")
