"""Gapless numbers within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtally.session import scratch_folder, stored


def numbered(df: DataFrame, group: list[str], part: Column, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 in the order of ``part``, then ``order``.

    ``part`` cuts each group into parts that are numbered by themselves; the sizes of the parts that come before are
    added. So no task sorts more than one part of a group.
    """
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    local = rows.withColumn("_row", F.row_number().over(within) - 1)
    return local.join(starts, [*group, "_part"]).withColumn(name, F.col("_row") + F.col("_start")).drop("_part", "_row", "_start")


ROWS_PER_PART = 1 << 18
BUCKET_BYTES = 32 << 20  # input whose entries one bucket gets, about


def bucket_count(df: DataFrame) -> int:
    """How many buckets a table's entries are dealt into, each a group that one task holds whole: by the input's bytes, so that groups don't grow with it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # rows that no file holds have no size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // BUCKET_BYTES + 1)


def in_order(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """A stored table with ``pos``, the place of a row in its group from 0 in ascending ``order`` (nulls first), and ``n``, its group's rows.

    Rows are dealt by ranges of group and order, so that a group or an order key of any share is spread over tasks; only
    the sizes of these ranges are added up. Rows alike in all order columns are told apart by where they stand in the table.
    ``df`` must be a stored table and have no column ``pos``, ``n``, ``_tie``, ``_part`` or ``_start``.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS_PER_PART + 1)
    keys = [group, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the upper bits of these ids are the range's number, the lower ones count its rows
    dealt = stored(dealt.drop("_tie").withColumn("pos", F.monotonically_increasing_id()), scratch_folder(spark, "ordered"))
    part = F.shiftright("pos", 33)
    sizes = dealt.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    starts = sizes.select("_group", "_part", start.alias("_start"), F.sum("_n").over(Window.partitionBy("_group")).alias("n"))
    placed = dealt.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part")))
    return placed.withColumn("pos", F.col("pos") + F.col("_start")).drop("_group", "_part", "_start")
