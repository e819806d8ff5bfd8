"""Roll-ups over files, channels and the whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtally.operators.compare import COUNTERS, with_rate


def overall_stats(column_stats: DataFrame) -> DataFrame:
    """Counters per column over all files, with the rate of the summed counters."""
    summed = column_stats.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.count("*").alias("file_count")
    )
    return with_rate(summed)


def display_name(frame: DataFrame, names: DataFrame | None) -> DataFrame:
    """Add ``display``: the name in ``names(_file, display)``, of several the last by order, else the file's own."""
    if names is None:
        return frame.withColumn("display", F.col("_file"))
    own = F.coalesce("display", "_file").alias("display")
    return frame.join(names.groupBy("_file").agg(F.max("display").alias("display")), "_file", "left").select(*frame.columns, own)


def channel_stats(column_stats: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per column and channel."""
    return display_name(column_stats, names).select(
        "column",
        F.col("display").alias("channel"),
        "status",
        "match_rate",
        F.col("exact_matches").alias("matches"),
        "mismatches",
        F.col("total_compared").alias("total"),
    )


def stats_by_level(column_stats: DataFrame) -> DataFrame:
    """Both grouping levels in one pass: per column and file, and per column (``_file`` null)."""
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    col, file = F.col("column"), F.col("_file")
    return with_rate(column_stats.groupingSets([[col, file], [col]], col, file).agg(*sums))


def one_side_empty(column_stats: DataFrame) -> DataFrame:
    return column_stats.withColumn("one_side_empty", F.col("only_1_empty") + F.col("only_2_empty"))


def pair_totals(column_stats: DataFrame) -> DataFrame:
    """Per file: differing cells, the plain mean of its columns' rates, and columns compared."""
    return column_stats.groupBy("_file").agg(
        F.sum("mismatches").alias("total_differences"),
        F.bround(F.avg("match_rate"), 1).alias("avg_match_rate"),
        F.count("*").cast("int").alias("columns_compared"),
    )


def run_summary(pairs: DataFrame, overall: DataFrame) -> DataFrame:
    """One row for the whole run. Both inputs hold one row per file or column; the differences are summed over columns."""
    status = F.col("status")
    ok = status == "success"
    # stacked rather than joined: two kinds of rows, one aggregation
    columns = overall.select(F.col("match_rate").alias("_rate"), F.col("mismatches").alias("_differing"))
    both = pairs.unionByName(columns, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0).cast("bigint"))
    return both.agg(
        F.count_if(status != "unpaired").alias("total_pairs"),
        F.count_if(ok).alias("success"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "error").alias("failed"),
        total(F.col("common")).alias("total_skus"),
        F.coalesce(F.sum("_differing"), F.lit(0).cast("bigint")).alias("total_diffs"),
        total(F.col("only_1") + F.col("only_2")).alias("total_missing"),
        F.coalesce(F.bround(F.avg("_rate"), 1), F.lit(0.0)).alias("avg_match_rate"),
    )
