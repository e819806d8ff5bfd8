"""Report tables: the result frames under the names and in the shape readers of the report expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtally.operators.rollup import channel_stats, display_name

EMPTY = "EMPTY"  # fixed value: marks the empty side of a difference
BOM = "\ufeff"


def diff_table(diffs: DataFrame, names=None, labels=("Value_F1", "Value_F2"), merged=False, catalogue=False) -> DataFrame:
    """Differences with ``EMPTY`` marks and the sides' labels.

    Merged differences carry their file as ``File`` (``Channel`` in catalogue mode); otherwise ``_file``
    stays for partitioning.
    """
    shown = display_name(diffs, names)
    mark = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(EMPTY))
    file = ("Channel" if catalogue else "File") if merged else "_file"
    return shown.select(
        F.col("display").alias(file), "sku", "column",
        mark("value_1").alias(labels[0]), mark("value_2").alias(labels[1]),
    )


def column_table(stats: DataFrame) -> DataFrame:
    """Match rate per column over all files, worst first."""
    return stats.select(
        F.col("column").alias("Column"), F.col("status").alias("Status"), F.col("match_rate").alias("Match_Rate_%"),
        F.col("exact_matches").alias("Matches"), F.col("mismatches").alias("Mismatches"), F.col("total_compared").alias("Total"),
    ).orderBy("`Match_Rate_%`", "Column")


def channel_table(column_stats: DataFrame, names=None) -> DataFrame:
    """Match rate per column and channel, worst first."""
    c = channel_stats(column_stats, names)
    return c.select(
        F.col("column").alias("Column"), F.col("channel").alias("Channel"), F.col("status").alias("Status"),
        F.col("match_rate").alias("Match_Rate_%"), F.col("matches").alias("Matches"),
        F.col("mismatches").alias("Mismatches"), F.col("total").alias("Total"),
    ).orderBy("`Match_Rate_%`", "Column", "Channel")


def files_table(pair_summary: DataFrame, names=None) -> DataFrame:
    """Summary of every successful pair under its display name."""
    shown = display_name(pair_summary.filter("status = 'success'"), names)
    rest = [c for c in pair_summary.columns if c not in ("_file", "status", "reason", "key_1", "key_2")]
    return shown.select(
        F.col("display").alias("File"), F.col("key_1").alias("SKU_Col_F1"), F.col("key_2").alias("SKU_Col_F2"), *rest
    ).orderBy("File")


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: str | None = None, mode: str = "errorifexists") -> None:
    """Write one report table. CSV files start with a byte-order mark in their header."""
    if fmt == "csv":
        kept = [c for c in df.columns if c != partition_by]
        df = df.withColumnRenamed(kept[0], BOM + kept[0])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


class Report:
    """A report folder whose tables are written one after the other; a manifest names those that are complete.

    What a run that broke off had finished is kept by the next one, and what it had begun is written anew. A
    report that is complete is an error, so that none is overwritten.
    """

    END = "complete"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifest = f"{self.folder}/_manifest"
        known = self.spark.createDataFrame([], "table string")
        known.write.mode("append").parquet(self.manifest)
        self.done = {r["table"] for r in self.spark.read.schema("table string").parquet(self.manifest).collect()}
        if self.END in self.done:
            raise ValueError(f"the report {folder} is complete")

    def note(self, table: str) -> None:
        self.spark.createDataFrame([(table,)], "table string").write.mode("append").parquet(self.manifest)

    def add(self, table: str, make, fmt: str, partition_by: str | None = None) -> None:
        """``make`` gives the rows; it isn't called for a table that is there."""
        if table not in self.done:
            write_table(make(), f"{self.folder}/{table}", fmt, partition_by, mode="overwrite")
            self.note(table)


def write_report(result, folder: str, fmt: str = "csv", merge_diffs: bool = False, names=None,
                 labels=("Value_F1", "Value_F2")) -> None:
    """Write every report table of a comparison below ``folder``; after a crash the same call goes on where it stopped.

    The alignment runs once: ``materialize`` keeps the cells that differ, and both the rates and the
    differences are read from there. Differences stay distributed, one directory per file unless merged.
    """
    result.materialize()
    report = Report(result.spark, folder)
    report.add("Summary", lambda: result.run_summary, fmt)
    report.add("Column_Match_Rates", lambda: channel_table(result.column_stats, names) if names is not None else column_table(result.overall_stats), fmt)
    report.add("Files", lambda: files_table(result.pair_summary, names), fmt)
    report.add("Debug_Log", lambda: result.run_log, fmt)
    report.add("Missing_Keys", lambda: result.missing_keys.orderBy("_file", "missing_in", "raw_sku"), fmt)
    for table in ("Rejects", "Repairs"):
        if getattr(result, table.lower(), None) is not None:
            report.add(table, lambda table=table: getattr(result, table.lower()), fmt)

    def differences():
        diffs = diff_table(result.diff_cells, names, labels, merge_diffs, names is not None)
        # ranges keep a file's rows together in few output files, and spread a large file over many tasks
        order = ["_file", "column", "sku"]
        return diffs if merge_diffs else diffs.repartitionByRange(*order).sortWithinPartitions(*order)

    report.add("Differences", differences, fmt, None if merge_diffs else "_file")
    report.note(Report.END)
