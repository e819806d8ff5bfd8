"""Compare the landed feeds of two sites channel by channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowtally.operators import catalog
from rowtally.plans.folders import FolderComparison, compare_folders


def compare_channels(
    spark: SparkSession, folder_1: str, folder_2: str, channels_1: DataFrame, channels_2: DataFrame,
    selection: DataFrame | None = None, **options,
) -> tuple[FolderComparison, DataFrame]:
    """Match the sites' channels by name and compare the feed each has in its site's folder.

    Feeds are named after their channel, so a channel pairs even when the sites deliver it in different
    formats. ``selection(channel)`` narrows the channels. Further ``options`` are those of
    ``compare_folders``. Returns the comparison and ``(_file, display)`` for channel statistics and reports.
    """
    matched = catalog.match_channels(channels_1, channels_2)
    if selection is not None:
        matched = catalog.select_channels(matched, selection)
    chosen = catalog.channel_files(matched).select("channel").distinct()
    names = [r["channel"] for r in chosen.collect()]  # one short text per channel
    result = compare_folders(spark, folder_1, folder_2, pair_by_stem=True, only=names, **options)
    display = result.spark.createDataFrame([(n, n) for n in names], "_file string, display string")
    return result, display
