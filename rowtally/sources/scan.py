"""Read a folder of feeds of any supported format."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from rowtally.sources.csvfeeds import csv_groups
from rowtally.sources.feed import FeedGroup, stack_groups
from rowtally.sources.listing import feed_paths
from rowtally.sources.packed import packed_groups
from rowtally.sources.xmlfeeds import xml_groups


class FolderScan:
    """The readable groups of a folder, the files that cannot be read, and rejected records."""

    def __init__(self, groups: list[FeedGroup], errors: dict[str, str], rejects: list[DataFrame]):
        self.groups, self.errors, self.rejects = groups, errors, rejects

    def columns(self) -> list[tuple[str, int, str]]:
        """``(file, position, column)`` of every readable feed."""
        return [(f, i, c) for g in self.groups for f in g.files for i, c in enumerate(g.columns)]


def feed_columns(spark: SparkSession, folder: str, side: int = 1, pattern: str | None = None, **options) -> DataFrame:
    """``_file, side, pos, column`` of every readable feed of a folder, as key detection takes them."""
    found = scan_folder(spark, folder, feed_paths(spark, folder, pattern)[0], **options).columns()
    return spark.createDataFrame([(f, side, pos, column) for f, pos, column in found], "_file string, side int, pos int, column string")


def scan_folder(spark: SparkSession, folder: str, feeds: dict[str, list[str]], repair: bool = True, **csv_options) -> FolderScan:
    """Group the given feeds by shape. ``repair`` mends broken XML records. ``csv_options``: ``encoding``, ``delimiter``, ``multiline``."""
    errors = {f: "empty file" for f, paths in feeds.items() if not paths}
    feeds = {f: paths for f, paths in feeds.items() if paths}
    by_format = defaultdict(dict)
    for f, paths in feeds.items():
        by_format["." + f.rsplit(".", 1)[-1].lower() if "." in f else ""][f] = paths
    groups, rejects = [], []
    # row positions have one type per folder, so that groups can be stacked
    multi_part = any(len(paths) > 1 for paths in feeds.values())
    packed = {f: p for ext in (".zip", ".xlsx") for f, p in by_format[ext].items()}
    if by_format[".csv"]:
        found, unreadable = csv_groups(spark, folder, by_format[".csv"], multi_part, **csv_options)
        groups += found
        errors |= unreadable
    if by_format[".xml"]:
        found, rejects, unknown = xml_groups(spark, folder, by_format[".xml"], multi_part, repair)
        groups += found
        errors |= {f: "no repeating elements" for f in unknown}
    if packed:
        found, unreadable, broken = packed_groups(spark, folder, packed, multi_part, repair)
        groups += found
        rejects += broken
        errors |= unreadable
    for ext, members in by_format.items():
        if ext not in (".csv", ".xml", ".zip", ".xlsx"):
            errors |= {f: f"unsupported format: {ext}" for f in members}
    return FolderScan(stack_groups(groups), errors, rejects)


def scan(spark: SparkSession, folder: str, pattern: str | None = None, with_rejects: bool = False, **options):
    """One DataFrame per distinct shape among the feeds of a folder, every column as text. ``options`` as in ``scan_folder``.

    ``with_rejects`` also returns the records that did not parse, ``_file, record, parsed, repaired``, one DataFrame per record
    name. Those repaired are among the rows.
    """
    found = scan_folder(spark, folder, feed_paths(spark, folder, pattern)[0], **options)
    if found.errors:
        raise ValueError(f"cannot read {found.errors}")
    frames = [g.read(g.files) for g in found.groups]
    return (frames, found.rejects) if with_rejects else frames
