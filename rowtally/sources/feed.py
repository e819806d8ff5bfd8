"""What all feed readers share."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass
class FeedGroup:
    """Feeds of one shape: their columns, their names, and how to read any of them as one DataFrame."""

    columns: list[str]
    files: list[str]
    read: Callable[[list[str]], DataFrame]


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def file_order(path: Column, multi_part: bool = False) -> Column:
    """A sortable position of each row in its feed.

    Rows of one file split have rising ids and splits are ordered by their offset; the id of a row alone
    would depend on how splits are packed into tasks. A feed of several part files is ordered by path first.
    """
    in_task = F.monotonically_increasing_id() % F.lit(1 << 33)
    position = F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(11,0)") + in_task
    return as_order(position, path, multi_part)


def as_order(position: Column, path: Column, multi_part: bool) -> Column:
    position = position.cast("decimal(38,0)")
    return F.struct(path.alias("path"), position.alias("position")) if multi_part else position


def stack_groups(groups: list[FeedGroup]) -> list[FeedGroup]:
    """Groups with the same columns as one, however their files are read: fewer, larger plans."""
    same = defaultdict(list)
    for g in groups:
        same[tuple(g.columns)].append(g)
    return [_stacked(list(columns), members) for columns, members in same.items()]


def _stacked(columns: list[str], members: list[FeedGroup]) -> FeedGroup:
    def read(files: list[str]) -> DataFrame:
        asked = set(files)
        wanted = [(g, [f for f in g.files if f in asked]) for g in members]
        return reduce(DataFrame.unionByName, [g.read(mine) for g, mine in wanted if mine])

    # parts of one feed may be in several groups
    return FeedGroup(columns, sorted({f for g in members for f in g.files}), read) if len(members) > 1 else members[0]
