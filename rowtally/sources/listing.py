"""Feed folders: which feeds lie in them and which pair up.

A feed is a file, or a directory of part files as Spark writes them, named like a file
(``shop.csv/part-00000.csv``). Listings read no contents.
"""

from __future__ import annotations

import fnmatch
from collections import defaultdict
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Suffixes of files taken for feeds.
SUFFIXES = [".csv", ".xlsx", ".xls", ".xml", ".zip"]


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


LANDED = "_file="


def feed_name(path: Column, folder: str) -> Column:
    """Name of the feed a path belongs to: the first step below the folder.

    Unpacked feeds lie in directories ``_file=<name>``, with the characters escaped that a partition's name can't hold.
    """
    anchor = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    step = F.substring_index(F.split_part(path, F.lit(anchor), F.lit(2)), "/", 1)
    landed = F.url_decode(F.replace(F.substring(step, len(LANDED) + 1, 1 << 20), F.lit("+"), F.lit("%2B")))
    return F.when(F.startswith(step, F.lit(LANDED)), landed).otherwise(step)


def scanned_path() -> Column:
    """Path of the file a row was read from, as listings write it (metadata paths are URL-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def list_feeds(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """``_file, path, length`` of every file of every feed below the folder, empty ones included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # a scan leaves empty files out, the list of its input files does not
    every = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "every string")
    bare = lambda p: F.regexp_replace(p, r"^\w+:/*", "")
    listed = every.join(files.select("path", "length"), bare("every") == bare("path"), "left")
    path = F.coalesce("path", "every")
    feeds = listed.select(feed_name(path, folder).alias("_file"), path.alias("path"), F.coalesce("length", F.lit(0)).alias("length"))
    if pattern:
        return feeds.filter(F.col("_file").rlike(fnmatch.translate(pattern)))
    return feeds.filter(suffix(F.col("_file")).isin(SUFFIXES))


def feed_paths(spark: SparkSession, folder: str, pattern: str | None = None) -> tuple[dict[str, list[str]], int]:
    """Paths of every feed in the folder, the parts of one feed in order; and the bytes of all.

    Empty part files are left out. A feed that has no others is kept with no paths.
    """
    paths, size = defaultdict(list), 0
    for r in list_feeds(spark, folder, pattern).orderBy("path").collect():
        paths[r["_file"]] += [r["path"]] if r["length"] else []
        size += r["length"]
    return dict(paths), size


def pair_feeds(feeds_1: DataFrame, feeds_2: DataFrame) -> DataFrame:
    """``_file, status, reason``: paired when both folders have the name, else unpaired."""
    one = feeds_1.select("_file").distinct().withColumn("in_1", F.lit(True))
    two = feeds_2.select("_file").distinct().withColumn("in_2", F.lit(True))
    missing = F.when(F.col("in_1").isNull(), "only in comparison").when(F.col("in_2").isNull(), "only in baseline")
    both = one.join(two, "_file", "full_outer")
    return both.select("_file", F.when(missing.isNull(), "paired").otherwise("unpaired").alias("status"), missing.alias("reason"))
