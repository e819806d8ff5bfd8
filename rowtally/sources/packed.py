"""Archives and workbooks: unpacked once, one file in one task, to a text table that the other readers take.

The first feed of an archive is only decompressed; its lines go to shared storage as they stand and are read
like any CSV or XML feed from there. Records of workbooks become JSON lines. Archives are opened by their path: the directory
is read from their end, then one member as a stream, so that their size doesn't matter.
"""

from __future__ import annotations

import io
import json
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtally.functions.values import name
from rowtally.session import scratch_folder, working_session
from rowtally.sources.csvfeeds import csv_groups, header_names
from rowtally.sources.feed import FeedGroup, file_order
from rowtally.sources.listing import feed_name, feed_paths, scanned_path
from rowtally.sources.xmlfeeds import xml_groups

ROWS_PER_BATCH, BYTES_PER_BATCH = 5000, 16 << 20
# Unpacking is work for the processor and one archive may be large: small tasks, one archive at a time.
_UNPACKING = {"spark.sql.files.maxPartitionBytes": str(16 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
LARGEST = (1 << 31) - 1024  # what one binary value can hold, where a store can't be read by ranges


def _local(tag: str) -> str:
    tag = tag.split("}", 1)[-1]
    return tag.rsplit(":", 1)[-1] if ":" in tag and tag.index(":") <= 3 else tag


def xlsx_records(data: bytes):
    """Cells of the first sheet as the text stored in the file."""
    def texts(node):
        return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")

    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [texts(si) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        sheet = ET.fromstring(book.read(sheets[0]))
    columns = None
    for row in (e for e in sheet.iter() if _local(e.tag) == "row"):
        cells: dict[int, str] = {}
        for i, c in enumerate(e for e in row if _local(e.tag) == "c"):
            letters = re.match(r"[A-Z]*", c.get("r", "")).group()
            at = i
            if letters:
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
            if c.get("t") == "s":
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = texts(c)
            elif c.get("t") == "b":
                value = "true" if value == "1" else "false"
            cells[at] = value
        if columns is None:
            width = max(cells, default=-1) + 1
            columns = header_names([cells.get(i, "") for i in range(width)])
        else:
            yield {c: cells.get(i, "") for i, c in enumerate(columns)}


def opened(path: str):
    """A file of a store that is read by byte ranges; ``None`` for a store of another kind."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem().open_input_file("/" + (rest or scheme).lstrip("/"))
    try:
        system, at = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return system.open_input_file(at)


def feed_lines(file: str, source):
    """``(kind, line)`` of a workbook's records, or of the first feed in an archive. ``source`` is an open file."""
    if file.lower().endswith(".xlsx"):
        yield from (("book", json.dumps(record).encode()) for record in xlsx_records(source.read()))
        return
    try:
        archive = zipfile.ZipFile(source)
    except pa.ArrowInvalid as e:  # a file too short to have a directory
        raise zipfile.BadZipFile(str(e)) from e
    with archive:
        for member in archive.namelist():
            ext = os.path.splitext(member)[1].lower()
            if ext == ".xls":
                raise ValueError("legacy .xls is not supported")
            if ext == ".xlsx":
                yield from feed_lines(member, io.BytesIO(archive.read(member)))
                return
            if ext in (".csv", ".xml"):
                with archive.open(member) as lines:
                    yield from ((ext[1:], line.removesuffix(b"\n")) for line in lines)
                return
    raise ValueError("no CSV, Excel or XML file in the archive")


def unpack(contents: DataFrame) -> DataFrame:
    """``contents(_file, content)``, or ``(_file, path)`` of files to be opened, to ``_file, kind, n, line``. A file that cannot be
    read gives a line with its error."""
    given = "content" if "content" in contents.columns else "path"

    def run(batches):
        rows, size = [], 0
        frame = lambda: pd.DataFrame(rows, columns=["_file", "kind", "n", "line"])
        for batch in batches:
            for file, data in zip(batch["_file"], batch[given]):
                try:
                    for n, (kind, line) in enumerate(feed_lines(file, io.BytesIO(data) if given == "content" else opened(data))):
                        rows.append((file, kind, n, line))
                        size += len(line)
                        if len(rows) == ROWS_PER_BATCH or size > BYTES_PER_BATCH:
                            yield frame()
                            rows, size = [], 0
                except Exception as e:  # one unreadable file must not stop the others
                    rows.append((file, "error", 0, " ".join(f"{type(e).__name__}: {e}".split()).encode()))
        if rows:
            yield frame()

    return contents.select("_file", given).mapInPandas(run, "_file string, kind string, n bigint, line binary")


def land(contents: DataFrame, folder: str) -> None:
    """Unpack to text files ``kind=<kind>/_file=<name>/``, one per packed file, lines in order."""
    lines = unpack(contents).withColumn("line", F.col("line").cast("string")).sortWithinPartitions("kind", "_file", "n")
    lines.drop("n").write.partitionBy("kind", "_file").text(folder)


def _book_groups(spark: SparkSession, folder: str, feeds: dict[str, list[str]], multi_part: bool) -> list[FeedGroup]:
    """Groups of workbooks with the same columns; all records of one have the same."""
    file = feed_name(scanned_path(), folder).alias("_file")
    columns = spark.read.text([p for ps in feeds.values() for p in ps]).select(file, F.json_object_keys("value").alias("columns")).distinct()
    shapes = columns.groupBy("columns").agg(F.collect_list("_file").alias("files")).collect()

    def group(kept, files):
        def read(chosen):
            lines = spark.read.text([p for f in chosen for p in feeds[f]])
            rows = lines.select(file, file_order(scanned_path(), multi_part).alias("_ord"), F.from_json("value", "map<string,string>").alias("c"))
            return rows.select("_file", "_ord", *[F.col("c")[c].alias(c) for c in kept])

        return FeedGroup(kept, sorted(files), read)

    return [group(list(s["columns"]), s["files"]) for s in shapes]


def _without_nulls(group: FeedGroup) -> FeedGroup:
    """A cell that a packed record lacks is ''."""
    filled = [F.coalesce(name(c), F.lit("")).alias(c) for c in group.columns]
    return FeedGroup(group.columns, group.files, lambda chosen: group.read(chosen).select("_file", "_ord", *filled))


def landed_groups(spark: SparkSession, landed: str, multi_part: bool = False, repair: bool = True):
    """Groups of the unpacked feeds, ``{feed: error}``, and rejected records."""
    session = working_session(spark)
    listed = session.read.format("binaryFile").option("recursiveFileLookup", True).load(landed)
    kinds = [r["kind"] for r in listed.select(feed_name(F.col("path"), landed).alias("kind")).distinct().collect()]
    groups, errors, rejects = [], {}, []
    for kind in kinds:
        folder = f"{landed}/{kind}"
        feeds, _ = feed_paths(session, folder, "*")
        if kind == "kind=csv":
            found, broken = csv_groups(session, folder, feeds, multi_part)
            groups, errors = groups + found, errors | broken
        elif kind == "kind=xml":
            found, rejects, unknown = xml_groups(session, folder, feeds, multi_part, repair)
            groups, errors = groups + found, errors | {f: "no repeating elements" for f in unknown}
        elif kind == "kind=book":
            groups += _book_groups(session, folder, feeds, multi_part)
        else:
            lines = session.read.text([p for ps in feeds.values() for p in ps])
            errors |= {r[0]: r[1] for r in lines.select(feed_name(scanned_path(), folder), "value").collect()}
    # what came out of a file before its error is not compared
    for g in groups:
        g.files = [f for f in g.files if f not in errors]
    return [_without_nulls(g) for g in groups if g.files], errors, rejects


def packed_groups(spark: SparkSession, folder: str, feeds: dict[str, list[str]], multi_part=False, repair=True):
    """Groups of packed feeds with the same columns, ``{file: error}`` of those that cannot be read, and rejects.

    Files are unpacked once to the shared scratch folder; every later pass reads what lies there.
    """
    session = working_session(spark, **_UNPACKING)
    paths = [p for ps in feeds.values() for p in ps]
    named = session.read.format("binaryFile").load(paths).withColumn("_file", feed_name(F.col("path"), folder))
    landed, large = scratch_folder(session, "packed"), {}
    probe = opened(paths[0])
    if probe is not None:
        probe.close()
        land(named.select("_file", F.col("path")), landed)
    else:  # a store that only Spark reads: each file is one value
        large = {r["_file"]: "too large for one value" for r in named.filter(F.col("length") > LARGEST).select("_file").distinct().collect()}
        land(named.filter(F.col("length") <= LARGEST).select("_file", "content"), landed)
    groups, errors, rejects = landed_groups(spark, landed, multi_part, repair)
    errors |= large
    found = {f for g in groups for f in g.files}
    errors |= {f: "no records" for f in feeds if f not in found and f not in errors}
    return groups, errors, rejects
