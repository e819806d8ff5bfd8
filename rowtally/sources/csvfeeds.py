"""CSV feeds: dialect found by Spark jobs over the whole text, then parsed by Spark, every column as text."""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtally.functions.values import name
from rowtally.session import scratch_folder, stored, working_session
from rowtally.sources.csvlines import joined_records, keeps_open, opens_value, record_starts
from rowtally.sources.feed import FeedGroup, as_order, file_order, string_schema
from rowtally.sources.listing import feed_name, scanned_path

# Delimiters tried, and the encodings tried after UTF-8.
DELIMITERS = ["|", ";", "\t", ",", "~", "^", "\x01"]
ENCODINGS = ["UTF-8", "GBK", "ISO-8859-1"]

BOM = "\ufeff"
STEADY = 0.9  # share of lines that must have as many delimiters as the header
_CODECS = {"UTF-8": "utf-8", "GBK": "gbk", "ISO-8859-1": "latin-1"}
SMALL_BYTES = 256 << 10  # a file up to this size is read whole for its header
_ONE_FILE_PER_TASK = {"spark.sql.files.maxPartitionBytes": str(1 << 50), "spark.sql.files.openCostInBytes": str(1 << 50), "spark.sql.execution.arrow.maxRecordsPerBatch": "64"}
# no small file is split, since a split has the bytes that opening costs at least
_FILES_TOGETHER = {"spark.sql.files.maxPartitionBytes": str(64 * SMALL_BYTES), "spark.sql.files.openCostInBytes": str(SMALL_BYTES)}


def _tried(delimiter: str | None) -> list[str]:
    return list(dict.fromkeys([*DELIMITERS, delimiter or ","]))


def heads(spark: SparkSession, paths: list[str], delimiter: str | None = None) -> DataFrame:
    """The header of every file, ``path, header`` (bytes), with all lines that its quoted values run over.

    A large file is one task that stops where the header ends, so the job reads heads, not files. Many small ones share a task.
    """
    v, size = F.col("value"), F.col("_metadata.file_size")

    def first_records(alone):
        def run(batches):
            now, taken, inside, done = None, [], False, True

            def head():
                # a value that is never closed is none: then the first line is the header
                header = b"\n".join(taken) if not inside else taken[0]
                return pd.DataFrame({"path": [now], "header": [header.removesuffix(b"\r")]})

            for batch in batches:
                for path, line, out, within in zip(*(batch[c] for c in ("path", "line", "from_out", "from_in"))):
                    if path != now:
                        if taken:
                            yield head()
                        now, taken, inside, done = path, [], False, False
                    elif done:
                        continue
                    taken.append(bytes(line))
                    inside = within if inside else out
                    done = not inside
                    if alone and done:
                        break
                if alone and done:
                    break
            if taken:
                yield head()

        return run

    def read(settings, wanted, alone):
        lines = working_session(spark, **settings).read.option("lineSep", "\n").text(paths).filter(wanted).select(
            scanned_path().alias("path"), v.cast("binary").alias("line"), opens_value(v, _tried(delimiter)).alias("from_out"), keeps_open(v, _tried(delimiter)).alias("from_in"))
        return lines.mapInPandas(first_records(alone), "path string, header binary")

    return read(_FILES_TOGETHER, size <= SMALL_BYTES, False).unionByName(read(_ONE_FILE_PER_TASK, size > SMALL_BYTES, True))


def delimiter_counts(line: Column) -> Column:
    """How often each candidate stands outside of quotes; null for a line in which a quoted value starts or ends, which is no sample."""
    bare = F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)
    counts = F.array(*[F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(d), F.lit(""))) for d in DELIMITERS])
    return F.when((F.octet_length(line) > 0) & ~F.contains(bare, F.lit('"')), counts)


def profile(spark: SparkSession, paths: list[str], delimiter: str | None = None) -> DataFrame:
    """Over the whole text of each file: ``path, counts, lines, utf8, gbk, quoted_newline, header``.

    A row for each different way in which candidates for the delimiter occur in a line, summed up before the shuffle.
    ``header`` is the place of the first such line in the first split; the smallest is that of the header.
    """
    v = F.col("value")
    # GBK never uses line ends inside a character, so testing line by line is testing the file
    as_gbk = F.decode(v.cast("binary"), "GBK")
    gbk = v.rlike(r"^[\x00-\x7F]*\z") | ~F.contains(as_gbk, F.lit("\ufffd"))
    lines = working_session(spark).read.text(paths)
    first = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    rows = lines.select(scanned_path().alias("path"), (F.lit(None).cast("array<int>") if delimiter else delimiter_counts(v)).alias("counts"), v, first.alias("first"))
    return rows.groupBy("path", "counts").agg(
        F.count(F.lit(1)).alias("lines"),
        F.bool_and(F.is_valid_utf8(v)).alias("utf8"),
        F.bool_and(gbk).alias("gbk"),
        F.bool_or(opens_value(v, _tried(delimiter))).alias("quoted_newline"),
        F.min("first").alias("header"),
    )


def encoding_of(utf8: Column, gbk: Column) -> Column:
    """The first encoding that decodes the whole file; the last one always does."""
    return F.when(utf8, ENCODINGS[0]).when(gbk, ENCODINGS[1]).otherwise(ENCODINGS[2])


def delimiters(counted: DataFrame, key: str) -> DataFrame:
    """``<key>, delimiter`` of files from ``<key>, counts, lines, header``, where ``header`` is null but for the first line's counts.

    Chosen is the candidate that stands in STEADY or more of all lines as often as in the header, the most frequent first.
    Without such a one the candidate that splits the header widest, as it yields most columns; then a comma.
    """
    some = counted.filter("counts IS NOT NULL")
    header = some.filter("header IS NOT NULL").groupBy(key).agg(F.min_by("counts", "header").alias("wanted"))
    alike = F.transform(F.arrays_zip("counts", "wanted"), lambda c: c["counts"] == c["wanted"])
    sums = [F.sum(F.when(alike[i], F.col("lines")).otherwise(0)) for i in range(len(DELIMITERS))]
    seen = some.join(header, key).groupBy(key).agg(F.first("wanted").alias("wanted"), F.sum("lines").alias("all"), F.array(*sums).alias("alike"))
    ranked = [F.struct((F.col("alike")[i] >= F.col("all") * STEADY).alias("steady"), F.col("wanted")[i].alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("delimiter"))
              for i, d in enumerate(DELIMITERS)]
    best = F.array_max(F.filter(F.array(*ranked), lambda r: r["n"] > 0))
    return seen.select(key, F.coalesce(best["delimiter"], F.lit(",")).alias("delimiter"))


def header_names(cells: list[str]) -> list[str]:
    """Column names of a header; repeated and empty names are told apart."""
    names: list[str] = []
    for i, cell in enumerate(cells):
        wanted = base = cell or f"_c{i}"
        n = 0
        while wanted in names:
            wanted, n = f"{base}_duplicated_{n}", n + 1
        names.append(wanted)
    return names


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    encoding: str
    quoted_newline: bool


def read_csv(spark, folder, paths, columns, dialect, multi_part=False, starts=None) -> DataFrame:
    """Rows of files that share header and dialect: ``_file, _ord`` and text columns.

    Files whose values run over line ends are put together from lines first; ``starts`` are their splits' starts.
    """
    options = {"mode": "PERMISSIVE", "sep": dialect.delimiter, "escape": '"', "maxColumns": str(max(20480, len(columns) + 1))}
    path = F.col("path") if dialect.quoted_newline else scanned_path()
    if not dialect.quoted_newline:
        rows = spark.read.schema(string_schema(columns)).options(**options).option("header", True).option("encoding", dialect.encoding).csv(paths)
        return rows.select(feed_name(path, folder).alias("_file"), file_order(path, multi_part).alias("_ord"), *[name(c) for c in columns])
    tried = _tried(dialect.delimiter)
    starts = record_starts(spark, paths, tried, dialect.encoding) if starts is None else starts.filter(F.col("path").isin(paths))
    records = joined_records(spark, paths, starts, tried, dialect.encoding).filter("(block > 0 OR line > 0) AND value <> ''")
    # names stand by their places: a text schema can't hold every name
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(columns))), {**options, "multiLine": "true"})
    place = F.col("block").cast("decimal(38,0)") * F.lit(1 << 33).cast("decimal(11,0)") + F.col("line")
    rows = records.select(feed_name(path, folder).alias("_file"), as_order(place, path, multi_part).alias("_ord"), cells.alias("r"))
    return rows.select("_file", "_ord", *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])


def csv_groups(spark, folder, feeds: dict[str, list[str]], multi_part=False, encoding=None, delimiter=None, multiline=None):
    """Groups of CSV feeds that can be read together, and ``{feed: error}`` of those that cannot be read.

    Whole files are read once unless ``encoding``, ``delimiter`` and ``multiline`` are all given; then only their heads are.
    All parts of a feed have one dialect; each is read by its own header, whose order may differ.
    What comes back to the driver is one row per distinct dialect and header with its files.
    """
    session = working_session(spark)
    paths = [p for ps in feeds.values() for p in ps]
    file = feed_name(F.col("path"), folder)
    found = heads(session, paths, delimiter).select(file.alias("_file"), "path", "header")
    if None in (encoding, delimiter, multiline):
        seen = stored(profile(session, paths, delimiter).withColumn("_file", file), scratch_folder(session, "profile"))
        whole = seen.groupBy("_file").agg(encoding_of(F.bool_and("utf8"), F.bool_and("gbk")).alias("encoding"), F.bool_or("quoted_newline").alias("quoted_newline"))
        found = found.join(whole, "_file")
        if delimiter is None:
            by_part = seen.select("_file", "counts", "lines", F.when(F.col("header").isNotNull(), F.struct("path", "header")).alias("header"))
            found = found.join(delimiters(by_part, "_file"), "_file", "left")
    for column, value in (("encoding", encoding), ("delimiter", delimiter), ("quoted_newline", multiline)):
        found = found if value is None else found.withColumn(column, F.lit(value))
    files = F.collect_list(F.struct("_file", "path")).alias("files")
    rows = found.groupBy("delimiter", "encoding", "quoted_newline", "header").agg(files).collect()

    parts, dialects = defaultdict(dict), {}
    for r in rows:
        dialect = Dialect(r["delimiter"] or ",", r["encoding"], r["quoted_newline"])
        header = bytes(r["header"]).decode(_CODECS.get(dialect.encoding, dialect.encoding), "replace").lstrip(BOM)
        columns = header_names(next(csv.reader(io.StringIO(header, newline=""), delimiter=dialect.delimiter))) if header.strip() else []
        for f in r["files"]:
            parts[f["_file"]][f["path"]] = columns
            dialects[f["_file"]] = dialect

    errors, alike = {}, defaultdict(lambda: defaultdict(list))
    for f in feeds:
        headers = sorted(parts[f].items())
        if not headers or not all(columns for _, columns in headers):
            errors[f] = "no header"
        elif any(sorted(columns) != sorted(headers[0][1]) for _, columns in headers):
            errors[f] = "part files with different columns"
        else:
            for path, columns in headers:
                alike[tuple(headers[0][1]), tuple(columns), dialects[f]][f].append(path)

    def group(columns, own, dialect, members):
        starts = None
        if dialect.quoted_newline:
            starts = record_starts(session, [p for ps in members.values() for p in ps], _tried(dialect.delimiter), dialect.encoding)
            starts = stored(starts, scratch_folder(session, "splits"))

        def read(chosen):
            part = read_csv(session, folder, [p for f in chosen for p in members[f]], own, dialect, multi_part, starts)
            return part.select("_file", "_ord", *[name(c) for c in columns])

        return FeedGroup(list(columns), sorted(members), read)

    return [group(*key, members) for key, members in alike.items()], errors
