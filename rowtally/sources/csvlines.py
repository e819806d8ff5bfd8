"""Records of CSV files whose values run over line ends, put together by many tasks.

Whether a line starts inside a quoted value hangs on all lines before it. A line is a function of that one bit, and so are the lines of a
split together. Composed over the splits of a file they tell each split how it starts; then each joins its own lines to records.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtally.session import working_session
from rowtally.sources.listing import scanned_path


def cell_start(delimiters: list[str]) -> str:
    """Regular expression for a quote at the start of a cell, its place before it captured."""
    return "(^|[" + "".join("\\" + d if d in "|^\\]-[" else d for d in delimiters) + '])"'


def opens_value(line: Column, delimiters: list[str]) -> Column:
    """Whether a line that starts outside of values ends inside a quoted one.

    Only a quote at the start of a cell opens one; an inch mark inside a cell does not.
    """
    start = cell_start(delimiters)
    return F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), start + '[^"]*"', "$1").rlike(start)


def keeps_open(line: Column, delimiters: list[str]) -> Column:
    """Whether a line that starts inside a quoted value ends inside one."""
    bare = F.replace(line, F.lit('""'), F.lit(""))
    closed = F.instr(bare, '"')
    # what stands behind the closing quote starts no cell, whatever it is
    return F.when(closed == 0, True).otherwise(opens_value(F.concat(F.lit(" "), F.substring(bare, closed + 1, F.length(bare))), delimiters))


def _lines(spark: SparkSession, paths: list[str], delimiters: list[str], encoding: str) -> DataFrame:
    """``path, block, id, value, from_out, from_in``: lines, and whether each ends inside a value, by whether it starts in one."""
    lines = working_session(spark).read.option("lineSep", "\n").text(paths)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = lines.select(scanned_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), value.alias("value"))
    v = F.col("value")
    quoted = F.contains(v, F.lit('"'))
    return lines.select("*", F.when(quoted, opens_value(v, delimiters)).otherwise(False).alias("from_out"), F.when(quoted, keeps_open(v, delimiters)).otherwise(True).alias("from_in"))


def record_starts(spark: SparkSession, paths: list[str], delimiters: list[str], encoding: str) -> DataFrame:
    """``path, block, open_block, open_line`` of every split: the record that it starts in the middle of, null if in none."""
    def summed(batches):
        now, row = None, None
        for batch in batches:
            for path, block, out, inside in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, block) != now:
                    if now:
                        yield _row(now, row)
                    now, row = (path, block), [False, True, -1, -1, 0]  # the bit at the end, for either at the start; the last record begun
                for i in (0, 1):
                    if not row[i]:
                        row[2 + i] = row[4]
                    row[i] = inside if row[i] else out
                row[4] += 1
        if now:
            yield _row(now, row)

    def _row(key, row):
        return pa.RecordBatch.from_pydict({"path": [key[0]], "block": [key[1]], "open_0": [row[0]], "open_1": [row[1]], "last_0": [row[2]], "last_1": [row[3]]}, schema=arrow)

    arrow = pa.schema([("path", pa.string()), ("block", pa.int64()), ("open_0", pa.bool_()), ("open_1", pa.bool_()), ("last_0", pa.int64()), ("last_1", pa.int64())])
    bits = _lines(spark, paths, delimiters, encoding).select("path", "block", "from_out", "from_in")
    splits = bits.mapInArrow(summed, "path string, block bigint, open_0 boolean, open_1 boolean, last_0 bigint, last_1 bigint")
    return splits.groupBy("path").applyInArrow(_composed, "path string, block bigint, open_block bigint, open_line bigint")


def _composed(key: tuple[pa.Scalar, ...], splits: pa.Table) -> pa.Table:
    inside, record, out = False, (None, None), []
    for r in sorted(splits.to_pylist(), key=lambda r: r["block"]):
        out.append((key[0].as_py(), r["block"], *(record if inside else (None, None))))
        last = r["last_1"] if inside else r["last_0"]
        record = (r["block"], last) if last >= 0 else record
        inside = r["open_1"] if inside else r["open_0"]
    path, block, open_block, open_line = zip(*out)
    return pa.table({"path": path, "block": pa.array(block, pa.int64()), "open_block": pa.array(open_block, pa.int64()), "open_line": pa.array(open_line, pa.int64())})


def joined_records(spark: SparkSession, paths: list[str], starts: DataFrame, delimiters: list[str], encoding: str) -> DataFrame:
    """``path, block, line, value``: every record with its line ends, and where it starts: its split and its line there."""
    # a join may deal lines out anew, a split's all to one task; ids bring them back in order
    lines = _lines(spark, paths, delimiters, encoding).join(starts, ["path", "block"]).sortWithinPartitions("path", "block", "id")
    lines = lines.select("path", "block", "open_block", "open_line", "value", "from_out", "from_in")
    schema = "path string, block bigint, line bigint, seq bigint, value string, whole boolean"
    arrow = pa.schema([("path", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("seq", pa.int64()), ("value", pa.string()), ("whole", pa.bool_())])

    def join(batches):
        now, record, parts, inside, n = None, None, [], False, 0

        def frame(rows):
            return pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*rows)))), schema=arrow)

        for batch in batches:
            rows = []
            for path, block, open_block, open_line, value, out, within in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, block) != now:
                    if parts:
                        rows.append((now[0], *record, now[1], "\n".join(parts), False))
                    now, n, parts = (path, block), 0, []
                    inside, record = open_block is not None, (open_block, open_line)
                if not inside:
                    record = (block, n)
                parts.append(value)
                inside = within if inside else out
                if not inside:
                    rows.append((path, *record, block, "\n".join(parts), record[0] == block))
                    parts = []
                n += 1
            if rows:
                yield frame(rows)
        if parts:
            yield frame([(now[0], *record, now[1], "\n".join(parts), False)])

    found = lines.mapInArrow(join, schema)
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda p: p["value"]), "\n")
    split = found.filter("NOT whole").groupBy("path", "block", "line").agg(pieces.alias("value"))
    return found.filter("whole").select("path", "block", "line", "value").unionByName(split).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
