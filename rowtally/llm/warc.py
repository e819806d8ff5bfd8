"""Operator 6: WARC archives with an index, read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtally.session import scratch_folder, stored

LEAST_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 512 << 20
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
DATE = "2000-01-01T00:00:00Z"

_INDEX = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
         "archive string, offset long, length long")
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def revisit_plan(pages: DataFrame) -> DataFrame:
    """Pages with ``_bytes``, ``_digest`` and ``_refers``: the page whose record holds the same payload, null if it is this one.

    Only digests that occur more than once are joined back, after a count with map-side sums. Ties: rows that share the
    largest page_id of a payload are all responses. A row without page_id refers to the largest one there is.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("_payload"), F.length(payload).cast("long").alias("_bytes"), F.sha1(payload).alias("_digest"))
    several = (rows.filter(F.col("_bytes") >= LEAST_REVISIT_BYTES).groupBy("_digest")
               .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    other = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return rows.join(several, "_digest", "left").withColumn("_refers", F.when(other, F.col("_first"))).drop("_first")


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    body = payload
    if refers_to is not None:
        body = b""
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to)),
                 ("X-Refers-To-Page-ID", refers_to), ("X-Payload-Length", len(payload))]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(body))]
    plain = b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"\r\n", body, b"\r\n\r\n"])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one gzip member per page into archives below ``folder`` and return their index, itself a stored table.

    Columns page_id, url and html are used. The index (archive, offset, length, url, digest per record) is what counts:
    every task attempt writes archives under names of its own, and only those of attempts that succeeded are in the
    index, so that a lost executor leaves an unlisted file at worst. A task starts a new archive after 512 MB.
    """
    spark = pages.sparkSession
    folder = folder or scratch_folder(spark, "warc")

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = _record(row["page_id"], row["url"], row["_payload"], row["_digest"], row["_refers"])
                out.write(data)
                kind = "response" if row["_refers"] is None else "revisit"
                rows.append((row["page_id"], row["url"], kind, row["_refers"], row["_bytes"], row["_digest"], name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX.types)] if rows else [pa.array([], t) for t in _INDEX.types], schema=_INDEX)
        if out:
            out.close()

    index = revisit_plan(pages).select("page_id", "url", "_payload", "_bytes", "_digest", "_refers").mapInArrow(write, INDEX)
    return stored(index, f"{folder}-index").withColumn("archive", F.concat(F.lit(f"{folder}/"), "archive"))


def _parse(data: bytes) -> tuple:
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    number = lambda k: int(fields[k]) if k in fields else None
    if fields["WARC-Type"] == "response":
        size, digest = len(body), hashlib.sha1(body).hexdigest()
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"digest of {fields['WARC-Record-ID']} differs")
    else:
        size, digest = number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return number("X-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number("X-Refers-To-Page-ID"), size, digest, body


def read_records(selected: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the selected rows of an index, parsed; the body of a revisit is empty.

    Rows are brought together by archive and sorted by offset; ranges less than GAP_BYTES apart are read at once, up to
    READ_BYTES (a longer record alone).
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def runs(rows):
        run: list[tuple[str, int, int]] = []
        for row in rows:
            if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > GAP_BYTES or row[1] + row[2] - run[0][1] > READ_BYTES):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def read(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))))
        source, opened = None, None
        for run in runs(rows):
            if opened != run[0][0]:
                opened = run[0][0]
                store, path = fs.FileSystem.from_uri(opened)
                source = store.open_input_file(path)
            first = run[0][1]
            data = source.read_at(max(o + n for _, o, n in run) - first, first)
            found = [_parse(data[o - first:o - first + n]) for _, o, n in run]
            columns = list(zip(*found))
            if not payload:
                columns[-1] = [None] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    ranges = selected.select("archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset")
    return ranges.mapInArrow(read, RECORDS)
