"""XML feeds: records are cut out of the text by many tasks, then read by Spark's XML source one by one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowtally.functions.values import name, strip
from rowtally.session import scratch_folder, stored, working_session
from rowtally.sources.feed import FeedGroup, as_order
from rowtally.sources.listing import feed_name, feed_paths
from rowtally.sources.xmlrepair import repaired
from rowtally.sources.xmlscan import AT, CHILD, chunk_starts, chunk_texts, records

# Element names taken for records, in this order.
RECORD_TAGS = ["item", "product", "offer", "record", "row", "entry"]
# Characters XML 1.0 does not allow.
ILLEGAL = r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"

BAD = "_corrupt_record"
_TEXT = "_VALUE"

def declared_prefixes(spark: SparkSession, paths: list[str]) -> list[str]:
    """Namespace prefixes the documents declare, each once."""
    pieces = spark.read.option("lineSep", ">").text(paths)
    return [r[0] for r in pieces.select(F.explode(F.regexp_extract_all("value", F.lit(r"\sxmlns:([^\s=]+)\s*=")))).distinct().collect()]


_OPTIONS = {"rowTag": CHILD, "ignoreNamespace": "true", "attributePrefix": "@", "valueTag": _TEXT, "columnNameOfCorruptRecord": BAD}


def _reader(spark: SparkSession):
    # the older parser cuts records out of the text first, so that one bad record spoils no other
    return spark.read.format("xml").options(**_OPTIONS).option("useLegacyXMLParser", True).option("inferSchema", False)


def _text(value: Column, dtype: T.DataType) -> Column | None:
    """Own text of an element of any shape; of repeated ones the last counts."""
    if isinstance(dtype, T.ArrayType):
        inner = _text(F.try_element_at(F.array_compact(value), F.lit(-1)), dtype.elementType)
        return inner
    if isinstance(dtype, T.StructType):
        return value[_TEXT] if _TEXT in dtype.names else F.when(value.isNotNull(), F.lit(""))
    return value


def flattened(schema: T.StructType) -> dict[str, Column]:
    """Columns of a record: leaves by name, children of children as ``child_sub``, attributes as ``@name``."""
    out: dict[str, Column] = {}
    for field in schema.fields:
        if field.name == BAD or field.name == _TEXT:
            continue
        value, dtype = name(field.name), field.dataType
        repeated = isinstance(dtype, T.ArrayType)
        body = dtype.elementType if repeated else dtype
        subs = [f for f in body.fields if not f.name.startswith("@") and f.name != _TEXT] if isinstance(body, T.StructType) else []
        if not subs or _TEXT in body.names:
            leaf = _text(value, dtype)
            if subs:  # only some records have children here; in the others the element is a leaf
                last = F.try_element_at(F.array_compact(value), F.lit(-1)) if repeated else value
                childless = [last[f.name].isNull() for f in subs]
                for c in childless:
                    leaf = F.when(c, leaf)
            out.setdefault(field.name, leaf)
        for f in subs:
            # an array of structs yields the array of one field; its last value present counts
            sub = value[f.name]
            out.setdefault(f"{field.name}_{f.name}", _text(sub, T.ArrayType(f.dataType) if repeated else f.dataType))
    return {c: v if c.startswith("@") else strip(v) for c, v in out.items()}


def _as_written(record: Column) -> Column:
    """A record under its own name again."""
    own = F.regexp_extract(record, rf'{AT}="[^|]*\|([^|]*)\|', 1)
    body = F.regexp_replace(record, rf'\A<{CHILD} {AT}="[^"]*"', "")
    return F.concat(F.lit("<"), own, F.when(F.endswith(body, F.lit(f"</{CHILD}>")), F.concat(F.substring(body, F.lit(1), F.length(body) - len(CHILD) - 1), own, F.lit(">"))).otherwise(body))


@F.pandas_udf(T.StringType())
def _repaired(record: pd.Series) -> pd.Series:
    return record.map(repaired)


def _full(schema: T.StructType) -> T.StructType:
    return T.StructType([*[f for f in schema.fields if f.name != BAD], T.StructField(BAD, T.StringType())])


def _document(mark: Column) -> Column:
    return F.url_decode(F.substring_index(mark, "|", -1))


def parsed(spark: SparkSession, folder: str, paths: list[str], schema: T.StructType) -> DataFrame:
    """``_file`` and the fields of every record, stored: text is parsed once, all later passes read the table."""
    full = _full(schema)
    # of a record that doesn't parse fields may be missing, but it starts with its mark
    mark = F.coalesce(name("@" + AT), F.regexp_extract(name(BAD), rf'{AT}="([^"]*)"', 1))
    rows = _reader(spark).schema(full).load(paths).select(feed_name(_document(mark), folder).alias("_file"), *[name(f) for f in full.names])
    return stored(rows, scratch_folder(spark, "parsed"))


def read_xml(rows: DataFrame, schema: T.StructType, multi_part=False, repair=True):
    """Rows, and records that did not parse. Such a record is cleaned of illegal characters and parsed again; if that fails
    and ``repair`` is set, its markup is repaired. ``rows`` are those of ``parsed``.

    Returns ``(_file, _ord, <text columns>)`` and ``(_file, record, parsed, repaired)``; repaired records are among the rows too.
    """
    full = _full(schema)
    body = T.StructType(full.fields[:-1])
    flat = {c: v for c, v in flattened(body).items() if c != "@" + AT}
    place = name("@" + AT)
    order = as_order(F.substring_index(place, "|", 1), _document(place), multi_part)
    columns = ["_file", order.alias("_ord"), *[flat[c].alias(c) for c in flat]]
    if BAD not in schema.names:
        return rows.select(*columns), None
    bad = F.col(BAD)
    fields = F.struct(*[name(f) for f in full.names])
    parse = lambda record: F.from_xml(record, full, _OPTIONS)
    tried = rows.select("_file", F.when(bad.isNull(), fields).otherwise(parse(F.regexp_replace(bad, ILLEGAL, ""))).alias("_r")).select("_file", "_r.*")
    good = tried.filter(bad.isNull()).select(*columns)
    broken = tried.filter(bad.isNotNull())
    lost = [_as_written(bad).alias("record"), F.to_json(F.struct(*[name(f) for f in body.names])).alias("parsed")]
    if not repair:
        return good, broken.select("_file", *lost, F.lit(False).alias("repaired"))
    mended = broken.select("_file", *lost, parse(_repaired(F.regexp_replace(bad, ILLEGAL, ""))).alias("_r"))
    known = mended.select("_file", "_r.*").filter(bad.isNull()).select(*columns)
    return good.unionByName(known), mended.select("_file", "record", "parsed", F.col(f"_r.{BAD}").isNull().alias("repaired"))


def infer(spark: SparkSession, paths: list[str]) -> T.StructType:
    return _reader(spark).load(paths).schema


def land_records(spark: SparkSession, folder: str, feeds: dict[str, list[str]]) -> list[str]:
    """Cut the records out of all documents, ``tag=<name>/`` below a scratch folder; these folders. Each record's mark names its document.

    Records are the elements of the first known record name that a feed has, without one all direct children of the root.
    """
    paths = [p for ps in feeds.values() for p in ps]
    chunks = chunk_texts(spark, paths, RECORD_TAGS)
    starts = stored(chunk_starts(chunks, folder), scratch_folder(spark, "chunks"))
    names = starts.groupBy("_file").agg(F.flatten(F.collect_set("names")).alias("names"))
    tag = F.coalesce(*[F.when(F.array_contains("names", t), t) for t in RECORD_TAGS])
    placed = starts.join(names.select("_file", tag.alias("tag")), "_file").drop("names")
    landed = scratch_folder(spark, "records")
    records(chunks, placed).write.partitionBy("tag").text(landed)
    return [f"{landed}/{kind}" for kind in feed_paths(spark, landed, "tag=*")[0]]


def xml_groups(spark: SparkSession, folder: str, feeds: dict[str, list[str]], multi_part=False, repair=True):
    """Groups of XML feeds with the same columns, records that did not parse, and feeds in which no records are found.

    One schema is inferred per record name over all its feeds; which of its columns a feed has comes from
    one aggregation, since a feed lacks a column that none of its records has.
    """
    session = working_session(spark)
    groups, rejects, unknown = [], [], set(feeds)
    for at in land_records(session, folder, feeds):
        schema = infer(session, [at])
        table = parsed(session, folder, [at], schema)
        rows, rejected = read_xml(table, schema, multi_part, repair)
        rejects += [rejected] if rejected is not None else []
        # that parser takes declarations in a record for attributes
        declared = {"@xmlns", *(f"@{p}" for p in declared_prefixes(session, [at]))}
        columns = [c for c in rows.columns if c not in ("_file", "_ord") and c not in declared]
        present = rows.groupBy("_file").agg(F.array_compact(F.array(*[F.when(F.count(name(c)) > 0, F.lit(c)) for c in columns]).cast("array<string>")).alias("columns"))
        for shape in present.filter("size(columns) > 0").groupBy("columns").agg(F.collect_list("_file").alias("files")).collect():
            unknown -= set(shape["files"])

            def read(chosen, table=table, schema=schema, kept=list(shape["columns"])):
                part, _ = read_xml(table.filter(F.col("_file").isin(list(chosen))), schema, multi_part, repair)
                return part.select("_file", "_ord", *[F.coalesce(name(c), F.lit("")).alias(c) for c in kept])

            groups.append(FeedGroup(list(shape["columns"]), sorted(shape["files"]), read))
    return groups, rejects, sorted(unknown)
