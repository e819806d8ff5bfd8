"""Registered queries: each reads whole tables of the driver and exercises one or more operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from checks import feeds
from checks.feeds import spark_sql
from rowtally.functions import names as nm
from rowtally.functions.keys import with_key
from rowtally.functions.values import cell_code, values_equal
from rowtally.operators import catalog, compare, detect, ledger, rollup, runlog
from rowtally.operators.align import first_per_key
from rowtally.plans.folders import compare_folders
from rowtally.plans.reconcile import reconcile
from rowtally.session import scratch_folder, working_session
from rowtally.sinks.report import diff_table, write_report
from rowtally.sources import csvfeeds, listing, packed
from rowtally.sources.scan import feed_columns, scan


def _pair(a, b, **options):
    def build(spark, sf_dir):
        return reconcile(spark_sql(spark, sf_dir, a), spark_sql(spark, sf_dir, b), key="sku", order_by="ord", **options)

    return build


part_pair = _pair(feeds.PART_A, feeds.PART_B)
line_pair = _pair(feeds.LINE_A, feeds.LINE_B)
many_pairs = _pair(feeds.MANY_A, feeds.MANY_B)
many_pairs_no_case = _pair(feeds.MANY_A, feeds.MANY_B, case_sensitive=False)


def frame(build, attribute):
    return lambda spark, sf_dir: getattr(build(spark, sf_dir), attribute)


def key_normalize(spark, sf_dir):
    raw = spark_sql(spark, sf_dir, feeds.RAW_KEYS)
    return with_key(raw, "raw", "sku", keep_blank=True)


def key_normalize_wide(spark, sf_dir):
    """Keys beyond ASCII."""
    return with_key(spark_sql(spark, sf_dir, feeds.WIDE_KEYS), "raw", "sku", keep_blank=True)


def value_equality(spark, sf_dir):
    v = spark_sql(spark, sf_dir, feeds.VALUE_PAIRS)
    a, b = F.col("v1"), F.col("v2")
    return v.select("okey", "line", "pkey", "v1", "v2", values_equal(a, b).alias("equal"), cell_code(a, b).alias("code"))


def dedupe_first(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, feeds.LINE_A)
    cells = [F.col(c) for c in feeds.LINE_COLUMNS]
    keyed = with_key(rows.select("_file", F.col("sku").alias("_raw"), F.col("ord").alias("_ord"), *cells), "_raw", "_key", carries_cells=True)
    return first_per_key(keyed).select("_file", F.col("_key").alias("sku"), *feeds.LINE_COLUMNS)


def column_exclusion(spark, sf_dir):
    a, b = (spark_sql(spark, sf_dir, s) for s in (feeds.PART_A, feeds.PART_B))
    return reconcile(a, b, key="sku", order_by="ord", exclude=["STOCK", "retail"]).column_stats


def explicit_columns(spark, sf_dir):
    a, b = (spark_sql(spark, sf_dir, s) for s in (feeds.PART_A, feeds.PART_B))
    wanted = ["title", "nowhere", "brand", "title"]
    return reconcile(a, b, key="sku", order_by="ord", compare_columns=wanted).column_stats


def common_keys(spark, sf_dir):
    return ledger.common_keys(line_pair(spark, sf_dir).ledger)


def only_in_1(spark, sf_dir):
    return ledger.only_in_1(line_pair(spark, sf_dir).ledger)


def only_in_2(spark, sf_dir):
    return ledger.only_in_2(line_pair(spark, sf_dir).ledger)


def channel_stats(spark, sf_dir):
    """Files shown under a channel name where the supplier table of names has one."""
    r = many_pairs(spark, sf_dir)
    known = spark_sql(spark, sf_dir, "SELECT DISTINCT 'customer.csv' AS _file, 'Customers' AS display FROM {customer}")
    return r.channel_stats(known)


def stats_by_level(spark, sf_dir):
    return rollup.stats_by_level(many_pairs(spark, sf_dir).column_stats)


def one_side_empty(spark, sf_dir):
    stats = rollup.one_side_empty(many_pairs(spark, sf_dir).column_stats)
    return stats.select("_file", "column", "one_side_empty")


def preview_overall(spark, sf_dir):
    return compare.overall_preview(many_pairs(spark, sf_dir).diff_cells)


def diff_export(spark, sf_dir):
    return diff_table(many_pairs(spark, sf_dir).diff_cells, merged=True)


def log_summary(spark, sf_dir):
    return runlog.log_summary(many_pairs(spark, sf_dir).run_log)


def log_filter(spark, sf_dir):
    log = runlog.filter_log(many_pairs(spark, sf_dir).run_log, ["MATCH", "MISS"])
    return log.select("category", "file", "message")


def _headers(spark, sf_dir):
    return spark_sql(spark, sf_dir, feeds.HEADERS)


def column_names(spark, sf_dir):
    c = F.col("column")
    n = nm.normalize_column_name(c)
    return _headers(spark, sf_dir).select(
        "_file", "side", "pos", "column", n.alias("normalized"), nm.is_excluded_name(n).alias("excluded"), nm.clean_tag(c).alias("tag")
    )


def column_scores(spark, sf_dir):
    return detect.score_columns(_headers(spark, sf_dir))


def column_scores_guided(spark, sf_dir):
    return detect.score_columns(_headers(spark, sf_dir), "Ident", ["", "g:ID", "skuu", "OFFER ID"])


def top_candidates(spark, sf_dir):
    return detect.rank_candidates(column_scores(spark, sf_dir))


def detected_keys(spark, sf_dir):
    return detect.detect_keys(_headers(spark, sf_dir))


def paired_keys(spark, sf_dir):
    return detect.pair_keys(detected_keys(spark, sf_dir))


def resolved_keys(spark, sf_dir):
    return detect.resolve_keys(_headers(spark, sf_dir), user="ids")


def resolved_keys_manual(spark, sf_dir):
    return detect.resolve_keys(_headers(spark, sf_dir), user="ids", auto_detect=False)


def _write_folder(spark, sf_dir, feed_sql, folder):
    """Write the rows of each file in order, as Spark text files named like a feed."""
    rows = spark_sql(spark, sf_dir, feed_sql)
    for file, sep in feeds.FILE_DELIMITERS.items():
        part = rows.filter(F.col("_file") == file).orderBy("ord").drop("_file", "ord")
        part.write.option("header", True).option("sep", sep).option("escape", '"').csv(f"{folder}/{file}")
    records = rows.filter("_file = 'customer.xml'").orderBy("ord").drop("_file", "ord")
    records.write.format("xml").option("rowTag", "item").save(f"{folder}/customer.xml")


def folders(spark, sf_dir):
    base = scratch_folder(spark, "feeds")
    for side, sql in (("base", feeds.FILES_A), ("new", feeds.FILES_B)):
        _write_folder(spark, sf_dir, sql, f"{base}/{side}")
    return compare_folders(spark, f"{base}/base", f"{base}/new", key="sku")


def folder_diff_cells(spark, sf_dir):
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return folders(spark, sf_dir).diff_cells.select("_file", "sku", "column", text("value_1"), text("value_2"))


def csv_scan(spark, sf_dir):
    folder = scratch_folder(spark, "scan")
    rows = spark_sql(spark, sf_dir, feeds.PART_A).orderBy("ord").drop("_file", "ord")
    rows.write.option("header", True).option("sep", "~").option("escape", '"').csv(f"{folder}/part.csv")
    (df,) = scan(spark, folder)
    return df.drop("_file", "_ord")


def csv_delimiters(spark, sf_dir):
    lines = spark_sql(spark, sf_dir, feeds.HEAD_LINES)
    counted = lines.groupBy("path", csvfeeds.delimiter_counts(F.col("line")).alias("counts")).agg(F.count("*").alias("lines"), F.min(F.when(F.col("pos") == 0, 0)).alias("header"))
    return csvfeeds.delimiters(counted, "path")


def _packed(kind, records):
    """An archive with a CSV feed, a workbook, or an archive with an XML document."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        if kind == 0:
            z.writestr("notes.txt", "-")
            z.writestr("feed.csv", "\n".join(";".join(r) for r in [("sku", "title", "brand"), *records]))
        elif kind == 1:
            cell = lambda v: f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
            rows = ["<row>" + "".join(map(cell, r)) + "</row>" for r in [("sku", "title", "brand"), *records]]
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{''.join(rows)}</sheetData></worksheet>")
        else:
            things = [f"<thing><sku>{s}</sku><title>{escape(t)}</title><brand>{escape(b)}</brand></thing>" for s, t, b in records]
            z.writestr("feed.xml", f"<shop>{''.join(things)}</shop>")
    return buffer.getvalue()


def packed_scan(spark, sf_dir):
    """The parts, a hundred to a packed file, unpacked and read."""
    import pandas as pd

    def pack(part):
        records = list(zip(part["p_partkey"].astype(str), part["p_name"], part["p_brand"]))
        return pd.DataFrame({"_file": part["_file"][:1], "content": [_packed(int(part["g"].iloc[0]) % 3, records)]})

    contents = spark_sql(spark, sf_dir, feeds.PACKED).groupBy("_file").applyInPandas(pack, "_file string, content binary")
    folder = scratch_folder(spark, "packed")
    packed.land(contents, folder)
    groups, errors, _ = packed.landed_groups(spark, folder)
    assert not errors, errors
    frames = [g.read(g.files).select("_file", "sku", "title", "brand") for g in groups]
    return reduce(DataFrame.unionByName, frames)


def csv_inch_mark(spark, sf_dir):
    """Inch marks inside cells do not make quoted values; values over two lines do."""
    folder = scratch_folder(spark, "quotes")
    for file in ("inch.csv", "lines.csv"):
        lines = spark_sql(spark, sf_dir, feeds.QUOTED).filter(F.col("_file") == file).select(F.col("line").alias("sku,title"))
        # written as they stand: one column without quotes, the header line above each part
        lines.write.option("header", True).option("quote", "").option("sep", "\x02").csv(f"{folder}/{file}")
    paths, _ = listing.feed_paths(spark, folder)
    marks = csvfeeds.profile(spark, [p for ps in paths.values() for p in ps])
    marks = marks.groupBy(listing.feed_name(F.col("path"), folder).alias("_file")).agg(F.bool_or("quoted_newline").alias("quoted_newline"))
    (rows,) = scan(spark, folder)
    found = rows.groupBy("_file").agg(F.count("*").alias("rows"), F.sum(F.length("title")).alias("characters"))
    return found.join(marks, "_file")


def xml_root_children(spark, sf_dir):
    """Records without a known name: the children of the root."""
    folder = scratch_folder(spark, "children")
    parts = spark_sql(spark, sf_dir, "SELECT p_partkey AS sku, p_name AS title, p_brand AS brand FROM {part}")
    parts.write.format("xml").option("rootTag", "shop").option("rowTag", "thing").save(f"{folder}/parts.xml")
    (rows,) = scan(spark, folder)
    return rows.select("_file", "sku", "title", "brand")


def faulty_folders(spark, sf_dir, repair=False):
    """Parts with their own column order, an empty feed, two feeds of one name, and records that do not parse."""
    folder = scratch_folder(spark, "faults")
    parts = spark_sql(spark, sf_dir, "SELECT p_partkey AS sku, p_name AS title FROM {part}")
    some = parts.filter("sku % 11 <> 0")
    for side, rows in (("base", parts), ("new", some)):
        to = f"{folder}/{side}"
        even = rows.filter("sku % 2 = 0").select("title", "sku")
        csv = lambda df, file: df.write.mode("append").option("header", True).csv(f"{to}/{file}")
        csv(rows.filter("sku % 2 = 1"), "parts.csv")
        csv(even if side == "base" else even.select("sku", "title"), "parts.csv")
        csv(rows, "shop.csv")
        if side == "base":
            rows.withColumnRenamed("sku", "id").write.format("xml").option("rowTag", "item").save(f"{to}/shop.xml")
            rows.filter("sku < 0").select("title").write.text(f"{to}/empty.csv")
        else:
            csv(rows, "empty.csv")
        end = F.when(F.col("sku") % 10 == (3 if side == "base" else 7), "</wrong></item>").otherwise("</title></item>")
        record = F.concat(F.lit("<item><sku>"), "sku", F.lit("</sku><title>"), "title", end)
        rows.select(record).write.text(f"{to}/dirty.xml")
    return compare_folders(spark, f"{folder}/base", f"{folder}/new", key="sku", pair_by_stem=True, repair=repair)


def folder_faults(spark, sf_dir):
    found = faulty_folders(spark, sf_dir).pair_summary
    return found.select("_file", "status", "reason", "rows_1", "rows_2", "common", "rejects_1", "rejects_2")


def folder_faults_log(spark, sf_dir):
    log = runlog.filter_log(faulty_folders(spark, sf_dir).run_log, ["WARN", "ERROR"])
    return log.select("category", "file", "message")


def folder_repaired(spark, sf_dir):
    """The same folders when broken records are repaired: none is lost."""
    compared = faulty_folders(spark, sf_dir, repair=True)
    mended = compared.repairs.groupBy("_file").agg(F.count("*").alias("repaired"))
    found = compared.pair_summary.join(mended, "_file", "left")
    return found.select("_file", "rows_1", "rows_2", "common", "total_differences", "rejects_1", "rejects_2", F.coalesce("repaired", F.lit(0)).alias("repaired"))


def xml_markup(spark, sf_dir):
    """Markup in comments, CDATA and attribute values starts no records; children of children get a column each."""
    folder = scratch_folder(spark, "markup")
    spark_sql(spark, sf_dir, feeds.MARKUP).select("record").write.text(f"{folder}/parts.xml")
    (rows,) = scan(spark, folder)
    return rows.select(F.col("@code").alias("code"), "sku", "title", "dims_w", "dims_h", "tag")


def csv_wrapped(spark, sf_dir):
    """Header cells and values with line ends."""
    folder = scratch_folder(spark, "wrapped")
    lines = spark_sql(spark, sf_dir, feeds.WRAPPED).groupBy(F.floor(F.col("sku") / 500).alias("part")).agg(F.array_join(F.collect_list("line"), "\n").alias("lines"))
    texts = lines.select("part", F.concat(F.lit('sku,"long\ntitle",brand\n'), "lines").alias("value"))
    texts.write.partitionBy("part").text(f"{folder}/wrapped.csv")
    (rows,) = scan(spark, folder)
    return rows.select("sku", F.col("long\ntitle").alias("title"), "brand")


def csv_late_delimiter(spark, sf_dir):
    """The delimiter comes from the whole text."""
    folder = scratch_folder(spark, "late")
    lines = spark_sql(spark, sf_dir, feeds.LATE).orderBy("sku").select(F.concat(F.col("sku").cast("string"), F.lit(","), "title").alias("sku,title;x"))
    lines.write.option("header", True).option("quote", "").option("sep", "\x02").csv(f"{folder}/late.csv")
    (rows,) = scan(spark, folder)
    return rows.select("sku", F.col("title;x").alias("title"))


def csv_encodings(spark, sf_dir):
    """Feeds in three encodings."""
    folder = scratch_folder(spark, "encodings")
    rows = spark_sql(working_session(spark), sf_dir, feeds.ENCODED)
    for file, encoding in feeds.FILE_ENCODINGS.items():
        rows.filter(F.col("_file") == file).drop("_file").write.option("header", True).option("encoding", encoding).csv(f"{folder}/{file}")
    (rows,) = scan(spark, folder)
    return rows.select("_file", "sku", "title")


def discovered_columns(spark, sf_dir):
    """Columns of CSV and XML feeds, and the key columns found among them."""
    base = scratch_folder(spark, "discovery")
    for side, sql in (("base", feeds.FILES_A), ("new", feeds.FILES_B)):
        _write_folder(spark, sf_dir, sql, f"{base}/{side}")
    found = feed_columns(spark, f"{base}/base", 1).unionByName(feed_columns(spark, f"{base}/new", 2))
    keys = detect.resolve_keys(found).select("_file", F.col("key_1").alias("key"))
    return found.join(keys, "_file").select("_file", "side", "column", "key")


def _report(spark, sf_dir, table):
    """A table of the written report, and the place that each row has in it."""
    folder = scratch_folder(spark, "report")
    write_report(many_pairs(spark, sf_dir), folder)
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/{table}")
    files = [F.col("_metadata.file_name"), F.monotonically_increasing_id()]
    by_file = Window.partitionBy("_file") if "_file" in rows.columns else Window.partitionBy(F.lit(0))
    return rows.select("*", *[c.alias(f"_at{i}") for i, c in enumerate(files)]).withColumn("place", F.row_number().over(by_file.orderBy("_at0", "_at1")))


def report_columns(spark, sf_dir):
    rates = _report(spark, sf_dir, "Column_Match_Rates")
    return rates.select("place", F.col("Column").alias("column"), F.col("Status").alias("status"), F.col("`Match_Rate_%`").cast("double").alias("match_rate"), F.col("Total").cast("long").alias("total"))


def report_files(spark, sf_dir):
    return _report(spark, sf_dir, "Files").select("place", F.col("File").alias("file"), F.col("rows_1").cast("long").alias("rows_1"), F.col("common").cast("long").alias("common"))


def report_differences(spark, sf_dir):
    return _report(spark, sf_dir, "Differences").select("_file", "place", "column", "sku", F.col("Value_F1").alias("value_1"), F.col("Value_F2").alias("value_2"))


def file_pairing(spark, sf_dir):
    return listing.pair_feeds(spark_sql(spark, sf_dir, feeds.LISTING_A), spark_sql(spark, sf_dir, feeds.LISTING_B))


def projects(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    entry = lambda i: F.struct((F.col("n_nationkey") * 10 + i).alias("id"), F.concat("n_name", F.lit(str(i))).alias("name"))
    body = F.to_json(F.struct((F.col("n_nationkey") % 6 != 0).alias("success"), F.array(entry(0), entry(1)).alias("Projects")))
    return catalog.projects(n.select(F.col("n_nationkey").cast("string").alias("response"), body.alias("body")))


def _site_responses(spark, sf_dir):
    text = lambda v: F.lit(v).cast("string")
    site = lambda i, t, n, s: F.struct(i.alias("id"), t.alias("title"), n.alias("name"), s.alias("status"))
    listed = F.array(
        site(F.col("k"), F.col("title"), F.col("name"), F.col("status")),
        site(F.col("k"), text("again"), text("again"), text("active")),
        site(F.col("k") + 1, text(None), text(None), text("inactive")),
    )
    body = F.to_json(F.struct((F.col("k") % 7 != 0).alias("success"), listed.alias("Sites")))
    return spark_sql(spark, sf_dir, feeds.SITES).select(F.col("k").cast("string").alias("response"), body.alias("body"))


def channel_links(spark, sf_dir):
    """Every shape of the destinations: list, empty list, text, other key, no object, absent."""
    shapes = F.expr("""CASE p_partkey % 6 WHEN 0 THEN concat(',"feed_destinations":{"2":["http://h/', p_partkey, '","http://x"]}')
        WHEN 1 THEN ',"feed_destinations":{"2":[]}' WHEN 2 THEN concat(',"feed_destinations":{"2":"http://s/', p_brand, '"}')
        WHEN 3 THEN ',"feed_destinations":{"1":"http://n"}' WHEN 4 THEN ',"feed_destinations":[1]' ELSE '' END""")
    item = F.concat(F.lit('{"name":"'), "p_name", F.lit('"'), shapes, F.lit("}"))
    body = F.concat(F.lit('{"success":true,"Channels":['), item, F.lit("]}"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return catalog.channels(parts.select(F.col("p_partkey").cast("string").alias("response"), body.alias("body")))


def channel_match(spark, sf_dir):
    return catalog.match_channels(spark_sql(spark, sf_dir, feeds.CHANNELS_A), spark_sql(spark, sf_dir, feeds.CHANNELS_B))


def channel_select(spark, sf_dir):
    chosen = spark_sql(spark, sf_dir, "SELECT p_name || ' ' || p_brand AS channel FROM {part} WHERE p_partkey % 4 = 0")
    return catalog.select_channels(channel_match(spark, sf_dir), chosen)


def channel_files(spark, sf_dir):
    return catalog.channel_files(channel_match(spark, sf_dir))


def feed_file_name(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", catalog.feed_file_name(F.col("page_id").cast("string"), F.col("url")).alias("file"))


def country_code(spark, sf_dir):
    return spark_sql(spark, sf_dir, feeds.SITE_NAMES).select("id", "site", nm.country_code(F.col("site")).alias("country"))


QUERIES = {
    "key_normalize": key_normalize,
    "key_normalize_wide": key_normalize_wide,
    "value_equality": value_equality,
    "dedupe_first": dedupe_first,
    "column_stats": frame(part_pair, "column_stats"),
    "diff_cells": frame(part_pair, "diff_cells"),
    "missing_keys": frame(part_pair, "missing_keys"),
    "key_presence": frame(part_pair, "key_presence"),
    "duplicate_counts": frame(part_pair, "duplicate_counts"),
    "pair_summary": frame(part_pair, "pair_summary"),
    "diff_preview": frame(part_pair, "diff_preview"),
    "column_exclusion": column_exclusion,
    "explicit_columns": explicit_columns,
    "line_column_stats": frame(line_pair, "column_stats"),
    "line_diff_cells": frame(line_pair, "diff_cells"),
    "line_missing_keys": frame(line_pair, "missing_keys"),
    "line_pair_summary": frame(line_pair, "pair_summary"),
    "common_keys": common_keys,
    "only_in_1": only_in_1,
    "only_in_2": only_in_2,
    "files_column_stats": frame(many_pairs, "column_stats"),
    "files_column_stats_no_case": frame(many_pairs_no_case, "column_stats"),
    "files_pair_summary": frame(many_pairs, "pair_summary"),
    "overall_stats": frame(many_pairs, "overall_stats"),
    "channel_stats": channel_stats,
    "stats_by_level": stats_by_level,
    "one_side_empty": one_side_empty,
    "run_summary": frame(many_pairs, "run_summary"),
    "preview_overall": preview_overall,
    "diff_export": diff_export,
    "log_summary": log_summary,
    "log_filter": log_filter,
    "column_names": column_names,
    "column_scores": column_scores,
    "column_scores_guided": column_scores_guided,
    "top_candidates": top_candidates,
    "detected_keys": detected_keys,
    "paired_keys": paired_keys,
    "resolved_keys": resolved_keys,
    "resolved_keys_manual": resolved_keys_manual,
    "csv_scan": csv_scan,
    "csv_delimiters": csv_delimiters,
    "packed_scan": packed_scan,
    "csv_inch_mark": csv_inch_mark,
    "xml_root_children": xml_root_children,
    "xml_markup": xml_markup,
    "csv_wrapped": csv_wrapped,
    "csv_late_delimiter": csv_late_delimiter,
    "folder_repaired": folder_repaired,
    "csv_encodings": csv_encodings,
    "discovered_columns": discovered_columns,
    "report_columns": report_columns,
    "report_files": report_files,
    "report_differences": report_differences,
    "folder_faults": folder_faults,
    "folder_faults_log": folder_faults_log,
    "folder_faults_run": frame(faulty_folders, "run_summary"),
    "file_pairing": file_pairing,
    "folder_column_stats": frame(folders, "column_stats"),
    "folder_diff_cells": folder_diff_cells,
    "folder_pair_summary": frame(folders, "pair_summary"),
    "folder_missing_keys": frame(folders, "missing_keys"),
    "projects": projects,
    "site_dedupe": lambda spark, sf_dir: catalog.sites(_site_responses(spark, sf_dir)),
    "site_dedupe_active": lambda spark, sf_dir: catalog.sites(_site_responses(spark, sf_dir), only_active=True),
    "channel_links": channel_links,
    "channel_match": channel_match,
    "channel_select": channel_select,
    "channel_files": channel_files,
    "feed_file_name": feed_file_name,
    "country_code": country_code,
}
