"""Comparison semantics, invariants and independence of partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from checks import feeds
from rowtally import reconcile
from rowtally.operators import compare, rollup, runlog
from rowtally.operators.align import first_per_key
from rowtally.functions.keys import with_key
from rowtally.sinks import report

SF = "/root/testdata/sf0.001"
ROWS = "ord int, sku string, a string, `b.c` string"


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def part_pair(spark):
    return [feeds.spark_sql(spark, SF, s) for s in (feeds.PART_A, feeds.PART_B)]


def test_planted_counts(spark):
    """Counts that follow from how the pair was made, at the size for which they are known."""
    a, b = (feeds.spark_sql(spark, "/root/testdata/sf0.01", s) for s in (feeds.PART_A, feeds.PART_B))
    r = reconcile(a, b, key="sku", order_by="ord")
    s = r.pair_summary.first()
    assert (s["common"], s["only_1"], s["only_2"], s["rows_1"], s["rows_2"]) == (1678, 168, 140, 1957, 1818)
    rates = {x["column"]: (x["exact_matches"], x["both_empty"], x["only_2_empty"], x["match_rate"]) for x in r.column_stats.collect()}
    assert rates == {"brand": (1621, 0, 57, 96.6), "kind": (1626, 88, 52, 96.9), "retail": (1632, 0, 0, 97.26),
                     "size": (1678, 0, 0, 100.0), "title": (1605, 0, 0, 95.65)}


def test_invariants(part_pair):
    r = reconcile(*part_pair, key="sku", order_by="ord")
    stats = r.column_stats.collect()
    diffs = r.diff_cells.groupBy("_file", "column").count().collect()
    per_column = {(d["_file"], d["column"]): d["count"] for d in diffs}
    for s in stats:
        assert s["exact_matches"] + s["mismatches"] == s["total_compared"]
        assert s["both_empty"] <= s["exact_matches"]
        assert s["only_1_empty"] + s["only_2_empty"] <= s["mismatches"] == per_column.get((s["_file"], s["column"]), 0)
    p = r.pair_summary.first()
    assert p["common"] + p["only_1"] == p["keys_1"] and p["common"] + p["only_2"] == p["keys_2"]
    assert r.missing_keys.count() == p["only_1"] + p["only_2"]
    assert r.key_presence.filter("presence = 'both'").count() == p["common"]


def test_mirror_and_self(part_pair):
    a, b = part_pair
    one = {s["column"]: s for s in reconcile(a, b, key="sku", order_by="ord").column_stats.collect()}
    two = {s["column"]: s for s in reconcile(b, a, key="sku", order_by="ord").column_stats.collect()}
    for c in one:
        assert (one[c]["only_1_empty"], one[c]["only_2_empty"]) == (two[c]["only_2_empty"], two[c]["only_1_empty"])
        assert one[c]["exact_matches"] == two[c]["exact_matches"]
    assert {s["status"] for s in reconcile(a, a, key="sku", order_by="ord").column_stats.collect()} == {"PERFECT"}
    assert reconcile(a, a, key="sku", order_by="ord").diff_cells.count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_result_does_not_depend_on_partitions(spark, part_pair, partitions):
    a, b = (df.repartition(partitions) for df in part_pair)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = reconcile(a, b, key="sku", order_by="ord")
        result = tuples(got.column_stats), tuples(got.diff_cells), tuples(got.missing_keys)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = reconcile(*part_pair, key="sku", order_by="ord")
    assert result == (tuples(want.column_stats), tuples(want.diff_cells), tuples(want.missing_keys))


def test_materialised_results_are_the_same(part_pair, tmp_path):
    lazy = reconcile(*part_pair, key="sku", order_by="ord")
    stored = reconcile(*part_pair, key="sku", order_by="ord").materialize(str(tmp_path / "cells"))
    assert tuples(stored.column_stats) == tuples(lazy.column_stats)
    assert tuples(stored.diff_cells) == tuples(lazy.diff_cells)


def brute(rows_1, rows_2, columns):
    """Plain Python over key-normalised rows: counters per column and differing cells."""
    first = []
    for rows in (rows_1, rows_2):
        seen = {}
        for r in sorted(rows):
            seen.setdefault(r[1].strip(), r)
        first.append({k: r for k, r in seen.items() if k})
    stats, diffs = {c: [0, 0] for c in columns}, set()
    for k in first[0].keys() & first[1].keys():
        for i, c in enumerate(columns):
            v, w = first[0][k][2 + i], first[1][k][2 + i]
            same = (v or "") == (w or "")
            stats[c][not same] += 1
            if not same:
                diffs.add((k, c, v, w))
    return stats, diffs


def test_random_rows_with_a_hot_key_against_brute_force(spark):
    rnd = random.Random(7)
    def make(seed):
        out = []
        for i in range(3000):
            sku = " hot " if rnd.random() < 0.4 else f"k{rnd.randrange(400)}" + " " * rnd.randrange(2)
            out.append((i, rnd.choice([sku, sku, sku, "", " "]), rnd.choice(["x", "y", "", None]), rnd.choice(["p", "q"])))
        return out
    a, b = make(1), make(2)
    r = reconcile(spark.createDataFrame(a, ROWS).repartition(7), spark.createDataFrame(b, ROWS).repartition(5), key="sku", order_by="ord")
    stats, diffs = brute(a, b, ["a", "b.c"])
    assert {x["column"]: [x["exact_matches"], x["mismatches"]] for x in r.column_stats.collect()} == stats
    assert {(x["sku"], x["column"], x["value_1"], x["value_2"]) for x in r.diff_cells.collect()} == diffs
    p = r.pair_summary.first()
    assert p["rows_1"] == 3000 and p["raw_distinct_1"] == len({x[1] for x in a if x[1]})
    assert p["duplicates_1"] == sum(1 for x in a if x[1].strip()) - len({x[1].strip() for x in a if x[1].strip()})


def test_hot_duplicates_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, "hot", "x", "y") for i in range(100)], ROWS)
    keyed = with_key(df.select(F.lit("f").alias("_file"), F.col("sku").alias("_raw"), F.col("ord").alias("_ord"), "a"), "_raw", "_key")
    plan = first_per_key(keyed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_plan_reads_needed_columns_and_shuffles_once_per_side(spark, part_pair):
    r = reconcile(*[df.withColumn("unused", F.lit("x")) for df in part_pair], key="sku", order_by="ord", compare_columns=["brand"])
    plan = r.aligned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "unused" not in plan
    assert "p_name" not in plan and "p_retailprice" not in plan
    keys_only = r.key_presence._jdf.queryExecution().executedPlan().toString()
    assert "p_brand" not in keys_only


def test_wide_tables_are_unfolded_in_blocks(spark):
    wide = spark.range(5).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("sku"), *[F.lit("v").alias(f"c{i:03}") for i in range(230)])
    changed = wide.withColumn("c117", F.when(F.col("ord") == 3, "w").otherwise(F.col("c117"))).withColumn("c229", F.lit(""))
    r = reconcile(wide, changed, key="sku", order_by="ord")
    assert r.column_stats.count() == 230
    assert r.diff_cells.groupBy("column").count().orderBy("column").collect() == [("c117", 1), ("c229", 5)]


def test_no_shared_keys_or_columns(spark):
    a = spark.createDataFrame([(1, "x", "1", "1")], ROWS)
    b = spark.createDataFrame([(1, "y", "1", "1")], ROWS)
    r = reconcile(a, b, key="sku", order_by="ord")
    assert [(s["total_compared"], s["match_rate"], s["status"]) for s in r.column_stats.collect()] == [(0, 0.0, "BAD")] * 2
    assert [(s["total_compared"], s["status"]) for s in r.materialize().column_stats.collect()] == [(0, "BAD")] * 2
    none = reconcile(a, b, key="sku", order_by="ord", compare_columns=["nowhere"])
    assert none.column_stats.count() == 0 and none.diff_cells.count() == 0
    assert none.pair_summary.first()["columns_compared"] == 0


def test_typed_columns(spark):
    a = spark.sql("SELECT 1L ord, 7 sku, double('nan') x, 1.50 y, true z UNION ALL SELECT 2L, 8, 1.0D, 2.0, false")
    b = spark.sql("SELECT 1L ord, '007' sku, '' x, '1.5' y, 'true' z UNION ALL SELECT 2L, '8', '1', '3', 'FALSE'")
    r = reconcile(a, b, key="sku", order_by="ord")
    assert tuples(r.diff_cells.select("sku", "column", "value_1", "value_2")) == [("8", "y", "2.00", "3"), ("8", "z", "false", "FALSE")]


def test_key_choice(spark):
    a = spark.createDataFrame([(1, "x", "1", "1")], ROWS)
    b = a.withColumnRenamed("sku", "Item ID")
    assert (lambda r: (r.key_1, r.key_2, r.columns))(reconcile(a, b, order_by="ord")) == ("sku", "Item ID", ["a", "b.c"])
    with pytest.raises(ValueError, match="missing"):
        reconcile(a, b, key="sku", order_by="ord", auto_detect=False)
    with pytest.raises(ValueError, match="no key column given"):
        reconcile(a, a, order_by="ord", auto_detect=False)
    with pytest.raises(ValueError, match="order"):
        reconcile(a, a, key="sku")
    with pytest.raises(ValueError, match="detected"):
        reconcile(a.select("ord", "a"), a.select("ord", "a"), order_by="ord")


def test_choose_columns():
    choose = compare.choose_columns
    assert choose(["sku", "b", "a", "Price"], ["a", "b", "sku", "price"], ["sku"]) == ["a", "b"]
    assert choose(["x", "y", "Stock_DE"], ["y", "x", "Stock_DE"], [], ["y", "z", "x", "y", "Stock_DE"], ["stock"]) == ["y", "x"]


def test_run_log(part_pair):
    r = reconcile(*part_pair, key="sku", order_by="ord")
    log = r.run_log
    assert runlog.filter_log(log, ["MISS"]).count() == 1
    assert {x["category"]: x["events"] for x in runlog.log_summary(log).collect()}["MATCH"] == 2
    assert set(x["category"] for x in log.collect()) <= set(runlog.CATEGORIES)


def test_report(spark, part_pair, tmp_path):
    r = reconcile(*[df.drop("_file") for df in part_pair], key="sku", order_by="ord", label="pa:rt.csv")
    names = spark.createDataFrame([("pa:rt.csv", "Parts/1")], "_file string, display string")
    report.write_report(r, str(tmp_path / "plain"))
    report.write_report(r, str(tmp_path / "named"), merge_diffs=True, names=names, labels=("shop.DE", "shop.AT"))
    read = lambda p: spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / p))
    assert read("plain/Summary").first()["total_pairs"] == "1"
    rates = [float(x["Match_Rate_%"]) for x in read("plain/Column_Match_Rates").collect()]
    assert len(rates) == 5
    diffs = read("plain/Differences")
    assert diffs.columns == ["sku", "column", "Value_F1", "Value_F2", "_file"]
    assert diffs.count() == r.diff_cells.count()
    assert diffs.filter("column = 'brand'").select("Value_F2").distinct().collect() == [("EMPTY",)]
    assert {x["_file"] for x in diffs.select("_file").distinct().collect()} == {"pa:rt.csv"}
    merged = read("named/Differences")
    assert merged.columns == ["Channel", "sku", "column", "shop.DE", "shop.AT"] and merged.first()["Channel"] == "Parts/1"
    assert read("named/Files").first()["File"] == "Parts/1"
    assert set(read("named/Column_Match_Rates").columns) == {"Column", "Channel", "Status", "Match_Rate_%", "Matches", "Mismatches", "Total"}
    raw = next((tmp_path / "plain/Summary").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbftotal_pairs")


def test_a_report_goes_on_where_it_stopped(spark, part_pair, tmp_path, monkeypatch):
    r = reconcile(*[df.drop("_file") for df in part_pair], key="sku", order_by="ord")
    whole, written = report.write_table, []

    def failing(df, path, *rest, **options):
        written.append(path.rsplit("/", 1)[1])
        if written.count("Files") == 1 and written[-1] == "Files":
            df.limit(1).write.csv(path)
            raise RuntimeError("lost")
        whole(df, path, *rest, **options)

    monkeypatch.setattr(report, "write_table", failing)
    with pytest.raises(RuntimeError):
        report.write_report(r, str(tmp_path / "report"))
    report.write_report(r, str(tmp_path / "report"))
    assert written == ["Summary", "Column_Match_Rates", "Files", "Files", "Debug_Log", "Missing_Keys", "Differences"]
    assert spark.read.option("header", True).csv(str(tmp_path / "report/Files")).count() == 1
    with pytest.raises(ValueError, match="complete"):
        report.write_report(r, str(tmp_path / "report"))


def test_levels_agree(part_pair):
    stats = reconcile(*part_pair, key="sku", order_by="ord").column_stats
    both = rollup.stats_by_level(stats)
    assert both.filter("_file IS NULL").count() == rollup.overall_stats(stats).count() == 5
