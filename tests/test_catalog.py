"""Landed catalogue responses."""

import json

import pytest

from pyspark.sql import functions as F

from rowtally.operators import catalog, rollup


def land(folder, **responses):
    folder.mkdir()
    for name, body in responses.items():
        (folder / f"{name}.json").write_text(json.dumps(body, indent=1))
    return str(folder)


def test_projects_and_sites(spark, tmp_path):
    folder = land(tmp_path / "p", a={"success": True, "Projects": [{"id": 1, "name": "one", "x": []}, {"id": "2", "name": "two"}]},
                  b={"success": False, "Projects": [{"id": 3, "name": "no"}]}, c={"error": 1})
    got = catalog.projects(catalog.read_responses(spark, folder))
    assert sorted((r["id"], r["name"]) for r in got.collect()) == [("1", "one"), ("2", "two")]
    folder = land(tmp_path / "s", a={"success": True, "Sites": [
        {"id": 5, "title": "T", "name": "n", "status": "active"}, {"id": 5, "title": "later"}, {"id": 6, "title": "", "name": "n6"},
        {"id": 7}, {"id": 8, "name": "n8", "status": "inactive"}]})
    responses = catalog.read_responses(spark, folder)
    assert sorted(tuple(r)[1:] for r in catalog.sites(responses).collect()) == [
        ("5", "T", "active"), ("6", "n6", "unknown"), ("7", "Site_7", "unknown"), ("8", "n8", "inactive")]
    assert [tuple(r)[1:] for r in catalog.sites(responses, only_active=True).collect()] == [("5", "T", "active")]


def test_channels_and_files(spark, tmp_path):
    def response(*channels):
        return {"success": True, "Channels": [{"name": n, **({} if d is None else {"feed_destinations": d})} for n, d in channels]}

    one = land(tmp_path / "one", c=response(("Ads", {"2": ["http://h/f.xml?a=b.c", "http://x"]}), ("Empty", {"2": []}), ("Text", {"2": "http://t/feed"}),
                                            ("None", None), ("List", [1]), ("Other", {"1": "http://o"}), ("ads", {"2": "http://last/z.zip"})))
    two = land(tmp_path / "two", c=response(("ADS", {"2": ["http://b.shop/f"]}), ("text", {"2": "http://t/a.csv"}), ("only", {"2": "x"})))
    ch1, ch2 = (catalog.channels(catalog.read_responses(spark, f)) for f in (one, two))
    assert {(r["pos"], r["name"]): r["link"] for r in ch1.collect()} == {
        (0, "Ads"): "http://h/f.xml?a=b.c", (1, "Empty"): "", (2, "Text"): "http://t/feed", (3, "None"): "", (4, "List"): "", (5, "Other"): "", (6, "ads"): "http://last/z.zip"}
    matched = catalog.match_channels(ch1, ch2)
    assert sorted(map(tuple, matched.collect())) == [
        ("ads", "ads", "http://last/z.zip", "http://b.shop/f"), ("text", "Text", "http://t/feed", "http://t/a.csv")]
    assert sorted(map(tuple, catalog.channel_files(matched).collect())) == [("Text", "Text.csv", "Text.csv"), ("ads", "ads.zip", "ads.csv")]
    chosen = spark.createDataFrame([("Text",)], "channel string")
    assert [r["channel"] for r in catalog.select_channels(matched, chosen).collect()] == ["Text"]
    stats = spark.createDataFrame([("Text.csv",), ("else.csv",)], "_file string")
    shown = rollup.display_name(stats, catalog.display_names(matched))
    assert {r["_file"]: r["display"] for r in shown.collect()} == {"Text.csv": "Text", "else.csv": "else.csv"}


def test_file_names(spark):
    links = {"http://h/a.b/f": "c.csv", "http://h/f.tar.gz?x=.q": "c.gz", "": None, "http://h/.hidden": "c.csv", "f.XML": "c.XML"}
    df = spark.createDataFrame([(k,) for k in links], "link string")
    got = {r[0]: r[1] for r in df.select("link", catalog.feed_file_name(F.lit("c"), F.col("link"))).collect()}
    assert got == links


def test_channels_compared_across_formats(spark, tmp_path):
    from rowtally import compare_channels

    for side, files in {"one": {"Ads.csv": "sku,price\n1,5\n2,6\n", "Text.csv": "sku,price\n1,1\n", "Other.csv": "sku\n1\n"},
                        "two": {"Ads.xml": "<r><item><sku>1</sku><price>5.0</price></item><item><sku>2</sku><price>7</price></item></r>",
                                "Text.csv": "sku,price\n1,1\n"}}.items():
        (tmp_path / side).mkdir()
        for name, text in files.items():
            (tmp_path / side / name).write_text(text)
    schema = "pos int, name string, link string"
    one = spark.createDataFrame([(0, "Ads", "http://a/f"), (1, "Text", "http://t"), (2, "Other", "http://o"), (3, "none", "")], schema)
    two = spark.createDataFrame([(0, "ADS", "http://b/f.xml"), (1, "text", "http://t"), (2, "none", "x")], schema)
    result, names = compare_channels(spark, str(tmp_path / "one"), str(tmp_path / "two"), one, two)
    assert {r["_file"]: r["status"] for r in result.pair_summary.collect()} == {"Ads": "success", "Text": "success"}
    assert [tuple(r) for r in result.diff_cells.collect()] == [("Ads", "2", "price", "6", "7")]
    assert {(r["channel"], r["match_rate"]) for r in result.channel_stats(names).collect()} == {("Ads", 50.0), ("Text", 100.0)}
    chosen = spark.createDataFrame([("Text",)], "channel string")
    result, _ = compare_channels(spark, str(tmp_path / "one"), str(tmp_path / "two"), one, two, selection=chosen)
    assert [r["_file"] for r in result.pair_summary.collect()] == ["Text"]


@pytest.mark.parametrize("parts", [1, 4])
def test_of_several_responses_the_last_counts(spark, parts):
    one = spark.createDataFrame([("r1", 0, "X", "l1"), ("r2", 0, "x", "l2"), ("r1", 3, "x", "l3")], "response string, pos int, name string, link string").repartition(parts)
    two = spark.createDataFrame([("q", 0, "x", "m")], one.schema)
    assert [(r["channel"], r["link_1"]) for r in catalog.match_channels(one, two).collect()] == [("x", "l2")]
