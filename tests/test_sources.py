"""Readers on generated files: dialects, encodings, XML shapes, archives, pairing."""

import io
import zipfile
from types import SimpleNamespace

import pytest

from rowtally import compare_folders
from rowtally.session import scratch_folder, working_session
from rowtally.sinks.report import write_report
from rowtally.sources import csvfeeds, listing, packed
from rowtally.sources.scan import feed_paths, scan, scan_folder


def write(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return path


def rows(spark, folder, pattern=None, **options):
    """``{file: [row as dict in order]}``"""
    out = {}
    for df in scan(spark, str(folder), pattern, **options):
        for r in df.orderBy("_file", "_ord").collect():
            d = r.asDict()
            d.pop("_ord")
            out.setdefault(d.pop("_file"), []).append(d)
    return out


DELIMITED = {"pipe": "|", "semi": ";", "tab": "\t", "comma": ",", "tilde": "~", "caret": "^", "x01": "\x01"}


def test_delimiters_and_order(spark, tmp_path):
    for name, d in DELIMITED.items():
        lines = [d.join(("sku", "title", "price"))] + [d.join((str(i), f"t {i}", f"{i}.5")) for i in range(30)]
        write(tmp_path, f"{name}.csv", "\n".join(lines) + "\n")
    write(tmp_path, "one.csv", "sku\n1\n2\n")
    got = rows(spark, tmp_path)
    for name in DELIMITED:
        assert got[f"{name}.csv"] == [{"sku": str(i), "title": f"t {i}", "price": f"{i}.5"} for i in range(30)], name
    assert got["one.csv"] == [{"sku": "1"}, {"sku": "2"}]


def test_quoted_delimiters_do_not_mislead(spark, tmp_path):
    write(tmp_path, "q.csv", 'sku;title\n1;"a,b,c"\n2;"d,e,f"\n3;"g;h,i"\n')
    assert rows(spark, tmp_path)["q.csv"][2] == {"sku": "3", "title": "g;h,i"}


def test_unsteady_counts_fall_back_to_the_widest_header(spark, tmp_path):
    write(tmp_path, "u.csv", "sku|title|price\n1|a\n2|b|c|d\n")
    assert rows(spark, tmp_path)["u.csv"][0] == {"sku": "1", "title": "a", "price": None}


def test_encodings(spark, tmp_path):
    write(tmp_path, "utf8.csv", "sku,title\n1,Größe 中\n")
    write(tmp_path, "bom.csv", "﻿sku,title\n1,Größe\n")
    write(tmp_path, "gbk.csv", "sku,title\n1,中文字\n".encode("gbk"))
    write(tmp_path, "latin1.csv", b"sku,title\n1,Stra\xdfe \xff\n")
    # the first byte that is no UTF-8 comes long after any sample
    late = "sku,title\n" + "".join(f"{i},plain\n" for i in range(40000))
    write(tmp_path, "late.csv", late.encode() + "x,中文字\n".encode("gbk"))
    got = rows(spark, tmp_path)
    assert got["utf8.csv"][0]["title"] == "Größe 中"
    assert got["bom.csv"] == [{"sku": "1", "title": "Größe"}]
    assert got["gbk.csv"][0]["title"] == "中文字"
    assert got["latin1.csv"][0]["title"] == "Straße ÿ"
    assert got["late.csv"][-1] == {"sku": "x", "title": "中文字"} and len(got["late.csv"]) == 40001


def test_ragged_quotes_and_line_ends_in_values(spark, tmp_path):
    write(tmp_path, "ragged.csv", 'sku,title,price\n1,a,2,extra\n2,,""\n3\n4,"say ""hi""",5\n')
    write(tmp_path, "multi.csv", 'sku,title\n1,"two\nlines"\n2,b\n')
    got = rows(spark, tmp_path)
    assert got["ragged.csv"][0] == {"sku": "1", "title": "a", "price": "2"}
    assert [r["price"] or "" for r in got["ragged.csv"]] == ["2", "", "", "5"]
    assert got["ragged.csv"][3]["title"] == 'say "hi"'
    assert got["multi.csv"] == [{"sku": "1", "title": "two\nlines"}, {"sku": "2", "title": "b"}]


def test_header_names(spark, tmp_path):
    write(tmp_path, "dupcase.csv", "sku,Price,price,a.b,a:b,x,x\n1,2,3,4,5,6,7\n")
    assert rows(spark, tmp_path)["dupcase.csv"] == [
        {"sku": "1", "Price": "2", "price": "3", "a.b": "4", "a:b": "5", "x": "6", "x_duplicated_0": "7"}
    ]


def test_order_over_splits_and_part_files(spark, tmp_path):
    n = 20000
    write(tmp_path / "f", "big.csv", "sku,v\n" + "".join(f"{i % 7},{i}\n" for i in range(n)))
    for part in range(3):
        write(tmp_path / "f", f"parts.csv/part-0000{part}.csv", "sku,v\n" + "".join(f"k,{part * 10 + i}\n" for i in range(5)))
    small = working_session(spark, **{"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"})
    dialect = csvfeeds.Dialect(",", "UTF-8", False)
    folder = str(tmp_path / "f")
    feeds, _ = feed_paths(small, folder)
    df = csvfeeds.read_csv(small, folder, feeds["big.csv"], ["sku", "v"], dialect)
    assert df.rdd.getNumPartitions() > 3
    assert [int(r["v"]) for r in df.orderBy("_ord").collect()] == list(range(n))
    got = rows(spark, tmp_path / "f", "parts*")
    assert [r["v"] for r in got["parts.csv"]] == [str(p * 10 + i) for p in range(3) for i in range(5)]


def test_given_dialect_skips_the_full_pass(spark, tmp_path, monkeypatch):
    write(tmp_path, "a.csv", "sku,v\n1,2\n")
    monkeypatch.setattr(csvfeeds, "profile", lambda *a: pytest.fail("whole files were read"))
    assert rows(spark, tmp_path, encoding="UTF-8", multiline=False, delimiter=",") == {"a.csv": [{"sku": "1", "v": "2"}]}


RSS = """<?xml version="1.0" encoding="utf-16"?><rss xmlns:g="http://x"><channel><title>c</title>
<item k="1"><g:id> 1 </g:id><g:shipping><g:country>DE</g:country><g:price>2<u>x</u></g:price></g:shipping><tag>a</tag><tag>b</tag><e/></item>
<item k="2"><g:id>2</g:id><g:shipping><g:country>FR</g:country></g:shipping><g:shipping><g:price>9</g:price></g:shipping><tag>q</tag><n l="en">null</n></item>
<item><g:id>3CTRL</g:id><n>x</n></item>
<item><g:id>4</g:id></item>
</channel></rss>"""


def test_xml_records(spark, tmp_path):
    write(tmp_path, "feed.xml", "﻿" + RSS.replace("CTRL", ""))
    write(tmp_path, "dirty.xml", RSS.replace("CTRL", "\x01"))
    write(tmp_path, "entry.xml", "<feed><entry><a>1</a></entry><entry><a>2</a><b>x</b></entry></feed>")
    write(tmp_path, "line.xml", "<r><!-- item --><items/><x:product a='>' xmlns:x='u'><a>1</a></x:product><product/></r>")
    got = rows(spark, tmp_path)
    assert got.pop("line.xml")[0] == {"@a": ">", "a": "1"}
    empty = {"@k": "", "e": "", "id": "", "n": "", "shipping_country": "", "shipping_price": "", "tag": ""}
    expected = [
        {**empty, "@k": "1", "id": "1", "shipping_country": "DE", "shipping_price": "2", "tag": "b"},
        {**empty, "@k": "2", "id": "2", "shipping_country": "FR", "shipping_price": "9", "tag": "q", "n": "null"},
        {**empty, "id": "3", "n": "x"},
        {**empty, "id": "4"},
    ]
    assert got["feed.xml"] == expected
    assert got["dirty.xml"] == expected
    assert got["entry.xml"] == [{"a": "1", "b": ""}, {"a": "2", "b": "x"}]


def test_xml_rejects_are_kept_apart(spark, tmp_path):
    write(tmp_path, "bad.xml", "<r><item><a>1</a></item><item><a>2</b></item><item><a>3</a></item></r>")
    feeds, _ = feed_paths(spark, str(tmp_path))
    found = scan_folder(spark, str(tmp_path), feeds, repair=False)
    assert [r["a"] for r in found.groups[0].read(["bad.xml"]).orderBy("_ord").collect()] == ["1", "3"]
    assert [r["record"] for r in found.rejects[0].collect()] == ["<item><a>2</b></item>"]


def test_xml_root_children(spark, tmp_path):
    write(tmp_path, "root.xml", '<shop><thing id="7"><n>1</n></thing><thing><n>2</n><m><k>3</k></m></thing></shop>')
    assert rows(spark, tmp_path)["root.xml"] == [{"n": "1", "@id": "7", "m_k": ""}, {"n": "2", "@id": "", "m_k": "3"}]


def test_xml_root_children_of_several_names(spark, tmp_path):
    write(tmp_path, "mixed.xml", '<?xml version="1.0"?><!DOCTYPE shop [<!ELEMENT x ANY>]><shop><meta><title>x</title></meta><!-- <thing/> > -->'
          '<thing id="a>b"><n>1</n><![CDATA[</thing><n>]]></thing><other/><thing><n>2</n></thing><meta><title>\ny</title></meta></shop>')
    write(tmp_path, "inner.xml", "<shop><thing><n>1</n></thing><box><thing>5</thing></box></shop>")
    write(tmp_path, "root.xml", "<a><a><n>1</n></a><a><n>2</n></a></a>")
    write(tmp_path, "spaces.xml", "<s><x:b xmlns:x='u' x:k='1'><x:n>1</x:n></x:b><b><n>2</n></b></s>")
    for part, k in (("part-0", 1), ("part-1", 3)):
        write(tmp_path, f"parts.xml/{part}.xml", f"<s><b><n>{k}</n></b><c><n>{k + 1}</n></c></s>" + "\n" * (9 - k))
    got = rows(spark, tmp_path)
    empty = {"title": "", "n": "", "@id": ""}
    assert got["mixed.xml"] == [{**empty, "title": "x"}, {**empty, "n": "1", "@id": "a>b"}, empty, {**empty, "n": "2"}, {**empty, "title": "y"}]
    assert got["inner.xml"] == [{"n": "1", "thing": ""}, {"n": "", "thing": "5"}]
    assert got["root.xml"] == [{"n": "1"}, {"n": "2"}]
    assert got["spaces.xml"] == [{"n": "1", "@k": "1"}, {"n": "2", "@k": ""}]
    assert [r["n"] for r in got["parts.xml"]] == ["1", "2", "3", "4"]


def test_xml_faults_among_root_children_are_rejects(spark, tmp_path):
    write(tmp_path, "bad.xml", "<r><x><a>1</a></x><y><a>2</b></y><x><a>3</a></x><y><a>4</a>")
    feeds, _ = feed_paths(spark, str(tmp_path))
    found = scan_folder(spark, str(tmp_path), feeds, repair=False)
    assert [r["a"] for r in found.groups[0].read(["bad.xml"]).orderBy("_ord").collect()] == ["1", "3", "4"]
    assert ["<a>2</b>" in r["record"] for r in found.rejects[0].collect()] == [True]


def zipped(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return buffer.getvalue()


def workbook():
    return zipped(**{
        "xl/workbook__xml": "<workbook/>",
        "xl/sharedStrings__xml": "<sst><si><t>sku</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>Stuhl</t></si></sst>",
        "xl/worksheets/sheet1__xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>'
        '<c r="C1" t="inlineStr"><is><t>price</t></is></c></row><row r="2"><c r="A2"><v>007</v></c><c r="C2"><v>1.5</v></c></row>'
        '<row r="3"><c r="A3"><v>8</v></c><c r="B3" t="s"><v>2</v></c></row></sheetData></worksheet>',
    })


def test_archives_and_workbooks(spark, tmp_path):
    write(tmp_path, "csv_in.zip", zipped(readme__txt="x", a__csv="sku;v\n1;ä\n2;\n", b__csv="never;read\n"))
    write(tmp_path, "xml_in.zip", zipped(f__xml=RSS.replace("CTRL", "\x01")))
    write(tmp_path, "xlsx_in.zip", zipped(b__xlsx=workbook()))
    write(tmp_path, "book.xlsx", workbook())
    got = rows(spark, tmp_path)
    assert got["csv_in.zip"] == [{"sku": "1", "v": "ä"}, {"sku": "2", "v": ""}]
    assert [r["id"] for r in got["xml_in.zip"]] == ["1", "2", "3", "4"] and got["xml_in.zip"][0]["tag"] == "b"
    sheet = [{"sku": "007", "name": "", "price": "1.5"}, {"sku": "8", "name": "Stuhl", "price": ""}]
    assert got["book.xlsx"] == got["xlsx_in.zip"] == sheet


def test_pairing_and_name_patterns(spark, tmp_path):
    for side, names in {"base": ["a.csv", "b one+1.CSV", "c.xml", "n.txt"], "new": ["a.csv", "b one+1.CSV", "d.zip"]}.items():
        for n in names:
            write(tmp_path / side, n, "x")
    one, two = (listing.list_feeds(spark, str(tmp_path / s)) for s in ("base", "new"))
    got = {r["_file"]: (r["status"], r["reason"]) for r in listing.pair_feeds(one, two).collect()}
    assert got == {"a.csv": ("paired", None), "b one+1.CSV": ("paired", None),
                   "c.xml": ("unpaired", "only in baseline"), "d.zip": ("unpaired", "only in comparison")}
    assert set(feed_paths(spark, str(tmp_path / "base"), "*.csv")[0]) == {"a.csv"}
    assert set(feed_paths(spark, str(tmp_path / "base"), "[an].*")[0]) == {"a.csv", "n.txt"}


def test_folders_end_to_end(spark, tmp_path):
    b, c = tmp_path / "base", tmp_path / "new"
    for side, price in ((b, "1"), (c, "1.0")):
        write(side, "one.csv", f"sku,title,price\n1,a,{price}\n2,b,{price}\n2,dup,9\n")
        write(side, "two.csv", f"sku;title;price\n7;a;{price}\n")
    write(c, "two.csv", "sku|title|price\n007|A|1\n8|x|1\n")
    write(b, "f.xml", "<r><item><id>1</id><t>x</t></item></r>")
    write(c, "f.xml", "<r><item><id>1</id><t></t></item></r>")
    write(b, "z.zip", zipped(a__csv="sku,v\n1,2\n"))
    write(c, "z.zip", zipped(a__txt="nothing"))
    write(b, "nokey.csv", "foo,barbaz\n1,2\n")
    write(c, "nokey.csv", "foo,barbaz\n1,2\n")
    write(b, "left.csv", "sku\n1\n")
    r = compare_folders(spark, str(b), str(c))
    s = {x["_file"]: x for x in r.pair_summary.collect()}
    assert {f: x["status"] for f, x in s.items()} == {
        "one.csv": "success", "two.csv": "success", "f.xml": "success", "z.zip": "error", "nokey.csv": "skipped", "left.csv": "unpaired"}
    assert (s["one.csv"]["common"], s["one.csv"]["total_differences"], s["one.csv"]["avg_match_rate"]) == (2, 0, 100.0)
    assert (s["two.csv"]["common"], s["two.csv"]["only_2"], s["two.csv"]["total_differences"]) == (1, 1, 1)
    diffs = {tuple(x) for x in r.diff_cells.collect()}
    assert diffs == {("two.csv", "7", "title", "a", "A"), ("f.xml", "1", "t", "x", "")}
    run = r.run_summary.collect()[0]
    assert (run["total_pairs"], run["success"], run["skipped"], run["failed"]) == (5, 3, 1, 1)
    categories = {x["category"] for x in r.run_log.collect()}
    assert {"SKIP", "ERROR", "WARN", "MATCH", "MISS"} <= categories
    stats = r.column_stats.collect()
    assert sorted(map(tuple, r.materialize().column_stats.collect())) == sorted(map(tuple, stats))
    assert {tuple(x) for x in r.diff_cells.collect()} == diffs


def test_pairs_by_stem(spark, tmp_path):
    write(tmp_path / "b", "shop.csv", "sku,v\n1,x\n")
    write(tmp_path / "c", "shop.xml", "<r><item><sku>1</sku><v>y</v></item></r>")
    r = compare_folders(spark, str(tmp_path / "b"), str(tmp_path / "c"), pair_by_stem=True)
    assert [tuple(x) for x in r.diff_cells.collect()] == [("shop", "1", "v", "x", "y")]


def test_parts_are_read_by_their_own_header(spark, tmp_path):
    write(tmp_path, "f.csv/part-0.csv", "sku,price\n1,5\n")
    write(tmp_path, "f.csv/part-1.csv", "price,sku\n6,2\n")
    write(tmp_path, "f.csv/part-2.csv", "")
    assert rows(spark, tmp_path)["f.csv"] == [{"sku": "1", "price": "5"}, {"sku": "2", "price": "6"}]
    write(tmp_path, "g.csv/part-0.csv", "sku,price\n1,5\n")
    write(tmp_path, "g.csv/part-1.csv", "sku,title\n1,5\n")
    with pytest.raises(ValueError, match="different columns"):
        scan(spark, str(tmp_path))


def test_empty_feeds_and_stem_clashes_are_errors(spark, tmp_path):
    for side in ("b", "c"):
        write(tmp_path / side, "ok.csv", "sku,v\n1,x\n")
        write(tmp_path / side, "shop.csv", "sku,v\n1,x\n")
        write(tmp_path / side, "e.csv", "sku,v\n1,x\n" if side == "c" else "")
    write(tmp_path / "b", "shop.xml", "<r><item><sku>2</sku></item></r>")
    r = compare_folders(spark, str(tmp_path / "b"), str(tmp_path / "c"), pair_by_stem=True)
    got = {x["_file"]: (x["status"], x["reason"]) for x in r.pair_summary.collect()}
    assert got == {"ok": ("success", None), "e": ("error", "empty file"),
                   "shop": ("error", "several feeds of this name: shop.csv, shop.xml")}
    run = r.run_summary.collect()[0]
    assert (run["total_pairs"], run["success"], run["failed"]) == (3, 1, 2)


def test_rejects_are_reported(spark, tmp_path):
    bad = "<r><item><sku>1</sku></item><item><sku>2</b></item></r>"
    write(tmp_path / "b", "f.xml", bad)
    write(tmp_path / "c", "f.xml", bad.replace("</b>", "</sku>"))
    r = compare_folders(spark, str(tmp_path / "b"), str(tmp_path / "c"), repair=False)
    s = r.pair_summary.collect()[0]
    assert (s["status"], s["rows_1"], s["rows_2"], s["rejects_1"], s["rejects_2"]) == ("success", 1, 2, 1, 0)
    assert ("WARN", "records that do not parse: 1 | 0") in {(x["category"], x["message"]) for x in r.run_log.collect()}
    write_report(r, str(tmp_path / "report"), fmt="parquet")
    assert [tuple(x) for x in spark.read.parquet(str(tmp_path / "report/Rejects")).select("_file", "side", "record").collect()] == [
        ("f.xml", 1, "<item><sku>2</b></item>")]
    frames, rejects = scan(spark, str(tmp_path / "b"), with_rejects=True, repair=False)
    assert frames[0].count() == 1 and rejects[0].count() == 1


def test_inch_marks_leave_a_file_splittable(spark, tmp_path):
    write(tmp_path, "i.csv", "sku,title\n" + "".join(f'{i},27" monitor\n' for i in range(5000)))
    small = working_session(spark, **{"spark.sql.files.maxPartitionBytes": "10000", "spark.sql.files.openCostInBytes": "0"})
    (df,) = scan(small, str(tmp_path))
    assert df.rdd.getNumPartitions() > 3
    assert df.filter("title = '27\" monitor'").count() == 5000


@pytest.mark.parametrize("line, opened", [
    ('1,27" x', False), ('1,"a"', False), ('1,"a', True), ('1,"a ""b"" c"', False), ('1,"""a""",2', False), ('1,"""a', True),
    ('"a,b",c', False), ('"a', True), ('1,""', False), ('b"', False), ('5" x 7",b', False), ('1,"a";"b', True)])
def test_which_quotes_open_a_value(spark, line, opened):
    df = spark.createDataFrame([(line,)], "v string")
    assert df.select(csvfeeds.opens_value(df.v, csvfeeds.DELIMITERS)).first()[0] is opened


def test_packed_names_order_and_errors(spark, tmp_path):
    many = "sku,v\n" + "".join(f"{i},{i}\n" for i in range(12000))
    write(tmp_path, "a b+50%=x.zip", zipped(a__csv=many))
    write(tmp_path, "root.zip", zipped(a__xml="<shop><!-- <x> --><thing><n>1</n></thing><thing><n>2</n></thing></shop>"))
    got = rows(spark, tmp_path)
    assert [r["v"] for r in got["a b+50%=x.zip"]] == [str(i) for i in range(12000)]
    assert got["root.zip"] == [{"n": "1"}, {"n": "2"}]
    write(tmp_path, "broken.zip", b"no archive")
    feeds, _ = feed_paths(spark, str(tmp_path))
    found = scan_folder(spark, str(tmp_path), feeds)
    assert list(found.errors) == ["broken.zip"] and "BadZipFile" in found.errors["broken.zip"]


def test_archives_of_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    write(tmp_path, "a b%+.zip", zipped(readme__txt="x", a__csv="sku;v\n1;ä\n"))
    expected = {"a b%+.zip": [{"sku": "1", "v": "ä"}]}
    assert rows(spark, tmp_path) == expected
    assert packed.opened("viewfs://store/x") is None
    monkeypatch.setattr(packed, "opened", lambda path: None)
    assert rows(spark, tmp_path) == expected


def test_scratch_is_shared_unless_local():
    fake = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            scratch_folder(fake(master), "x")
    assert "/x-" in scratch_folder(fake("local[8]"), "x")
