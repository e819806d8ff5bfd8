"""Documents cut at any places are read as if they were whole: XML chunks, CSV splits, and repaired records."""

import csv
import io
import json
import random
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest

from rowtally.session import working_session
from rowtally.sources import csvfeeds, xmlfeeds, xmlscan
from rowtally.sources.scan import feed_paths, scan, scan_folder
from rowtally.sources.xmlrepair import repaired

DOCUMENT = """<?xml version="1.0"?><!-- a > b --><!DOCTYPE shop [<!ELEMENT x ANY>]><shop a="x>y"><!-- <item> > --><item k='1>2'><a>1</a>
<![CDATA[<item> ]] > </item>]]></item><item/><g:item b = "q>r>"><b>2 > 1</b></g:item ><item><a>3<item><a>4</a></item><?pi <item> ?><meta><item x="1"/>
</meta></wrong><b>5 < 6</b><item><c d="=">7</c></item></shop>"""


def cut_at(document: str, cuts: list[int], tag):
    """Records and names of a document whose chunks start behind the given tag ends."""
    pieces, at, chunks = document.split(">"), 0, []
    for i, j in zip([0, *cuts], [*cuts, len(pieces)]):
        text = ">".join(pieces[i:j]) + ">"
        chunks.append((at, text))
        at += len(text)
    maps = [json.dumps(xmlscan.chunk_map(t, {"item", "shop"})) for _, t in chunks]
    starts = xmlscan._starts((pa.scalar("d"),), pa.table({"block": [o for o, _ in chunks], "maps": maps})).to_pylist()
    found: dict = {}
    for (block, text), start in zip(chunks, starts):
        for at_block, at, name, part, _, holds in xmlscan.cut_records(text, block, start["start"], tag):
            record = found.setdefault((at_block + at, name), ["", False])
            record[0] += part
            record[1] |= holds
    return sorted((k, text) for k, (text, holds) in found.items() if not holds), {n for s in starts for n in s["names"]}


@pytest.mark.parametrize("tag, records", [("item", 7), (None, 4)])
def test_xml_chunks_compose(tag, records):
    whole = cut_at(DOCUMENT, [], tag)
    assert len(whole[0]) == records and whole[1] == {"item"}
    rng, n = random.Random(4), len(DOCUMENT.split(">"))
    for _ in range(1500):
        cuts = sorted(rng.sample(range(1, n), rng.randint(1, n - 1)))
        assert cut_at(DOCUMENT, cuts, tag) == whole, cuts
    assert cut_at(DOCUMENT, list(range(1, n)), tag) == whole


def test_one_document_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xmlscan, "SPLIT_BYTES", 2000)
    records = "".join(f'<product n="{i}>"><sku>{i}</sku><!-- <item> --><t><![CDATA[<item>{"x" * (i % 90)}</item>]]></t><d><w>{i}</w></d></product>\n' for i in range(400))
    (tmp_path / "big.xml").write_text(f"<shop><item_list/>{records}</shop>")
    assert xmlscan._chunks(spark, [str(tmp_path / "big.xml")]).rdd.getNumPartitions() > 10
    (rows,) = scan(spark, str(tmp_path))
    got = [(r["@n"], r["sku"], r["t"], r["d_w"]) for r in rows.orderBy("_ord").collect()]
    assert got == [(f"{i}>", str(i), f"<item>{'x' * (i % 90)}</item>", str(i)) for i in range(400)]


def test_missing_end_tags_stay_in_their_record(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<r><item><a>1</a><item><a>2</item><item><a>3</b><c>x</a></item><item><a>4</a></item></r>")
    (rows,), faulty = scan(spark, str(tmp_path), with_rejects=True)
    assert [r["a"] for r in rows.orderBy("_ord").collect()] == ["1", "2", "3", "4"]
    assert sorted((r["record"], r["repaired"]) for r in faulty[0].collect()) == [("<item><a>2</item>", True), ("<item><a>3</b><c>x</a></item>", True)]
    found = scan_folder(spark, str(tmp_path), feed_paths(spark, str(tmp_path))[0], repair=False)
    assert [r["a"] for r in found.groups[0].read(["f.xml"]).orderBy("_ord").collect()] == ["1", "4"]


@pytest.mark.parametrize("broken, fixed", [
    ("<a><b>1</a>", "<a><b>1</b></a>"), ("<a><b>1</c></b></a>", "<a><b>1</b></a>"), ("<r><a>3</b><c>x</a></r>", "<r><a>3</a><c>x</c></r>"), ("<a>x & y &lt; < 3</a>", "<a>x &amp; y &lt; &lt; 3</a>"),
    ("<a k=v k='2' z=\"1&2\"><b/>", '<a k="v" z="1&amp;2"><b/></a>'), ("<a><!-- x --><![CDATA[<q>]]></a>", "<a><![CDATA[<q>]]></a>"), ("<a><![CDATA[x", "<a><![CDATA[x]]></a>"),
    ("<a><b", "<a>&lt;b</a>"), ("", ""), ("plain", "plain")])
def test_repair(broken, fixed):
    assert repaired(broken) == fixed
    if fixed.startswith("<"):
        ET.fromstring(fixed)


def test_csv_values_over_line_ends_in_many_splits(spark, tmp_path):
    rng = random.Random(2)
    value = lambda: rng.choice(["plain", 'inch 5" x', "two\nlines", 'a "quoted" one,\n\nwith, commas', "", "end\r\nof line", "x" * 300, "\n", '"', ' "spaced'])
    table = [[str(i), value(), value()] for i in range(600)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["sku", "long\ntitle", "last"], *table])
    (tmp_path / "f.csv").write_bytes(out.getvalue().encode())
    small = working_session(spark, **{"spark.sql.files.maxPartitionBytes": "1500"})
    for session in (small, spark):
        (rows,) = scan(session, str(tmp_path))
        assert rows.columns == ["_file", "_ord", "sku", "long\ntitle", "last"]
        assert [[c or "" for c in r[2:]] for r in rows.orderBy("_ord").collect()] == table


def test_delimiter_from_the_whole_text(spark, tmp_path):
    early = "".join(f"{i},name;{i}\n" for i in range(900))  # over 8 KB in which both occur alike
    late = "".join(f"{i},name\n" for i in range(30_000))
    (tmp_path / "late.csv").write_text("sku,title;x\n" + early + late)
    (rows,) = scan(spark, str(tmp_path))
    assert rows.columns[2:] == ["sku", "title;x"] and rows.count() == 30_900
    ragged = "sku;a;b\n" + "1;2;3\n" * 95 + "1;2\n" * 5
    (tmp_path / "late.csv").write_text(ragged)
    (rows,) = scan(spark, str(tmp_path))
    assert rows.columns[2:] == ["sku", "a", "b"]


def test_header_of_a_value_that_is_never_closed(spark, tmp_path):
    (tmp_path / "f.csv").write_text('sku,"title\n1,a\n2,b\n')
    assert csvfeeds.heads(spark, [str(tmp_path / "f.csv")]).first()["header"] == b'sku,"title'


def test_xml_chunks_are_bounded(spark, tmp_path, monkeypatch):
    folder = tmp_path / "feeds"
    folder.mkdir()
    items = "".join(f"<item><sku>{i}</sku><!-- <item> --><title>t > {i}</title></item>" for i in range(5000))
    (folder / "big.xml").write_text(f"<shop>{items}</shop>")
    monkeypatch.setattr(xmlscan, "CHUNK_CHARACTERS", 3000)
    chunks = xmlscan.chunk_texts(spark, [str(folder / "big.xml")], ["item"])
    sizes = chunks.selectExpr("block", "length(text) AS n").collect()
    assert len({r["block"] for r in sizes}) == len(sizes) > 50 and max(r["n"] for r in sizes) < 3200
    (rows,) = scan(spark, str(folder))
    got = {r["sku"]: r["title"] for r in rows.orderBy("_ord").collect()}
    assert list(got.items()) == [(str(i), f"t > {i}") for i in range(5000)]


def test_small_files_share_a_task(spark, tmp_path):
    folder = tmp_path / "feeds"
    folder.mkdir()
    for i in range(120):
        (folder / f"s {i}+.csv").write_text(f'sku,"long\ntitle {i}"\n1,a\n2,b\n' if i % 3 else "sku;title\n1;x\n")
    (folder / "empty.csv").write_text("")
    (folder / "large.csv").write_text('sku,title\n' + "1,x\n" * 100_000)
    paths = [p for ps in feed_paths(spark, str(folder))[0].values() for p in ps]
    found = csvfeeds.heads(spark, paths)
    assert found.rdd.getNumPartitions() < 40
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["header"]).decode() for r in found.collect()}
    want = {f"s {i}+.csv": f'sku,"long\ntitle {i}"' if i % 3 else "sku;title" for i in range(120)} | {"large.csv": "sku,title"}
    assert got == want


def test_many_documents_land_together(spark, tmp_path):
    folder = tmp_path / "feeds"
    folder.mkdir()
    for i in range(30):
        end = "</wrong>" if i == 7 else "</title>"
        (folder / f"d &{i}+|.xml").write_text(f"<shop><item><sku>{i}</sku><title>a{end}</item><item><sku>x</sku><title>b</title></item></shop>")
    landed = xmlfeeds.land_records(working_session(spark), str(folder), feed_paths(spark, str(folder))[0])
    assert len(landed) == 1 and len(feed_paths(spark, landed[0], "*")[0]) < 30
    (rows,), (rejects,) = scan(spark, str(folder), with_rejects=True, repair=False)
    assert sorted((r["_file"], r["sku"]) for r in rows.collect()) == sorted([(f"d &{i}+|.xml", s) for i in range(30) for s in (str(i), "x") if (i, s) != (7, "7")])
    assert [r["_file"] for r in rejects.collect()] == ["d &7+|.xml"]
