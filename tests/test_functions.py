"""Scalar definitions as tables."""

import pytest
from pyspark.sql import functions as F

from rowtally.functions import names as nm
from rowtally.functions.keys import _fold_one, _fold_series, normalize_key, with_key
from rowtally.functions.values import cell_code, match_rate, status_band, values_equal

KEYS = [
    ("007", "7"), ("1.0", "1"), ("10.", "10"), ("1.50", "1.50"), (".00", "0"), ("12-34", "12-34"), ("12 34", "12 34"),
    ("1.2.3", "1.2.3"), ("1.", "1."), ("-5", "-5"), ("-05", "-5"), ("-00", "0"), ("-0.0", "0"), ("  a\tb  c ", "ab c"),
    ("0", "0"), ("00", "0"), ("\n x\r\n", "x"), ("a\x1cb", "a b"), ("\x1f7 ", "7"), ("+5", "+5"), ("5e3", "5e3"), ("1_0", "1_0"),
    ("123456789012345678901234567890.0", "123456789012345678901234567890"), ("--5", "--5"), ("0x10", "0x10"), ("abc\n", "abc"),
    ("A-1", "A-1"), ("- 5", "- 5"), ("5.00.0", "5.00.0"), ("01.50", "01.50"), (" 00012 ", "12"),
    # beyond ASCII
    ("ＡＢ１２", "AB12"), ("０07", "7"), ("a b", "a b"), (" x ", "x"), ("a–b—c", "a-b-c"), ("–05", "-5"),
    ("①②", "12"), ("²", "2"), ("٣٤", "34"), ("٣", "٣"), ("A٣", "A٣"), ("٣-٤", "٣-٤"), ("٣.٥٠", "٣.٥٠"), ("-٠٣٫", "-٠٣٫"), ("٠٣.٠", "3"), ("ﬁn", "fin"), ("x　 y", "x y"), ("é", "é"),
    ("é", "é"), ("abc\u0085", "abc"), ("12 ", "12"),
]
BLANK = [None, "", " ", "\t\n", " ", "　 ", "\x1c"]


def keys_of(spark, raws, **options):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return {r["i"]: r["key"] for r in with_key(df, "raw", "key", **options).collect()}


def test_key_normalisation(spark):
    got = keys_of(spark, [r for r, _ in KEYS])
    assert [(r, got[i]) for i, (r, _) in enumerate(KEYS)] == KEYS
    assert keys_of(spark, BLANK) == {}
    assert set(keys_of(spark, BLANK, keep_blank=True).values()) == {""}
    df = spark.createDataFrame([(r,) for r, _ in KEYS], "raw string")
    assert [r[0] for r in df.select(normalize_key(F.col("raw"))).collect()] == [k for _, k in KEYS]


def test_key_options(spark):
    assert keys_of(spark, [" 007 ", "AbÉ", " x"], normalize=False) == {0: "007", 1: "AbÉ", 2: "x"}
    assert keys_of(spark, ["AbÉ", "SKU-1"], case_sensitive=False) == {0: "abé", 1: "sku-1"}
    assert keys_of(spark, BLANK, normalize=False) == {}
    assert set(keys_of(spark, BLANK, normalize=False, keep_blank=True).values()) == {""}


def _float_equal(a, b):
    try:
        return float(a) == float(b)
    except (TypeError, ValueError):
        return False


VALUES = ["5", "5.0", "007", "7", "1e3", "1000", "inf", "Infinity", "-INF", "10D", "10", "10f", "nan", "NaN", " ", "", None, "1_000",
          "_1", "1__0", "1_", "0x1p3", "8", ".5", "0.5", "5.", "+5", "-0", "0", " 7 ", "\t7\n", "1e400", "abc", "ABC", "1,5", ".", "e5", "5e", "\x1c5", "1_0.5", "10.5"]


def test_values_equal_like_python_floats(spark):
    pairs = [(a, b) for a in VALUES for b in VALUES]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    empty = lambda v: v is None or v == ""
    for r in df.select("a", "b", values_equal(F.col("a"), F.col("b")).alias("eq"), cell_code(F.col("a"), F.col("b")).alias("code")).collect():
        a, b = r["a"], r["b"]
        both = empty(a) and empty(b)
        assert r["eq"] == (both or a == b or _float_equal(a, b)), (a, b)
        if both:
            assert r["code"] == 1
        elif empty(a) or empty(b):
            assert r["code"] == (2 if empty(a) else 3)
        else:
            assert r["code"] == (0 if a == b or _float_equal(a, b) else 4), (a, b)


@pytest.mark.parametrize("matches,total,rate,status", [
    (0, 0, 0.0, "BAD"), (5, 5, 100.0, "PERFECT"), (99999, 100000, 100.0, "GOOD"), (95, 100, 95.0, "GOOD"), (94999, 100000, 95.0, "FAIR"),
    (80, 100, 80.0, "FAIR"), (1, 2, 50.0, "POOR"), (49, 100, 49.0, "BAD"), (1, 800, 0.12, "BAD"), (1, 3, 33.33, "BAD"),
])
def test_rates_and_bands(spark, matches, total, rate, status):
    r = spark.range(1).select(match_rate(F.lit(matches), F.lit(total)).alias("r"), status_band(F.lit(matches), F.lit(total)).alias("s")).first()
    assert (r["r"], r["s"]) == (rate, status)


def column(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "c string").coalesce(1)
    return [r[0] for r in df.select(make(F.col("c"))).collect()]


def test_tags_and_sites(spark):
    tags = ["g:id", "a:b:c", "long:id", "{http://x}id", "plain"]
    assert column(spark, tags, nm.clean_tag) == ["id", "c", "long:id", "id", "plain"]
    sites = ["shop.DE", "Shop FR x", "a.DEU", "x", "", "lower.de AT"]
    assert column(spark, sites, nm.country_code) == ["DE", "FR", "A.", "X", "", "AT"]


def test_column_name_normalisation(spark):
    raw = ["g:id", "a:b:c", "long:id", " SKU  Code ", '"EAN"', "'x'", "_a--b_", "Größe", "###", "c:price", " a b"]
    expected = ["id", "c", "longid", "sku_code", "ean", "x", "a_b", "gre", "", "price", "a_b"]
    assert column(spark, raw, nm.normalize_column_name) == expected


SCORES = {
    "sku": 1.0, "g:id": 0.95, "EAN": 0.9, "Product Number": 0.85, "my_sku_field": 0.8, "category_id": 0.0, "unnamed_0": 0.0, "index": 0.0,
    "model no": 0.7, "ean-code": 0.9, "###": 0.0, "colour": 0.0,
    "eann": (1 - 1 / 4 - 0.2) * 0.7 + 0.2, "ids": (1 - 1 / 3 - 3 / 20) * 0.7 + 0.05, "at_skuu": 0.8, "xgtin": 0.55 + 10 * 0.003,
}


def test_column_scores(spark):
    from rowtally.operators.detect import detect_pair_keys, score_columns

    df = spark.createDataFrame([("f", 1, i, c) for i, c in enumerate(SCORES)], "_file string, side int, pos int, column string")
    got = {r["column"]: r["score"] for r in score_columns(df).collect()}
    for c, want in SCORES.items():
        if c == "ids" and want < 0.4:
            want = 0.0
        assert got[c] == pytest.approx(want, abs=1e-12), c
    assert detect_pair_keys(spark, ["name", "ean", "sku"], ["colour", "Item ID"]) == ("sku", "Item ID")
    assert detect_pair_keys(spark, ["mpn", "ean"], ["upc"]) == ("mpn", "upc")  # same score and length: first in the file
    assert detect_pair_keys(spark, ["name"], ["sku"]) == (None, "sku")
    assert detect_pair_keys(spark, ["mpn", "Artikel"], ["mpn", "artikel"], user="artikel") == ("Artikel", "artikel")
    assert detect_pair_keys(spark, ["sku", "x"], ["id", "x"], priority=["", "x"]) == ("sku", "id")  # 0.93 for x
    assert detect_pair_keys(spark, ["mpn", "x"], ["upc", "X"], priority=["x"]) == ("x", "X")


def test_a_computed_key_is_worked_out_once_a_branch(spark):
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit("marker-"), F.col("id").cast("string"))).otherwise(F.lit("é"))
    df = spark.range(10).select(raw.alias("raw"), F.sha2(F.col("id").cast("string"), 256).alias("cell"))
    keyed = with_key(df, "raw", "key")
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("marker-") == 2
    cells = with_key(df, "raw", "key", carries_cells=True)
    for found in (keyed, cells):
        assert found.columns == ["raw", "cell", "key"]
        assert sorted(r["key"] for r in found.collect()) == sorted([f"marker-{i}" for i in range(0, 10, 2)] + ["é"] * 5)


def test_keys_folded_together_are_as_folded_alone():
    import pandas as pd

    texts = [r for r, _ in KEYS if r] + ["\u0301e", "e\u0301", "\u1100", "\u1161", None, "٣٤", "A\u2014٣"]
    for more in ([], ["a\0b", "\0٣"]):  # the second holds the character that parts them
        keys = pd.Series(texts + more, index=range(5, 5 + len(texts + more)))
        assert [f if isinstance(f, str) else None for f in _fold_series(keys)] == [k and _fold_one(k) for k in texts + more]
    assert _fold_series(pd.Series([None], dtype=object)).isna().all()
    assert not len(_fold_series(pd.Series([], dtype=object)))


def test_ascii_keys_are_trimmed_once(frame):
    """Keys with any white space agree with the full normalisation, and the test for blank ones reads the trimmed key."""
    spaces = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "  "]
    raws = [None, "", *spaces, *[f"{a}00{b}1.0{a}" for a in spaces for b in ("", *spaces)], "A  b", "\x00", "\x7f 1", "\x1f \t "]
    df = frame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    wanted = {r.i: r.k for r in df.select("i", normalize_key(F.col("raw")).alias("k")).collect()}
    assert {r.i: r.k for r in with_key(df, "raw", "k", keep_blank=True).collect()} == wanted
    kept = with_key(df, "raw", "k")
    assert {r.i: r.k for r in kept.collect()} == {i: k for i, k in wanted.items() if k}
    filters = [line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line and "_t#" in line]
    assert len(filters) == 1 and not any("btrim" in line for line in filters)
