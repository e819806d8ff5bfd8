"""Key normalisation as column expressions.

Keys in plain ASCII, nearly all of them in practice, are normalised by built-in functions. Spark
has no function for Unicode compatibility folding, so the rest passes one pandas UDF first;
``with_key`` sends only those rows through it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rowtally.functions.values import SPACE, SPACES, name, strip

# Characters read as a blank or as a hyphen in keys.
BLANKS = "\u00a0\u2007\u202f"
DASHES = "\u2013\u2014\u2015"
_FOLD = {ord(c): " " for c in BLANKS} | {ord(c): "-" for c in DASHES}


def _fold_one(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).translate(_FOLD)
    # digits of other scripts count as digits in integral numbers, and only there
    ascii_digits = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in folded)
    number = "".join(" " if c.isspace() else c for c in ascii_digits if c not in "\t\n\r\f\v").strip()
    if re.fullmatch(r"-?([0-9]+(\.0*)?|\.0+)", number) and sum(c.isdigit() for c in number) > 1:
        return ascii_digits
    return folded


def _fold_series(keys: pd.Series) -> pd.Series:
    """All keys are folded as one text: nothing composes over U+0000. Only what is not ASCII then needs a second look."""
    given = keys.notna()
    texts = keys[given].tolist()
    whole = unicodedata.normalize("NFKC", "\0".join(texts))
    for c, plain in _FOLD.items():
        whole = whole.replace(chr(c), plain)
    folded = whole.split("\0") if texts else []
    if len(folded) != len(texts):  # some hold U+0000 themselves
        folded = [_fold_one(k) for k in texts]
    elif not whole.isascii():
        folded = [f if f.isascii() else _fold_one(k) for f, k in zip(folded, texts)]
    out = pd.Series(None, index=keys.index, dtype=object)
    out[given] = folded
    return out


def fold_unicode(v: Column) -> Column:
    """NFKC, special blanks and dashes, and foreign digits of all-digit keys."""
    return F.pandas_udf(_fold_series, "string")(v)


def is_ascii(v: Column) -> Column:
    return F.length(v) == F.octet_length(v)


NOT_ASCII = r"[^\x00-\x7f]"
_ASCII_SPACES = "".join(c for c in SPACES if c < "\x7f")
# Line ends and tabs inside a key are deleted, information separators read as blanks.
_INNER = "\x1c\x1d\x1e\x1f" + "\t\n\r\f\v"
_CONTROLS = r"[\t\n\x0b\f\r\x1c-\x1f]"


def _spaced_folded(v: Column) -> Column:
    return F.regexp_replace(F.translate(v, "\t\n\r\f\v", ""), f"{SPACE}+", " ")


def _plain_number(n: Column) -> Column:
    """Write integral numbers of more than one digit without leading zeros, ``.0`` and negative zero."""
    integral = n.rlike(r"^ ?-?(\d+(\.0*)?|\.0+) ?\z") & (F.length(F.translate(n, ".- ", "")) > 1)
    plain = F.regexp_replace(F.regexp_replace(F.trim(n), r"\.0*$", ""), r"^(-?)0+(?=\d)", "$1")
    plain = F.when(plain.isin("", "-", "-0"), "0").otherwise(plain)
    return F.when(integral, plain).otherwise(n)


def _spaced(v: Column) -> Column:
    """An ASCII key without blanks around it and white space other than blanks inside. Few keys hold any, and these take most time."""
    inner = F.translate(F.btrim(v, F.lit(_ASCII_SPACES)), _INNER, "    ")
    return F.when(v.rlike(_CONTROLS), inner).otherwise(F.trim(v))


def normalize_key(v: Column) -> Column:
    """The full normalisation of any key. The UDF runs for every row; for tables use ``with_key``."""
    return F.coalesce(_plain_number(_spaced_folded(fold_unicode(strip(v)))), F.lit(""))


def with_key(
    df: DataFrame,
    raw: str,
    key: str,
    normalize: bool = True,
    case_sensitive: bool = True,
    ascii_only: bool = False,
    keep_blank: bool = False,
    carries_cells: bool = False,
) -> DataFrame:
    """Add the comparison key ``key`` derived from the text column ``raw``.

    Rows are split by a cheap test on ``raw``: ASCII keys stay in generated code, the others go
    through Arrow. No shuffle and no join is involved. ``ascii_only`` states that every key is known
    to be ASCII (true of any key column that is not text) and leaves the second branch out. Rows
    without a key are dropped, or keep the key '' with ``keep_blank``. With ``carries_cells`` the second
    branch tests the key before the other columns are made, as these cost more than its expression.
    """
    fold_case = (lambda c: c) if case_sensitive else F.lower
    r, bare = F.col(raw), strip(F.col(raw))
    if not normalize:
        rows = df if keep_blank else df.filter(bare != "")
        return rows.withColumn(key, F.coalesce(fold_case(bare), F.lit("")))
    # a key is empty just when its raw form is blank, so blank rows go before keys are computed
    with_raw = lambda rows: rows if keep_blank else rows.filter(bare != "")
    if ascii_only:
        plain = with_raw(df).withColumn("_t", _spaced(r))
    else:
        # out of a generator, so that the filters stay above it: pushed below, each would work out anew whatever expression
        # the caller's key is made of, several times a row
        rest = [name(c) for c in df.columns if c != raw]
        ascii_key = F.coalesce(is_ascii(r), F.lit(True))
        once = F.inline(F.array(F.struct(r.alias(raw), ascii_key.alias("_plain"), F.when(ascii_key, _spaced(r)).alias("_t"))))
        split = df.select(*rest, once)
        # an ASCII key is blank just when nothing is left of it here
        plain = split.filter("_plain" if keep_blank else "_plain AND _t <> ''").select(*map(name, df.columns), "_t")
        others = with_raw(df.filter(r.rlike(NOT_ASCII)) if carries_cells else split.filter("NOT _plain")).select(*map(name, df.columns))

    def keyed(part: DataFrame) -> DataFrame:
        return part.withColumn(key, F.coalesce(fold_case(_plain_number(F.col("_n"))), F.lit(""))).drop("_t", "_n")

    # steps used more than once are columns of their own, so that each is computed once
    one_blank = F.when(F.contains("_t", F.lit("  ")), F.regexp_replace("_t", " {2,}", " ")).otherwise(F.col("_t"))
    plain = keyed(plain.withColumn("_n", one_blank))
    if ascii_only:
        return plain
    folded = others.withColumn("_n", _spaced_folded(fold_unicode(bare)))
    return plain.unionByName(keyed(folded))
