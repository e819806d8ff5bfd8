"""Cell-level expressions: emptiness, tolerant equality, rates and bands.

Cells are strings by the time they reach these functions (see ``as_text``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as Python's ``str.strip`` sees it, as characters and as a regular expression class.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_DIGITS = r"\d+(_\d+)*"
_FLOAT = rf"({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?"
# Text that counts as a number. Checked before the cast because the cast alone also takes
# type suffixes and hexadecimal floats ("10D", "0x1p3") and treats NaN as equal to itself.
_PADDING = SPACE.replace(r"\x1c-\x1f", "") + "*"
NUMBER = rf"^{_PADDING}[+-]?({_FLOAT}|(?i:inf(inity)?)){_PADDING}\z"

# What a cell pair turned out to be.
SAME, BOTH_EMPTY, ONLY_1_EMPTY, ONLY_2_EMPTY, DIFFERENT = range(5)
FIRST_MISMATCH = ONLY_1_EMPTY


def name(column: str) -> Column:
    """Refer to a column by its exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def strip(v: Column) -> Column:
    return F.btrim(v, F.lit(SPACES))


def as_text(column: str, dtype: str) -> Column:
    """A cell as text; a float NaN is an empty cell."""
    v = name(column)
    if dtype in ("float", "double"):
        v = F.when(~F.isnan(v), v)
    return v if dtype == "string" else v.cast("string")


def is_empty(v: Column) -> Column:
    """Null or ''. White space is a value."""
    return v.isNull() | (v == "")


def to_number(v: Column) -> Column:
    return F.replace(strip(v), F.lit("_"), F.lit("")).try_cast("double")


def same_number(a: Column, b: Column) -> Column:
    return a.rlike(NUMBER) & b.rlike(NUMBER) & (to_number(a) == to_number(b))


def values_equal(a: Column, b: Column) -> Column:
    """Both empty, the same text, or the same number."""
    return F.coalesce((is_empty(a) & is_empty(b)) | (a == b) | same_number(a, b), F.lit(False))


def cell_code(a: Column, b: Column) -> Column:
    """Outcome of one cell pair; the cheap and frequent case is tested first."""
    return (
        F.when((a == b) & (a != ""), SAME)
        .when(is_empty(a) & is_empty(b), BOTH_EMPTY)
        .when(is_empty(a), ONLY_1_EMPTY)
        .when(is_empty(b), ONLY_2_EMPTY)
        .when(same_number(a, b), SAME)
        .otherwise(DIFFERENT)
    )


def raw_rate(matches: Column, total: Column) -> Column:
    """Percentage of matches, 0 when nothing was compared."""
    return F.when(total > 0, F.lit(100.0) * matches / total).otherwise(F.lit(0.0))


def match_rate(matches: Column, total: Column) -> Column:
    return F.bround(raw_rate(matches, total), 2)


def status_band(matches: Column, total: Column) -> Column:
    """PERFECT only when every cell matched; the other bands use the unrounded rate."""
    rate = raw_rate(matches, total)
    return (
        F.when((total > 0) & (matches == total), "PERFECT")
        .when(rate >= 95, "GOOD")
        .when(rate >= 80, "FAIR")
        .when(rate >= 50, "POOR")
        .otherwise("BAD")
    )
