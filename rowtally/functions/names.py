"""Expressions on column and site names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from rowtally.functions.values import SPACE, strip

# Words a key column is likely to be called, best first.
TARGET_KEYWORDS = ["ean", "at_sku", "sku", "id"]

# Words that make a name a key candidate when they occur inside it.
CONTAINED_KEYWORDS = ["sku", "ean", "gtin", "upc", "mpn", "offerid", "productid", "itemid"]

# Fixed values: (pattern on the normalised name, score, label); the first that fits decides.
KEY_PATTERNS = [
    (r"^sku$", 1.0, "SKU"),
    (r"^id$", 0.95, "ID"),
    (r"^ean$", 0.9, "EAN"),
    (r"^gtin$", 0.9, "GTIN"),
    (r"^upc$", 0.9, "UPC"),
    (r"^mpn$", 0.9, "MPN"),
    (r"^offerid$", 0.95, "OfferID"),
    (r"^productid$", 0.95, "ProductID"),
    (r"^itemid$", 0.9, "ItemID"),
    (r"^articleid$", 0.9, "ArticleID"),
    (r"^sku[_\s]?(id|code|num|no|number)?$", 0.95, "SKU variant"),
    (r"^(product|item|article|offer)[_\s]?(sku|id|code)$", 0.9, "Product/Item ID"),
    (r"^(product|item|article|offer)[_\s]?(number|num|no)$", 0.85, "Product Number"),
    (r"^.*(sku|stock[_\s]?keeping[_\s]?unit).*$", 0.8, "Contains SKU"),
    (r"^ean[_\s]?(code|number|num|no)?$", 0.9, "EAN variant"),
    (r"^gtin[_\s]?(code|number|num|no)?$", 0.9, "GTIN variant"),
    (r"^upc[_\s]?(code|number|num|no)?$", 0.9, "UPC variant"),
    (r"^mpn[_\s]?(code|number|num|no)?$", 0.85, "MPN variant"),
    (r"^model[_\s]?(number|num|no|id|code)?$", 0.7, "Model Number"),
    (r"^part[_\s]?(number|num|no|id|code)?$", 0.7, "Part Number"),
]

# Names that end in "id" or look like an index but identify something else.
EXCLUDED_PATTERNS = [
    r"^category[_\s]?id$", r"^parent[_\s]?id$", r"^group[_\s]?id$",
    r"^manufacturer[_\s]?id$", r"^brand[_\s]?id$", r"^country[_\s]?id$",
    r"^tax[_\s]?id$", r"^currency[_\s]?id$", r"^language[_\s]?id$",
    r"^warehouse[_\s]?id$", r"^store[_\s]?id$", r"^shop[_\s]?id$",
    r"^row[_\s]?id$", r"^index$", r"^unnamed",
]

_SHORT_PREFIX = r"(?s)^[^:]{0,3}:(.*:)?"


def clean_tag(tag: Column) -> Column:
    """Drop an ``{uri}`` and a namespace prefix of at most three characters."""
    return F.regexp_replace(F.regexp_replace(tag, r"^[^}]*\}", ""), _SHORT_PREFIX, "")


def normalize_column_name(column: Column) -> Column:
    n = F.lower(strip(column))
    for pattern, by in [
        (r'^"+|"+$', ""),
        (r"^'+|'+$", ""),
        (_SHORT_PREFIX, ""),
        (rf"[{SPACE[1:-1]}\-_]+", "_"),
        (r"[^a-z0-9_]", ""),
        (r"^_+|_+$", ""),
    ]:
        n = F.regexp_replace(n, pattern, by)
    return n


def is_excluded_name(normalized: Column) -> Column:
    return normalized.rlike("|".join(EXCLUDED_PATTERNS))


def _verdict(score, label) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_column(score).cast("double").alias("score"), as_column(label).alias("label"))


def similarity_score(normalized: Column) -> Column:
    """``struct(score, rank, word)`` for the target word nearest by edit distance."""
    length = F.length(normalized)
    options = []
    for i, word in enumerate(TARGET_KEYWORDS):
        longest = F.greatest(length, F.lit(len(word)))
        similarity = 1 - F.levenshtein(normalized, F.lit(word)) / longest
        score = (similarity - F.least(length / 20, F.lit(0.3))) * 0.7
        score = F.greatest(F.lit(0.0), F.least(F.lit(0.7), score)) + (len(TARGET_KEYWORDS) - i) * 0.05
        options.append(F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(word).alias("word")))
    return F.array_max(F.array(*options))


def contained_score(normalized: Column) -> Column:
    """``struct(score, label)`` when a key word occurs inside the name, else null."""
    found = F.coalesce(*[F.when(normalized.contains(w), F.lit(w)) for w in CONTAINED_KEYWORDS])
    bonus = F.greatest(F.lit(0.0), (15 - F.length(normalized)) * 0.003)
    score = F.least(F.lit(0.55) + bonus, F.lit(0.65))
    return F.when(found.isNotNull(), _verdict(score, F.concat(F.lit('Contains "'), found, F.lit('"'))))


def _wanted(column: Column, n: Column, target: str, tops, label: str):
    t = F.lit(target)
    tests = [column == t, F.lower(column) == F.lower(t), n == normalize_column_name(t)]
    hows = ["exact", "case-insensitive", "normalized"]
    return [(test, _verdict(top, f"{label} ({how})")) for test, top, how in zip(tests, tops, hows)]


def column_score(
    column: Column, normalized: Column, near: Column, user: str | None = None, priority: list[str] | None = None
) -> Column:
    """How likely a column name is the product key: ``struct(score, label)``.

    A user-given name decides first, then the priority list, exclusions, patterns, edit distance
    to the target words and last a contained key word. ``normalized`` and ``near`` hold the results of
    ``normalize_column_name`` and ``similarity_score``; being columns, they are computed once.
    """
    tests = []
    if user:
        tests += _wanted(column, normalized, user, (1.0, 0.98, 0.96), "User specified")
    for i, listed in enumerate(priority or []):
        if listed.strip():
            tops = [max(top - i * 0.02, floor) for top, floor in ((0.95, 0.8), (0.93, 0.78), (0.91, 0.76))]
            tests += _wanted(column, normalized, listed.strip(), tops, f"Priority #{i + 1}")
    tests.append((is_excluded_name(normalized), _verdict(0.0, "Excluded")))
    tests += [(normalized.rlike(p), _verdict(w, label)) for p, w, label in KEY_PATTERNS]
    near_label = F.concat(F.lit('Similar to "'), near["word"], F.lit('" (distance)'))
    tests.append((near["score"] >= 0.4, _verdict(near["score"], near_label)))
    chain = reduce(lambda c, t: c.when(*t), tests[1:], F.when(*tests[0]))
    return chain.otherwise(F.coalesce(contained_score(normalized), _verdict(0.0, "No match")))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.8, "detected").when(score >= 0.5, "low").otherwise("unreliable")


def country_code(site: Column) -> Column:
    """``.XX`` in a site name, else a free-standing ``XX``, else its first two characters."""
    found = [F.nullif(F.regexp_extract(site, p, 1), F.lit("")) for p in (r"\.([A-Z]{2})\b", r"\b([A-Z]{2})\b")]
    return F.coalesce(*found, F.upper(F.substring(site, 1, 2)))
