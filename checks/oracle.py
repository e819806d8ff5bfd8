"""The expected answers as DuckDB SQL, written from the definitions rather than from the Spark code."""

from __future__ import annotations

from checks import feeds
from checks.feeds import duck
from rowtally.functions.names import EXCLUDED_PATTERNS, KEY_PATTERNS

W = r"[\s\x0b\x1c-\x1f]"
PAD = r"[\s\x0b]"


def key(v: str, fold: bool = False) -> str:
    n = rf"regexp_replace(regexp_replace(regexp_replace({v}, '^{W}+|{W}+$', '', 'g'), '[\t\n\r\f\x0b]', '', 'g'), '{W}+', ' ', 'g')"
    digits = rf"regexp_replace({n}, '[.\- ]', '', 'g')"
    plain = rf"regexp_replace(regexp_replace(trim({n}), '\.0*$', ''), '^(-?)0+([0-9])', '\1\2')"
    sql = (
        rf"CASE WHEN regexp_matches({n}, '^ ?-?([0-9]+(\.0*)?|\.0+) ?$') AND regexp_matches({digits}, '^[0-9][0-9]+$')"
        rf" THEN CASE WHEN {plain} IN ('', '-', '-0') THEN '0' ELSE {plain} END ELSE {n} END"
    )
    return f"lower({sql})" if fold else sql


_NUM = (
    rf"^{PAD}*[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?{PAD}*$"
    rf"|^{PAD}*[+-]?(?i:inf(inity)?){PAD}*$"
)


def number(v: str) -> str:
    return rf"TRY_CAST(replace(regexp_replace({v}, '^{W}+|{W}+$', '', 'g'), '_', '') AS DOUBLE)"


def code(a: str, b: str) -> str:
    return (
        f"CASE WHEN coalesce({a}, '') = '' AND coalesce({b}, '') = '' THEN 1 WHEN coalesce({a}, '') = '' THEN 2"
        f" WHEN coalesce({b}, '') = '' THEN 3 WHEN {a} = {b} THEN 0"
        f" WHEN regexp_matches({a}, '{_NUM}') AND regexp_matches({b}, '{_NUM}') AND {number(a)} = {number(b)} THEN 0 ELSE 4 END"
    )


RATE = "CASE WHEN total_compared > 0 THEN round_even(CAST(100 AS DOUBLE) * exact_matches / total_compared, 2) ELSE CAST(0 AS DOUBLE) END"
STATUS = """CASE WHEN total_compared > 0 AND exact_matches = total_compared THEN 'PERFECT'
 WHEN total_compared > 0 AND CAST(100 AS DOUBLE) * exact_matches / total_compared >= 95 THEN 'GOOD'
 WHEN total_compared > 0 AND CAST(100 AS DOUBLE) * exact_matches / total_compared >= 80 THEN 'FAIR'
 WHEN total_compared > 0 AND CAST(100 AS DOUBLE) * exact_matches / total_compared >= 50 THEN 'POOR' ELSE 'BAD' END"""
COUNTERS = "total_compared, exact_matches, mismatches, both_empty, only_1_empty, only_2_empty"


def pair(feed_a: str, feed_b: str, columns: list[str], body: str, fold: bool = False) -> str:
    """``body`` over the common chain: keyed, first rows, cells, counters, rates, pair summary."""
    one = lambda c: (
        f"SELECT a._file, a.k AS sku, '{c}' AS \"column\", a.{c} AS value_1, b.{c} AS value_2"
        " FROM first_a a JOIN first_b b ON a._file = b._file AND a.k = b.k"
    )
    names = ", ".join(f"('{c}')" for c in columns)
    side = lambda s: f"""
keyed_{s} AS (SELECT *, coalesce({key('sku', fold)}, '') AS k FROM feed_{s}),
first_{s} AS (SELECT * FROM keyed_{s} WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY _file, k ORDER BY ord) = 1),
keys_{s} AS (SELECT _file, k, count(*) AS n, regexp_replace(arg_min(sku, ord), '^{W}+|{W}+$', '', 'g') AS raw_sku
             FROM keyed_{s} WHERE k <> '' GROUP BY _file, k),
raw_{s} AS (SELECT _file, count(*) AS rows, count(DISTINCT CASE WHEN sku <> '' THEN sku END) AS raws FROM feed_{s} GROUP BY _file)"""
    return duck(f"""WITH feed_a AS ({feed_a}), feed_b AS ({feed_b}),{side('a')},{side('b')},
ledger AS (SELECT coalesce(a._file, b._file) AS _file, coalesce(a.k, b.k) AS k, a.n AS n1, b.n AS n2, a.raw_sku AS raw1, b.raw_sku AS raw2
           FROM keys_a a FULL JOIN keys_b b ON a._file = b._file AND a.k = b.k),
cells AS ({' UNION ALL '.join(one(c) for c in columns)}),
coded AS (SELECT *, {code('value_1', 'value_2')} AS code FROM cells),
files AS (SELECT DISTINCT _file FROM feed_a INTERSECT SELECT DISTINCT _file FROM feed_b),
counted AS (SELECT _file, "column", count(*) AS total_compared, count(*) FILTER (code < 2) AS exact_matches,
  count(*) FILTER (code >= 2) AS mismatches, count(*) FILTER (code = 1) AS both_empty,
  count(*) FILTER (code = 2) AS only_1_empty, count(*) FILTER (code = 3) AS only_2_empty FROM coded GROUP BY ALL),
filled AS (SELECT f._file, n."column", coalesce(total_compared, 0) AS total_compared, coalesce(exact_matches, 0) AS exact_matches,
  coalesce(mismatches, 0) AS mismatches, coalesce(both_empty, 0) AS both_empty, coalesce(only_1_empty, 0) AS only_1_empty,
  coalesce(only_2_empty, 0) AS only_2_empty
  FROM files f CROSS JOIN (VALUES {names}) n("column") LEFT JOIN counted c ON c._file = f._file AND c."column" = n."column"),
stats AS (SELECT *, {RATE} AS match_rate, {STATUS} AS status FROM filled),
summed AS (SELECT "column", CAST(sum(total_compared) AS BIGINT) AS total_compared, CAST(sum(exact_matches) AS BIGINT) AS exact_matches,
  CAST(sum(mismatches) AS BIGINT) AS mismatches, CAST(sum(both_empty) AS BIGINT) AS both_empty,
  CAST(sum(only_1_empty) AS BIGINT) AS only_1_empty, CAST(sum(only_2_empty) AS BIGINT) AS only_2_empty, count(*) AS file_count
  FROM filled GROUP BY "column"),
overall AS (SELECT *, {RATE} AS match_rate, {STATUS} AS status FROM summed),
totals AS (SELECT _file, CAST(sum(mismatches) AS BIGINT) AS total_differences, round_even(avg(match_rate), 1) AS avg_match_rate,
  CAST(count(*) AS INTEGER) AS columns_compared FROM stats GROUP BY _file),
key_counts AS (SELECT _file, count(n1) AS keys_1, count(n2) AS keys_2, count(*) FILTER (n1 > 0 AND n2 > 0) AS common,
  count(*) FILTER (n2 IS NULL) AS only_1, count(*) FILTER (n1 IS NULL) AS only_2,
  CAST(coalesce(sum(n1 - 1), 0) AS BIGINT) AS duplicates_1, CAST(coalesce(sum(n2 - 1), 0) AS BIGINT) AS duplicates_2,
  CAST(coalesce(sum(n1 - 1) FILTER (n2 > 0), 0) AS BIGINT) AS common_duplicates_1,
  CAST(coalesce(sum(n2 - 1) FILTER (n1 > 0), 0) AS BIGINT) AS common_duplicates_2 FROM ledger GROUP BY _file),
summary AS (SELECT f._file, 'success' AS status, CAST(NULL AS VARCHAR) AS reason, 'sku' AS key_1, 'sku' AS key_2,
  ra.rows AS rows_1, rb.rows AS rows_2, ra.raws AS raw_distinct_1, rb.raws AS raw_distinct_2, keys_1, keys_2, common, only_1, only_2,
  duplicates_1, duplicates_2, common_duplicates_1, common_duplicates_2, total_differences, avg_match_rate, columns_compared
  FROM files f JOIN raw_a ra USING (_file) JOIN raw_b rb USING (_file) JOIN key_counts USING (_file) JOIN totals USING (_file))
{body}""")


def part(body: str, fold: bool = False) -> str:
    return pair(feeds.PART_A, feeds.PART_B, feeds.PART_COLUMNS, body, fold)


def line(body: str) -> str:
    return pair(feeds.LINE_A, feeds.LINE_B, feeds.LINE_COLUMNS, body)


def many(body: str, fold: bool = False) -> str:
    return pair(feeds.MANY_A, feeds.MANY_B, feeds.MANY_COLUMNS, body, fold)


STATS = f'SELECT _file, "column", {COUNTERS}, match_rate, status FROM stats'
DIFFS = 'SELECT _file, sku, "column", value_1, value_2 FROM coded WHERE code >= 2'
OVERALL = f'SELECT "column", {COUNTERS}, file_count, match_rate, status FROM overall'
MISSING = """SELECT _file, CASE WHEN n1 IS NULL THEN '1' ELSE '2' END AS missing_in, k AS sku, coalesce(raw1, raw2) AS raw_sku
 FROM ledger WHERE n1 IS NULL OR n2 IS NULL"""
PRESENCE = """SELECT _file, k AS sku, CASE WHEN n2 IS NULL THEN 'only_1' WHEN n1 IS NULL THEN 'only_2' ELSE 'both' END AS presence FROM ledger"""
RANKED = f"""SELECT *, CAST(row_number() OVER (PARTITION BY _file ORDER BY "column", sku) AS INTEGER) AS rank FROM ({DIFFS})"""
RUN = """SELECT count(*) AS total_pairs, count(*) FILTER (status = 'success') AS success, CAST(0 AS BIGINT) AS skipped,
 CAST(0 AS BIGINT) AS failed, CAST(sum(common) AS BIGINT) AS total_skus, CAST(sum(total_differences) AS BIGINT) AS total_diffs,
 CAST(sum(only_1 + only_2) AS BIGINT) AS total_missing,
 (SELECT round_even(avg(match_rate), 1) FROM overall) AS avg_match_rate FROM summary"""

NAME_NORM = (
    r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("""
    r"""lower(regexp_replace("column", '^\s+|\s+$', '', 'g')), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g'),"""
    r""" '^[^:]{0,3}:(.*:)?', ''), '[\s\-_]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '^_+|_+$', '', 'g')"""
)

# The scoring rules on normalised names, in order.
_RULES = KEY_PATTERNS
_NOT_A_KEY = "|".join(EXCLUDED_PATTERNS)


def _guided(user, priority):
    """WHEN branches for a user column and a priority list, in front of the general rules."""
    score, label = "", ""
    for want, i in ([(user, None)] if user else []) + [(c, i) for i, c in enumerate(priority) if c]:
        tops = (1.0, 0.98, 0.96) if i is None else [max(t - i * 0.02, f) for t, f in ((0.95, 0.8), (0.93, 0.78), (0.91, 0.76))]
        head = "User specified" if i is None else f"Priority #{i + 1}"
        norm = NAME_NORM.replace('"column"', f"'{want}'").replace("{0,3}", "<<0,3>>")
        tests = [f"\"column\" = '{want}'", f"lower(\"column\") = lower('{want}')", f"n = {norm}"]
        for test, top, how in zip(tests, tops, ("exact", "case-insensitive", "normalized")):
            score += f" WHEN {test} THEN CAST({top!r} AS DOUBLE)"
            label += f" WHEN {test} THEN '{head} ({how})'"
    return score, label


def scores(body: str, user=None, priority=()) -> str:
    by_user, user_label = _guided(user, priority)
    by = lambda pick: " ".join(f"WHEN regexp_matches(n, '{p}') THEN {pick(w, t)}" for p, w, t in _RULES)
    words = ["ean", "at_sku", "sku", "id"]
    near = lambda w, i: (
        f"greatest(CAST(0 AS DOUBLE), least(CAST(0.7 AS DOUBLE), (1 - CAST(levenshtein(n, '{w}') AS DOUBLE) / greatest(length(n), {len(w)})"
        f" - least(CAST(length(n) AS DOUBLE) / 20, CAST(0.3 AS DOUBLE))) * CAST(0.7 AS DOUBLE))) + {4 - i} * CAST(0.05 AS DOUBLE)"
    )
    inside = ["sku", "ean", "gtin", "upc", "mpn", "offerid", "productid", "itemid"]
    found = "CASE " + " ".join(f"WHEN contains(n, '{w}') THEN '{w}'" for w in inside) + " END"
    low = "least(CAST(0.55 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), (15 - length(n)) * CAST(0.003 AS DOUBLE)), CAST(0.65 AS DOUBLE))"
    best = "greatest(" + ", ".join(f"d{i}" for i in range(4)) + ")"
    word = "CASE " + " ".join(f"WHEN d{i} = near THEN '{w}'" for i, w in enumerate(words)) + " END"
    return duck(f"""WITH headers AS ({feeds.HEADERS}), named AS (SELECT *, {NAME_NORM.replace('{0,3}', '<<0,3>>')} AS n FROM headers),
near4 AS (SELECT *, {', '.join(f'{near(w, i)} AS d{i}' for i, w in enumerate(words))} FROM named),
near1 AS (SELECT *, {best} AS near, {found} AS inside FROM near4),
scored AS (SELECT _file, side, pos, "column",
  CASE {by_user} WHEN regexp_matches(n, '{_NOT_A_KEY}') THEN CAST(0 AS DOUBLE) {by(lambda w, t: f'CAST({w} AS DOUBLE)')}
       WHEN near >= CAST(0.4 AS DOUBLE) THEN near WHEN inside IS NOT NULL THEN {low} ELSE CAST(0 AS DOUBLE) END AS score,
  CASE {user_label} WHEN regexp_matches(n, '{_NOT_A_KEY}') THEN 'Excluded' {by(lambda w, t: "'" + t + "'")}
       WHEN near >= CAST(0.4 AS DOUBLE) THEN 'Similar to "' || {word} || '" (distance)'
       WHEN inside IS NOT NULL THEN 'Contains "' || inside || '"' ELSE 'No match' END AS label FROM near1),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY _file, side ORDER BY score DESC, length("column"), pos) AS INTEGER) AS rank FROM scored WHERE score > 0),
best AS (SELECT _file, side, "column" AS key, score, label, {band('score')} AS confidence_band FROM ranked WHERE rank = 1)
{body}""").replace("<<0,3>>", "{0,3}")


def band(score: str) -> str:
    return f"CASE WHEN {score} >= CAST(0.8 AS DOUBLE) THEN 'detected' WHEN {score} >= CAST(0.5 AS DOUBLE) THEN 'low' ELSE 'unreliable' END"


_RESOLVED = """, sides AS (SELECT _file, bool_or(side = 1 AND "column" = 'ids') AND bool_or(side = 2 AND "column" = 'ids') AS given
  FROM headers GROUP BY _file),
pairs AS (SELECT a._file, a.key AS key_1, b.key AS key_2, least(a.score, b.score) AS confidence
  FROM best a JOIN best b ON a._file = b._file AND a.side = 1 AND b.side = 2)"""

ORACLE = {
    "key_normalize": duck(f"SELECT okey, line, pkey, raw, {key('raw')} AS sku FROM ({feeds.RAW_KEYS})"),
    "key_normalize_wide": duck(f"""SELECT okey, line, raw, {key('ascii')} AS sku
 FROM (SELECT *, translate(raw, '{feeds.WIDE}', '{feeds.PLAIN}') AS ascii FROM ({feeds.WIDE_KEYS}))"""),
    "value_equality": duck(f"SELECT *, code < 2 AS equal FROM (SELECT okey, line, pkey, v1, v2, {code('v1', 'v2')} AS code FROM ({feeds.VALUE_PAIRS}))"),
    "dedupe_first": line(f"SELECT _file, k AS sku, {', '.join(feeds.LINE_COLUMNS)} FROM first_a"),
    "column_stats": part(STATS),
    "diff_cells": part(DIFFS),
    "missing_keys": part(MISSING),
    "key_presence": part(PRESENCE),
    "duplicate_counts": part("""SELECT _file, rows_1, rows_2, keys_1, keys_2, duplicates_1, duplicates_2,
 common_duplicates_1, common_duplicates_2 FROM summary"""),
    "pair_summary": part("SELECT * FROM summary"),
    "diff_preview": part(f"SELECT * FROM ({RANKED}) WHERE rank <= 10"),
    "column_exclusion": part(STATS + " WHERE \"column\" <> 'retail'"),
    "explicit_columns": part(STATS + " WHERE \"column\" IN ('title', 'brand')"),
    "line_column_stats": line(STATS),
    "line_diff_cells": line(DIFFS),
    "line_missing_keys": line(MISSING),
    "line_pair_summary": line("SELECT * FROM summary"),
    "common_keys": line("SELECT _file, k AS sku FROM ledger WHERE n1 > 0 AND n2 > 0"),
    "only_in_1": line("SELECT _file, k AS sku FROM ledger WHERE n2 IS NULL"),
    "only_in_2": line("SELECT _file, k AS sku FROM ledger WHERE n1 IS NULL"),
    "files_column_stats": many(STATS),
    "files_column_stats_no_case": many(STATS, fold=True),
    "files_pair_summary": many("SELECT * FROM summary"),
    "overall_stats": many(OVERALL),
    "channel_stats": many("""SELECT "column", CASE WHEN _file = 'customer.csv' THEN 'Customers' ELSE _file END AS channel, status,
 match_rate, exact_matches AS matches, mismatches, total_compared AS total FROM stats"""),
    "stats_by_level": many(f"""SELECT "column", _file, {COUNTERS}, match_rate, status FROM stats
 UNION ALL SELECT "column", NULL, {COUNTERS}, match_rate, status FROM overall"""),
    "one_side_empty": many('SELECT _file, "column", only_1_empty + only_2_empty AS one_side_empty FROM stats'),
    "run_summary": many(RUN),
    "preview_overall": many(f"SELECT * FROM ({RANKED}) WHERE rank <= 10 ORDER BY _file, rank LIMIT 10"),
    "diff_export": many("""SELECT _file AS File, sku, "column", coalesce(nullif(value_1, ''), 'EMPTY') AS Value_F1,
 coalesce(nullif(value_2, ''), 'EMPTY') AS Value_F2 FROM coded WHERE code >= 2"""),
    "log_summary": many("""SELECT category, CAST(sum(n) AS BIGINT) AS events FROM (
 SELECT unnest([{'category': 'INFO', 'n': 1}, {'category': 'MATCH', 'n': 2}, {'category': 'STAT', 'n': 1},
   {'category': 'SUCCESS', 'n': 1}, {'category': 'MISS', 'n': CASE WHEN only_1 + only_2 > 0 THEN 1 ELSE 0 END},
   {'category': 'DEBUG', 'n': CASE WHEN common_duplicates_1 + common_duplicates_2 > 0 THEN 1 ELSE 0 END}], recursive := true) FROM summary)
 GROUP BY category HAVING sum(n) > 0""".replace("{", "<<").replace("}", ">>")).replace("<<", "{").replace(">>", "}"),
    "log_filter": many("""SELECT 'MATCH' AS category, _file AS file, 'key columns: sku | sku' AS message FROM summary
 UNION ALL SELECT 'MATCH', _file, common || ' keys on both sides' FROM summary
 UNION ALL SELECT 'MISS', _file, 'only in 1: ' || only_1 || ', only in 2: ' || only_2 FROM summary WHERE only_1 + only_2 > 0"""),
    "column_names": scores(f"""SELECT _file, side, pos, "column", n AS normalized, regexp_matches(n, '{_NOT_A_KEY}') AS excluded,
 regexp_replace("column", '^[^:]<<0,3>>:(.*:)?', '') AS tag FROM named"""),
    "column_scores": scores("SELECT * FROM scored"),
    "column_scores_guided": scores("SELECT * FROM scored", "Ident", ["", "g:ID", "skuu", "OFFER ID"]),
    "top_candidates": scores("SELECT * FROM ranked WHERE rank <= 5"),
    "detected_keys": scores("SELECT * FROM best"),
    "paired_keys": scores(f"""SELECT a._file, a.key AS key_1, a.score AS score_1, b.key AS key_2, b.score AS score_2,
 least(a.score, b.score) AS confidence, {band('least(a.score, b.score)')} AS confidence_band
 FROM best a JOIN best b ON a._file = b._file AND a.side = 1 AND b.side = 2"""),
    "resolved_keys": scores(f"""{_RESOLVED} SELECT s._file, CASE WHEN given THEN 'ids' ELSE key_1 END AS key_1,
 CASE WHEN given THEN 'ids' ELSE key_2 END AS key_2, CASE WHEN given THEN 1.0 ELSE confidence END AS confidence,
 CASE WHEN given THEN 'detected' WHEN confidence IS NULL THEN NULL ELSE {band('confidence')} END AS confidence_band,
 CASE WHEN given OR key_1 IS NOT NULL THEN 'success' ELSE 'skipped' END AS status,
 CASE WHEN given OR key_1 IS NOT NULL THEN NULL ELSE 'no key column detected' END AS reason
 FROM sides s LEFT JOIN pairs p ON s._file = p._file""", user="ids"),
    "resolved_keys_manual": scores(f"""{_RESOLVED} SELECT _file, CASE WHEN given THEN 'ids' END AS key_1, CASE WHEN given THEN 'ids' END AS key_2,
 CASE WHEN given THEN CAST(1 AS DOUBLE) END AS confidence, CASE WHEN given THEN 'detected' END AS confidence_band,
 CASE WHEN given THEN 'success' ELSE 'skipped' END AS status, CASE WHEN NOT given THEN 'key column not found' END AS reason FROM sides"""),
}


def files(body: str) -> str:
    return pair(feeds.FILES_A, feeds.FILES_B, feeds.MANY_COLUMNS, body)


_EXT = r"""regexp_extract(string_split({l}, '?')[1], '[^/](\.[^./]+)$', 1)"""


def _file_name(channel: str, link: str) -> str:
    ext = _EXT.replace("{l}", link)
    return f"CASE WHEN {link} <> '' THEN {channel} || CASE WHEN {ext} = '' THEN '.csv' ELSE {ext} END END"


_MATCHED = f"""WITH a AS (SELECT lower(name) AS l, arg_max(name, pos) AS name, arg_max(link, pos) AS link FROM ({feeds.CHANNELS_A}) GROUP BY 1),
b AS (SELECT lower(name) AS l, arg_max(link, pos) AS link FROM ({feeds.CHANNELS_B}) GROUP BY 1),
m AS (SELECT a.l AS match_name, a.name AS channel, a.link AS link_1, b.link AS link_2 FROM a JOIN b ON a.l = b.l)"""

_SITES = f"""WITH s AS ({feeds.SITES}), listed AS (
 SELECT k AS response, 0 AS pos, k AS id, title, name, status FROM s WHERE k % 7 <> 0
 UNION ALL SELECT k, 1, k, 'again', 'again', 'active' FROM s WHERE k % 7 <> 0
 UNION ALL SELECT k, 2, k + 1, NULL, NULL, 'inactive' FROM s WHERE k % 7 <> 0)"""


def _sites(where: str) -> str:
    return duck(f"""{_SITES} SELECT CAST(response AS VARCHAR) AS response, CAST(id AS VARCHAR) AS id,
 coalesce(nullif(title, ''), name, 'Site_' || id) AS name, coalesce(status, 'unknown') AS status FROM listed WHERE {where}
 QUALIFY row_number() OVER (PARTITION BY response, id ORDER BY pos) = 1""")


_FAULTS = """WITH b AS (SELECT p_partkey AS k FROM {part}), n AS (SELECT k FROM b WHERE k % 11 <> 0),
good_b AS (SELECT k FROM b WHERE k % 10 <> 3), good_n AS (SELECT k FROM n WHERE k % 10 <> 7),
faults AS (SELECT 'parts' AS _file, 'success' AS status, NULL AS reason, (SELECT count(*) FROM b) AS rows_1, (SELECT count(*) FROM n) AS rows_2,
   (SELECT count(*) FROM n) AS common, CAST(0 AS BIGINT) AS rejects_1, CAST(0 AS BIGINT) AS rejects_2
 UNION ALL SELECT 'dirty', 'success', NULL, (SELECT count(*) FROM good_b), (SELECT count(*) FROM good_n),
   (SELECT count(*) FROM good_b JOIN good_n USING (k)), (SELECT count(*) FROM b WHERE k % 10 = 3), (SELECT count(*) FROM n WHERE k % 10 = 7)
 UNION ALL SELECT 'shop', 'error', 'several feeds of this name: shop.csv, shop.xml', NULL, NULL, NULL, 0, 0
 UNION ALL SELECT 'empty', 'error', 'empty file', NULL, NULL, NULL, 0, 0)"""

ORACLE |= {
    "csv_scan": duck(f"""SELECT nullif(sku, '') AS sku, nullif(title, '') AS title, nullif(brand, '') AS brand, nullif(kind, '') AS kind,
 nullif(size, '') AS size, nullif(retail, '') AS retail FROM ({feeds.PART_A})"""),
    "folder_column_stats": files(STATS),
    "folder_diff_cells": files("""SELECT _file, sku, "column", coalesce(value_1, '') AS value_1, coalesce(value_2, '') AS value_2
 FROM coded WHERE code >= 2"""),
    "folder_pair_summary": files("SELECT *, CAST(0 AS BIGINT) AS rejects_1, CAST(0 AS BIGINT) AS rejects_2 FROM summary"),
    "folder_missing_keys": files(MISSING),
    "csv_delimiters": duck("""SELECT 'f' || p_partkey AS path, CASE p_partkey % 8 WHEN 0 THEN '|' WHEN 1 THEN ';' WHEN 2 THEN chr(9)
 WHEN 3 THEN ',' WHEN 4 THEN '~' WHEN 5 THEN '^' WHEN 6 THEN chr(1) ELSE ',' END AS delimiter FROM {part}"""),
    "packed_scan": duck(f"SELECT _file, CAST(p_partkey AS VARCHAR) AS sku, p_name AS title, p_brand AS brand FROM ({feeds.PACKED})"),
    "csv_inch_mark": duck(f"""SELECT _file, count(*) AS rows, CAST(sum(length(title)) AS BIGINT) AS characters, _file = 'lines.csv' AS quoted_newline
 FROM ({feeds.QUOTED}) GROUP BY _file"""),
    "xml_root_children": duck("""SELECT 'parts.xml' AS _file, CAST(p_partkey AS VARCHAR) AS sku, p_name AS title, p_brand AS brand FROM {part}"""),
    "xml_markup": duck("""SELECT p_partkey || '>' AS code, CAST(p_partkey AS VARCHAR) AS sku, '<b>' || p_name || '</b> <item>x</item>' AS title,
 CAST(p_size AS VARCHAR) AS dims_w, CAST(p_size + 1 AS VARCHAR) AS dims_h, p_brand AS tag FROM {part}"""),
    "csv_encodings": duck(f"SELECT _file, CAST(sku AS VARCHAR) AS sku, title FROM ({feeds.ENCODED})"),
    "discovered_columns": files("""SELECT DISTINCT _file, side, "column", 'sku' AS key FROM files, (VALUES (1), (2)) s(side),
 (SELECT "column" FROM stats UNION SELECT 'sku') c"""),
    "report_columns": many("""SELECT row_number() OVER (ORDER BY match_rate, "column")::INTEGER AS place, "column", status, match_rate, total_compared AS total FROM overall"""),
    "report_files": many("SELECT row_number() OVER (ORDER BY _file)::INTEGER AS place, _file AS file, rows_1, common FROM summary"),
    "report_differences": many("""SELECT _file, row_number() OVER (PARTITION BY _file ORDER BY "column", sku)::INTEGER AS place, "column", sku,
 coalesce(nullif(value_1, ''), 'EMPTY') AS value_1, coalesce(nullif(value_2, ''), 'EMPTY') AS value_2 FROM coded WHERE code >= 2"""),
    "csv_wrapped": duck(f"SELECT CAST(sku AS VARCHAR) AS sku, title, brand FROM ({feeds.WRAPPED})"),
    "csv_late_delimiter": duck(f"SELECT CAST(sku AS VARCHAR) AS sku, title FROM ({feeds.LATE})"),
    "folder_repaired": duck(f"""{_FAULTS} SELECT _file, CASE WHEN _file = 'dirty' THEN (SELECT count(*) FROM b) ELSE rows_1 END AS rows_1,
 CASE WHEN _file = 'dirty' THEN (SELECT count(*) FROM n) ELSE rows_2 END AS rows_2, CASE WHEN _file = 'dirty' THEN (SELECT count(*) FROM n) ELSE common END AS common,
 CASE WHEN status = 'success' THEN 0 END AS total_differences, 0 AS rejects_1, 0 AS rejects_2, rejects_1 + rejects_2 AS repaired FROM faults"""),
    "folder_faults": duck(f"{_FAULTS} SELECT * FROM faults"),
    "folder_faults_log": duck(f"""{_FAULTS} SELECT 'ERROR' AS category, _file AS file, reason AS message FROM faults WHERE status = 'error'
 UNION ALL SELECT 'WARN', _file, 'records that do not parse: ' || rejects_1 || ' | ' || rejects_2 FROM faults WHERE rejects_1 + rejects_2 > 0"""),
    "folder_faults_run": duck(f"""{_FAULTS} SELECT count(*) AS total_pairs, count(*) FILTER (status = 'success') AS success, CAST(0 AS BIGINT) AS skipped,
 count(*) FILTER (status = 'error') AS failed, CAST(sum(common) AS BIGINT) AS total_skus, CAST(0 AS BIGINT) AS total_diffs,
 CAST(sum(rows_1 + rows_2 - 2 * common) AS BIGINT) AS total_missing, CAST(100 AS DOUBLE) AS avg_match_rate FROM faults"""),
    "file_pairing": duck(f"""SELECT coalesce(a._file, b._file) AS _file, CASE WHEN a._file IS NULL OR b._file IS NULL THEN 'unpaired' ELSE 'paired' END AS status,
 CASE WHEN a._file IS NULL THEN 'only in comparison' WHEN b._file IS NULL THEN 'only in baseline' END AS reason
 FROM ({feeds.LISTING_A}) a FULL JOIN ({feeds.LISTING_B}) b ON a._file = b._file"""),
    "projects": duck("""SELECT CAST(n_nationkey AS VARCHAR) AS response, CAST(n_nationkey * 10 + i AS VARCHAR) AS id, n_name || i AS name
 FROM {nation} CROSS JOIN (VALUES (0), (1)) t(i) WHERE n_nationkey % 6 <> 0"""),
    "site_dedupe": _sites("true"),
    "site_dedupe_active": _sites("status = 'active'"),
    "channel_links": duck("""SELECT CAST(p_partkey AS VARCHAR) AS response, 0 AS pos, p_name AS name,
 CASE p_partkey % 6 WHEN 0 THEN 'http://h/' || p_partkey WHEN 2 THEN 'http://s/' || p_brand ELSE '' END AS link FROM {part}"""),
    "channel_match": duck(f"{_MATCHED} SELECT * FROM m"),
    "channel_select": duck(f"{_MATCHED} SELECT * FROM m WHERE channel IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_partkey % 4 = 0)"),
    "channel_files": duck(f"""{_MATCHED}, n AS (SELECT channel, {_file_name('channel', 'link_1')} AS file_1, {_file_name('channel', 'link_2')} AS file_2 FROM m)
 SELECT * FROM n WHERE file_1 IS NOT NULL AND file_2 IS NOT NULL"""),
    "feed_file_name": f"SELECT page_id, {_file_name('CAST(page_id AS VARCHAR)', 'url')} AS file FROM pages",
    "country_code": duck(rf"""SELECT id, site, coalesce(nullif(regexp_extract(site, '\.([A-Z]<<2>>)\b', 1), ''),
 nullif(regexp_extract(site, '\b([A-Z]<<2>>)\b', 1), ''), upper(substr(site, 1, 2))) AS country FROM ({feeds.SITE_NAMES})""").replace("<<2>>", "{2}"),
}
