"""Feed pairs derived from the driver's tables, in SQL that Spark and DuckDB both read.

``{part}`` and the like stand for the tables: DataFrames in Spark, views in DuckDB.
"""

from __future__ import annotations

PART_A = """
SELECT 'part' AS _file, p_partkey * 2 AS ord,
       CASE WHEN p_partkey % 7 = 0 THEN lpad(CAST(p_partkey AS STRING), 8, '0') ELSE CAST(p_partkey AS STRING) END AS sku,
       p_name AS title, p_brand AS brand,
       CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_type END AS kind,
       CAST(p_size AS STRING) AS size,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) AS retail
FROM {part} WHERE p_partkey % 13 <> 0
UNION ALL
SELECT 'part', p_partkey * 2 + 1, CAST(p_partkey AS STRING), 'DUPLICATE', p_brand, p_type, '0', '0.00'
FROM {part} WHERE p_partkey % 17 = 0 AND p_partkey % 13 <> 0
UNION ALL
SELECT 'part', 100000000 + p_partkey, '', p_name, p_brand, p_type, '1', '1.00' FROM {part} WHERE p_partkey < 3
"""

PART_B = """
SELECT 'part' AS _file, p_partkey * 2 AS ord,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS STRING) || '.0' ELSE ' ' || CAST(p_partkey AS STRING) || ' ' END AS sku,
       CASE WHEN p_partkey % 23 = 0 THEN upper(p_name) ELSE p_name END AS title,
       CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_brand END AS brand,
       CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN '' ELSE p_type END AS kind,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS STRING) || '.0' ELSE CAST(p_size AS STRING) END AS size,
       CASE WHEN p_partkey % 37 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) + 1 AS STRING)
            ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END AS retail
FROM {part} WHERE p_partkey % 11 <> 0
"""

PART_COLUMNS = ["brand", "kind", "retail", "size", "title"]

# A large pair whose key repeats in the data itself; besides, a third of all lines share one hot key.
LINE_A = """
SELECT 'lineitem' AS _file,
       concat_ws('-', lpad(CAST(l_orderkey AS STRING), 12, '0'), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                 CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING),
                 CAST(CAST(l_quantity AS DECIMAL(12,2)) AS STRING), l_returnflag, l_linestatus) AS ord,
       CASE WHEN l_partkey % 3 = 0 THEN 'HOT' ELSE CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS sku,
       CAST(l_partkey AS STRING) AS part, CAST(l_suppkey AS STRING) AS supp,
       CAST(CAST(l_quantity AS DECIMAL(12,2)) AS STRING) AS qty,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) AS price,
       l_returnflag AS flag, l_linestatus AS linestatus
FROM {lineitem} WHERE l_orderkey % 13 <> 0
"""

LINE_B = """
SELECT 'lineitem' AS _file,
       concat_ws('-', lpad(CAST(l_orderkey AS STRING), 12, '0'), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                 CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING),
                 CAST(CAST(l_quantity AS DECIMAL(12,2)) AS STRING), l_returnflag, l_linestatus) AS ord,
       CASE WHEN l_partkey % 3 = 0 THEN ' HOT' ELSE CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || ' ' END AS sku,
       CAST(l_partkey AS STRING) AS part,
       CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS supp,
       CAST(CAST(l_quantity AS BIGINT) AS STRING) AS qty,
       CASE WHEN l_orderkey % 37 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) + 1 AS STRING)
            ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END AS price,
       CASE WHEN l_orderkey % 19 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS flag, l_linestatus AS linestatus
FROM {lineitem} WHERE l_orderkey % 11 <> 0
"""

LINE_COLUMNS = ["flag", "linestatus", "part", "price", "qty", "supp"]

# Several files of one shape. The file of the customers holds most rows; region has no shared key.
MANY_A = """
SELECT 'supplier.csv' AS _file, s_suppkey AS ord, CAST(s_suppkey AS STRING) AS sku, s_name AS name,
       CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS STRING) AS amount, 'n' || CAST(s_nationkey AS STRING) AS grp
FROM {supplier} WHERE s_suppkey % 13 <> 0
UNION ALL
SELECT 'customer.csv', c_custkey, 'Cust-' || CAST(c_custkey AS STRING), c_name,
       CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING), c_mktsegment FROM {customer} WHERE c_custkey % 13 <> 0
UNION ALL
SELECT 'part.csv', p_partkey, CAST(p_partkey % 500 AS STRING), p_name,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING), p_brand FROM {part}
UNION ALL
SELECT 'region.csv', r_regionkey, 'old-' || CAST(r_regionkey AS STRING), r_name, '', '' FROM {region}
"""

MANY_B = """
SELECT 'supplier.csv' AS _file, s_suppkey AS ord, lpad(CAST(s_suppkey AS STRING), 12, '0') AS sku, s_name AS name,
       CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS STRING) END AS amount,
       CASE WHEN s_suppkey % 5 = 0 THEN upper('n' || CAST(s_nationkey AS STRING)) ELSE 'n' || CAST(s_nationkey AS STRING) END AS grp
FROM {supplier} WHERE s_suppkey % 11 <> 0
UNION ALL
SELECT 'customer.csv', c_custkey, 'CUST-' || CAST(c_custkey AS STRING), c_name,
       CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) END,
       CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || '!' ELSE c_mktsegment END FROM {customer} WHERE c_custkey % 11 <> 0
UNION ALL
SELECT 'part.csv', p_partkey, CAST(p_partkey % 500 AS STRING) || '.0', p_name,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) || '0', p_brand FROM {part} WHERE p_partkey % 7 <> 0
UNION ALL
SELECT 'region.csv', r_regionkey, 'new-' || CAST(r_regionkey AS STRING), r_name, '', '' FROM {region}
"""

MANY_COLUMNS = ["amount", "grp", "name"]

# Raw keys of every shape the normalisation knows, made from each line of lineitem.
RAW_KEYS = """
SELECT l_orderkey AS okey, l_linenumber AS line, l_partkey AS pkey,
       CASE (l_orderkey + l_partkey) % 20
         WHEN 0 THEN lpad(CAST(l_orderkey AS STRING), 12, '0')
         WHEN 1 THEN CAST(l_orderkey AS STRING) || '.0'
         WHEN 2 THEN CAST(l_orderkey AS STRING) || '.50'
         WHEN 3 THEN ' ' || CAST(l_orderkey AS STRING) || '  '
         WHEN 4 THEN 'A ' || chr(9) || CAST(l_orderkey AS STRING) || '   b '
         WHEN 5 THEN '-0' || CAST(l_orderkey AS STRING)
         WHEN 6 THEN CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING)
         WHEN 7 THEN CAST(l_orderkey AS STRING) || ' ' || CAST(l_partkey AS STRING)
         WHEN 8 THEN '1.' || CAST(l_orderkey AS STRING) || '.3'
         WHEN 9 THEN CAST(l_orderkey AS STRING) || '.'
         WHEN 10 THEN '-' || CAST(l_linenumber AS STRING)
         WHEN 11 THEN '.00'
         WHEN 12 THEN '-0.0'
         WHEN 13 THEN chr(10) || 'SKU-' || CAST(l_orderkey AS STRING) || chr(13)
         WHEN 14 THEN CAST(l_linenumber AS STRING) || '.'
         WHEN 15 THEN chr(9) || ' '
         WHEN 16 THEN '00' || CAST(l_orderkey AS STRING) || '.000'
         WHEN 17 THEN chr(11) || CAST(l_orderkey AS STRING) || chr(12)
         WHEN 18 THEN l_returnflag || '_' || CAST(l_orderkey AS STRING)
         ELSE CAST(l_orderkey AS STRING) END AS raw
FROM {lineitem}
"""

# Value pairs around the edges of numeric equality, made from each line of lineitem.
VALUE_PAIRS = """
SELECT l_orderkey AS okey, l_linenumber AS line, l_partkey AS pkey,
       CASE l_partkey % 15
         WHEN 0 THEN CAST(l_orderkey AS STRING) WHEN 1 THEN '00' || CAST(l_orderkey AS STRING)
         WHEN 2 THEN CAST(l_orderkey AS STRING) || 'D' WHEN 3 THEN 'nan' WHEN 4 THEN 'inf' WHEN 5 THEN '1_0' || CAST(l_orderkey AS STRING)
         WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN ' ' WHEN 9 THEN CAST(l_linenumber AS STRING) || 'e3'
         WHEN 10 THEN '+' || CAST(l_orderkey AS STRING) WHEN 11 THEN l_returnflag WHEN 12 THEN '-0' WHEN 13 THEN '0x1p3'
         ELSE ' ' || CAST(l_orderkey AS STRING) || chr(9) END AS v1,
       CASE l_partkey % 15
         WHEN 0 THEN CAST(l_orderkey AS STRING) || '.0' WHEN 1 THEN CAST(l_orderkey AS STRING)
         WHEN 2 THEN CAST(l_orderkey AS STRING) WHEN 3 THEN 'NaN' WHEN 4 THEN 'Infinity' WHEN 5 THEN '10' || CAST(l_orderkey AS STRING)
         WHEN 6 THEN NULL WHEN 7 THEN CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'x' END WHEN 8 THEN '' WHEN 9 THEN CAST(l_linenumber * 1000 AS STRING)
         WHEN 10 THEN CAST(l_orderkey AS STRING) || 'e0' WHEN 11 THEN lower(l_returnflag) WHEN 12 THEN '.0' WHEN 13 THEN '8'
         ELSE CAST(l_orderkey + l_linenumber % 2 AS STRING) END AS v2
FROM {lineitem}
"""

# Column names as a frame: each size of part is a file whose header is made from its parts.
HEADERS = """
SELECT 'feed_' || CAST(p_size AS STRING) AS _file, CAST(p_partkey % 2 + 1 AS INT) AS side, p_partkey AS pos,
       CASE p_partkey % 40
         WHEN 0 THEN 'SKU Code' WHEN 2 THEN 'g:id' WHEN 4 THEN 'category_id' WHEN 6 THEN 'Product-Number' WHEN 8 THEN 'eann'
         WHEN 10 THEN 'Item SKU ' || p_brand WHEN 12 THEN '"EAN"' WHEN 14 THEN 'at_skus' WHEN 16 THEN 'unnamed_' || CAST(p_partkey AS STRING)
         WHEN 18 THEN 'model no' WHEN 20 THEN 'xid' WHEN 22 THEN 'mygtincodefor' || p_type WHEN 24 THEN 'long:ns:name'
         WHEN 26 THEN 'ident' WHEN 28 THEN '###' WHEN 1 THEN 'Offer_ID' WHEN 3 THEN 'upc-code' WHEN 5 THEN 'part number'
         WHEN 7 THEN 'skuu' WHEN 9 THEN 'ids' WHEN 11 THEN 'Brand ID' WHEN 13 THEN 'a:b:mpn no' WHEN 15 THEN 'mean' WHEN 17 THEN 'Stock Keeping Unit'
         ELSE p_name || ' ' || CAST(p_size AS STRING) END AS "column"
FROM {part}
"""


def spark_sql(spark, sf_dir: str, sql: str):
    """Run SQL with ``{table}`` placeholders over the parquet tables, without registering views."""
    names = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "pages"]
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if "{" + n + "}" in sql}
    return spark.sql(sql.replace('"column"', "`column`"), **tables)


def duck(sql: str) -> str:
    """The same SQL for DuckDB, where the placeholders are views."""
    return sql.replace("{", "").replace("}", "")

# The same pairs as files; the largest is XML.
FILES_A = MANY_A.replace("customer.csv", "customer.xml")
FILES_B = MANY_B.replace("customer.csv", "customer.xml")
FILE_DELIMITERS = {"supplier.csv": ";", "part.csv": "|", "region.csv": "\t"}

# First lines of files, one file per part, cut by a delimiter the part number tells.
HEAD_LINES = """
SELECT 'f' || CAST(p_partkey AS STRING) AS path, pos,
       'sku' || d || CASE WHEN pos = 0 THEN 'title' ELSE '"a,b;c|d"' END || d || p_name || CASE WHEN pos = 2 AND p_partkey % 9 = 0 THEN d || 'more' ELSE '' END AS line
FROM (SELECT p_partkey, p_name, explode(array(0, 1, 2)) AS pos,
             CASE p_partkey % 8 WHEN 0 THEN '|' WHEN 1 THEN ';' WHEN 2 THEN chr(9) WHEN 3 THEN ',' WHEN 4 THEN '~' WHEN 5 THEN '^'
             WHEN 6 THEN chr(1) ELSE '' END AS d FROM {part})
"""

LISTING_A = "SELECT DISTINCT c_name || '.csv' AS _file FROM {customer} WHERE c_custkey % 13 <> 0"
LISTING_B = "SELECT DISTINCT c_name || '.csv' AS _file FROM {customer} WHERE c_custkey % 11 <> 0"

# Channel lists of two sites; names repeat and differ by case.
CHANNELS_A = """SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END || ' ' || p_brand AS name,
 CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'http://a/' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '.xml?x=1.zip' ELSE '/feed?y' END END AS link
 FROM {part}"""
CHANNELS_B = """SELECT p_partkey AS pos, p_name || ' ' || lower(p_brand) AS name, 'https://b/v1.2/' || CAST(p_partkey AS STRING) || '.ZIP' AS link
 FROM {part} WHERE p_size % 3 <> 0"""

SITE_NAMES = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'shop.DE live' WHEN 1 THEN 'Shop FR ' || c_name WHEN 2 THEN c_name
 WHEN 3 THEN 'x' ELSE 'a.DEU ' || 'AT' || '-' || c_mktsegment END AS site FROM {customer}"""

SITES = """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN s_name END AS title,
 CASE WHEN s_suppkey % 5 <> 0 THEN 'n' || CAST(s_suppkey AS STRING) END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'active' END AS status FROM {supplier}"""

PACKED = """SELECT g, 'p' || CAST(g AS STRING) || CASE g % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.xlsx' ELSE '.xml.zip' END AS _file, p_partkey, p_name, p_brand
 FROM (SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS g, p_partkey, p_name, p_brand FROM {part})"""

# Records of two feeds: an inch mark in each title of one, a title over two lines in each record of the other.
QUOTED = """SELECT 'inch.csv' AS _file, p_partkey AS sku, '27" ' || p_name AS title, CAST(p_partkey AS STRING) || ',27" ' || p_name AS line FROM {part}
 UNION ALL SELECT 'lines.csv', p_partkey, p_name || chr(10) || p_brand, CAST(p_partkey AS STRING) || ',"' || p_name || chr(10) || p_brand || '"' FROM {part}"""


# Records whose comments, text and attribute values hold markup, with nested children; pieces of one document each.
MARKUP = """SELECT p_partkey AS k, '<product code="' || CAST(p_partkey AS STRING) || '>"><!-- old <item> list --><sku>' || CAST(p_partkey AS STRING) || '</sku><title><![CDATA[<b>'
 || p_name || '</b> <item>x</item>]]></title><dims><w>' || CAST(p_size AS STRING) || '</w></dims><dims><h unit="cm">' || CAST(p_size + 1 AS STRING)
 || '</h></dims><tag>first</tag><tag>' || p_brand || '</tag></product>' AS record FROM {part}"""

# A feed whose header and values run over line ends.
WRAPPED = """SELECT p_partkey AS sku, p_name || chr(10) || 'line, "two" x' AS title, p_brand AS brand,
 CAST(p_partkey AS STRING) || ',"' || p_name || chr(10) || 'line, ""two"" x",' || p_brand AS line FROM {part}"""

# A feed that only its later lines tell the delimiter of: the first twentieth has a semicolon in each line as well.
LATE = """SELECT p_partkey AS sku, CASE WHEN p_partkey * 20 <= n THEN p_name || ';' || p_brand ELSE p_name END AS title
 FROM {part} CROSS JOIN (SELECT count(*) AS n FROM {part}) AS t"""


# Titles that only one encoding of three writes as bytes that are valid in no earlier one.
ENCODED = """SELECT _file, p_partkey AS sku, added || p_name AS title FROM {part}
 CROSS JOIN (SELECT 'utf.csv' AS _file, 'Größe 中 ' AS added UNION ALL SELECT 'gbk.csv', '中文 ' UNION ALL SELECT 'latin.csv', 'café ') AS t"""
FILE_ENCODINGS = {"utf.csv": "UTF-8", "gbk.csv": "GBK", "latin.csv": "ISO-8859-1"}


# Keys with characters that stand for ASCII ones: full-width digits and letters, a no-break space, a dash.
WIDE = "０１２３４５６７８９Ａ\u00a0–"
PLAIN = "0123456789A -"
WIDE_KEYS = f"""SELECT l_orderkey AS okey, l_linenumber AS line, CASE l_orderkey % 5
 WHEN 0 THEN translate(CAST(l_orderkey AS STRING), '0123456789', '{WIDE[:10]}') WHEN 1 THEN 'A' || '{WIDE[11]}' || CAST(l_orderkey AS STRING)
 WHEN 2 THEN CAST(l_orderkey AS STRING) || '{WIDE[12]}' || CAST(l_partkey AS STRING) WHEN 3 THEN '００' || translate(CAST(l_orderkey AS STRING), '0123456789', '{WIDE[:10]}')
 ELSE '{WIDE[10]}' || CAST(l_orderkey AS STRING) || '.0' END AS raw FROM {{lineitem}}"""
