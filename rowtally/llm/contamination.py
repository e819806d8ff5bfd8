"""Operator 4: benchmark items inside documents, by a size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtally.session import scratch_folder, stored

SHINGLE = 5
LEAST = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """ASCII letters in lower case; words are runs of letters and digits, null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), NOT_A_WORD), "")


def _shingles(words: str, width: Column | int, make) -> Column:
    """``make`` of each run of ``width`` words; empty if there are fewer."""
    n = F.size(words) - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: make(i))).otherwise(F.array())


def _hash(words: str, i: Column, width: int) -> Column:
    """63 bits, the order MinHash takes minima in."""
    return F.shiftrightunsigned(F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)]), 1)


def _gram_hashes(width: int) -> Column:
    return F.transform("grams", lambda g: F.shiftrightunsigned(F.xxhash64(*[F.get(F.split(g, " "), F.lit(k)) for k in range(width)]), 1))


def _sketches(items: DataFrame, least: float) -> DataFrame:
    """item, item_id, width, grams, n, size partition, and ``need``: how many of its n shingles a document must hold.

    The sketch of an item is its n - need + 1 smallest shingle hashes: whoever holds ``need`` shingles holds one of these.
    """
    rows = items.select("item_id", "text").distinct()
    rows = rows.select("item_id", F.xxhash64("item_id", "text").alias("item"), _words(F.col("text")).alias("w")).filter("size(w) > 0")
    rows = rows.withColumn("width", F.least(F.size("w"), F.lit(SHINGLE)))
    gram = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("width")), lambda i: F.array_join(F.slice("w", i + 1, F.col("width")), " "))
    rows = rows.select("item", "item_id", "width", F.array_distinct(gram).alias("grams"))
    n = F.size("grams")
    rows = rows.select("*", n.alias("n"), F.ceil(n * F.lit(least) - F.lit(1e-9)).cast("int").alias("need"), F.floor(F.log2(n.cast("double"))).cast("int").alias("partition"))
    by_width = F.coalesce(*[F.when(F.col("width") == k, _gram_hashes(k)) for k in range(1, SHINGLE + 1)])
    return rows.withColumn("sketch", F.slice(F.array_sort(by_width), 1, F.col("n") - F.col("need") + 1))


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of each document that holds a share of ``least`` or more of an
    item's distinct five-word shingles. Words are compared without case and punctuation.

    A thirty-shingle item in a document of 20,000 words has a Jaccard similarity of .0015, so that signatures of the
    documents don't see it. Here the items carry the MinHash sketch: their smallest shingle hashes, as many as decide
    containment, in partitions by size, each with its own largest sketch hash and least need. A document's shingles are hashed in the scan
    and dropped there if they are over the largest hash of all partitions it is long enough for; the rest probe the sketches.
    Candidates are then verified on the words themselves. Nothing is lost by the search.

    Items of fewer than five words have their whole sequence as shingle; items without words are skipped. Rows without
    doc_id are not searched. Rows that share a doc_id are texts of their own, and so are those of an item_id; the best pair counts.
    Either table may be empty. Sketches and hits are broadcast only if Spark's own size threshold allows it.
    """
    spark = docs.sparkSession
    sketches = stored(_sketches(items, least), scratch_folder(spark, "sketches"))
    probes = sketches.select("item", "width", "partition", "need", F.explode("sketch").alias("u"))
    # a row for each width and power of two of an item's size
    bounds = probes.groupBy("width", "partition").agg(F.max("u").alias("top"), F.min("need").alias("need")).collect()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).filter("doc_id IS NOT NULL")
    # what is used more than once is a column of its own, so that words are cut out of a text once
    split = texts.select("doc_id", "mark", _words(F.col("text")).alias("w")).select("doc_id", "mark", "w", F.size("w").alias("words"))
    words, found = F.col("words"), None
    for width in sorted({row["width"] for row in bounds}):
        own = [row for row in bounds if row["width"] == width]
        top = F.greatest(*[F.when(words >= row["need"] + width - 1, row["top"]).otherwise(-1) for row in own], F.lit(-1))
        hashed = split.select("*", top.alias("top")).select("doc_id", "mark", "words", "top", _shingles("w", width, lambda i, k=width: _hash("w", i, k)).alias("u"))
        low = hashed.select("doc_id", "mark", "words", F.explode(F.filter("u", lambda u: u <= F.col("top"))).alias("u"))
        mine = probes.filter(F.col("width") == width).select("item", "u", "need")
        hits = low.join(mine, "u").filter(F.col("words") >= F.col("need") + width - 1).select("doc_id", "mark", "item").distinct()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shingles int, n_shared int, containment double")
    found = stored(found, scratch_folder(spark, "hits"))  # its size then lets texts stay where they are, if it is small
    spaced = F.concat(F.lit(" "), F.array_join(_words(F.col("text")), " "), F.lit(" ")).alias("spaced")
    pairs = texts.join(found, ["doc_id", "mark"]).join(sketches.select("item", "item_id", "grams", "n", "need"), "item")
    grams = pairs.select("doc_id", "mark", "item", "item_id", "n", "need", spaced, F.explode("grams").alias("gram"))
    grams = grams.filter(F.contains(F.col("spaced"), F.concat(F.lit(" "), "gram", F.lit(" "))))
    counted = grams.groupBy("doc_id", "mark", "item", "item_id", "n", "need").agg(F.count_distinct("gram").cast("int").alias("shared")).filter("shared >= need")
    best = counted.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("containment"), "n", "shared")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").alias("n_shingles"), F.col("b.shared").alias("n_shared"), F.col("b.containment").alias("containment"))
