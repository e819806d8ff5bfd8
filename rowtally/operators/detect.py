"""Key columns found by name, on a frame of column names ``(_file, side, pos, column)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowtally.functions.names import column_score, confidence_band, normalize_column_name, similarity_score

FILE_SIDE = ["_file", "side"]


def score_columns(meta: DataFrame, user: str | None = None, priority: list[str] | None = None) -> DataFrame:
    """Add ``score`` and ``label``."""
    verdict = column_score(F.col("column"), F.col("_n"), F.col("_near"), user, priority)
    steps = meta.withColumn("_n", normalize_column_name(F.col("column")))
    steps = steps.withColumn("_near", similarity_score(F.col("_n"))).withColumn("_v", verdict)
    return steps.select(*meta.columns, F.col("_v.score"), F.col("_v.label"))


def rank_candidates(scored: DataFrame, top: int = 5) -> DataFrame:
    """The best candidates of each file and side: score, then shorter name, then position."""
    order = Window.partitionBy(*FILE_SIDE).orderBy(F.desc("score"), F.length("column"), "pos")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    # names without a score rank last, so they can go after ranking; tested earlier, the test would
    # be pushed into the scan and the score computed twice
    return ranked.filter((F.col("rank") <= top) & (F.col("score") > 0))


def detect_keys(meta: DataFrame, user: str | None = None, priority: list[str] | None = None) -> DataFrame:
    """One key column per file and side that has a candidate, with its confidence band."""
    best = rank_candidates(score_columns(meta, user, priority), 1)
    return best.select(*FILE_SIDE, F.col("column").alias("key"), "score", "label", confidence_band(F.col("score")).alias("confidence_band"))


def pair_keys(detected: DataFrame) -> DataFrame:
    """Both sides' keys in one row per file; the pair is as sure as its weaker side."""
    of = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c))).alias(f"{c}_{n}")
    sides = detected.groupBy("_file").agg(of(1, "key"), of(1, "score"), of(2, "key"), of(2, "score"))
    return (
        sides.filter(F.col("key_1").isNotNull() & F.col("key_2").isNotNull())
        .withColumn("confidence", F.least("score_1", "score_2"))
        .withColumn("confidence_band", confidence_band(F.col("confidence")))
    )


def resolve_keys(
    meta: DataFrame, user: str | None = None, auto_detect: bool = True, priority: list[str] | None = None
) -> DataFrame:
    """Which key each pair uses: ``_file, key_1, key_2, confidence, confidence_band, status, reason``.

    A user-given column present on both sides is taken as is. Otherwise keys are detected, or, with
    detection off, the pair is skipped (column missing) or in error (no column given).
    """
    files = meta.groupBy("_file").agg(
        *[F.coalesce(F.bool_or((F.col("side") == n) & (F.col("column") == F.lit(user))), F.lit(False)).alias(f"_has_{n}")
          for n in (1, 2)]
    )
    given = F.col("_has_1") & F.col("_has_2")
    if auto_detect:
        found = files.join(pair_keys(detect_keys(meta, user, priority)), "_file", "left")
        status = F.when(given | F.col("key_1").isNotNull(), "success").otherwise("skipped")
        reason = F.when(status == "skipped", "no key column detected")
    else:
        found = files
        for c, t in (("key_1", "string"), ("key_2", "string"), ("confidence", "double"), ("confidence_band", "string")):
            found = found.withColumn(c, F.lit(None).cast(t))
        status = F.when(given, "success").otherwise(F.lit("skipped" if user else "error"))
        missing = "key column not found" if user else "no key column given"
        reason = F.when(status != "success", missing)
    pick = lambda c, value: F.when(given, F.lit(value)).otherwise(F.col(c)).alias(c)
    return found.select(
        "_file", pick("key_1", user), pick("key_2", user), pick("confidence", 1.0),
        pick("confidence_band", "detected"), status.alias("status"), reason.alias("reason"),
    )


def detect_pair_keys(spark: SparkSession, columns_1, columns_2, user=None, priority=None):
    """Key names of one pair given its two lists of column names."""
    rows = [("", side, i, c) for side, cols in ((1, columns_1), (2, columns_2)) for i, c in enumerate(cols)]
    meta = spark.createDataFrame(rows, "_file string, side int, pos int, column string")
    found = {r["side"]: r["key"] for r in detect_keys(meta, user, priority).collect()}
    return found.get(1), found.get(2)
