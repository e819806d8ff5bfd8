"""The run log as a table: one row per event of a pair, filtered and counted like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Event categories.
CATEGORIES = ["INFO", "WARN", "ERROR", "MATCH", "MISS", "DEBUG", "SUCCESS", "STAT", "DETECT", "SKIP"]

LOW_CONFIDENCE = 0.7


def run_log(pair_summary: DataFrame, confidence: DataFrame | None = None, repairs: DataFrame | None = None) -> DataFrame:
    """Events of every pair: ``time, category, file, message``, made from its summary row.

    ``confidence(_file, confidence)`` adds a warning for pairs whose key was guessed weakly, ``repairs(_file, side)`` one for
    records that were repaired.
    """
    pairs = pair_summary
    if confidence is None:
        pairs = pairs.withColumn("confidence", F.lit(None).cast("double"))
    else:
        pairs = pairs.join(confidence.select("_file", "confidence"), "_file", "left")
    for side in ("rejects_1", "rejects_2"):  # only folders have records that do not parse
        if side not in pairs.columns:
            pairs = pairs.withColumn(side, F.lit(0).cast("bigint"))
    mended = [f"_repairs_{s}" for s in (1, 2)]
    if repairs is None:
        pairs = pairs.withColumns({c: F.lit(0).cast("bigint") for c in mended})
    else:
        pairs = pairs.join(repairs.groupBy("_file").agg(*[F.count_if(F.col("side") == s).alias(c) for s, c in enumerate(mended, 1)]), "_file", "left")
    status = F.col("status")
    ok = status == "success"
    say = lambda pattern, *cols: F.format_string(pattern, *[F.col(c) for c in cols])
    surplus = F.col("common_duplicates_1") + F.col("common_duplicates_2")
    events = [
        ("INFO", F.lit(True), F.lit("pair found")),
        ("MATCH", ok, say("key columns: %s | %s", "key_1", "key_2")),
        ("WARN", ok & (F.col("key_1") != F.col("key_2")), F.lit("the sides use different key columns")),
        ("WARN", F.col("confidence") < LOW_CONFIDENCE, say("low key confidence: %.2f", "confidence")),
        ("WARN", F.col("rejects_1") + F.col("rejects_2") > 0, say("records that do not parse: %d | %d", "rejects_1", "rejects_2")),
        ("WARN", F.col(mended[0]) + F.col(mended[1]) > 0, say("records repaired: %d | %d", *mended)),
        ("STAT", ok, say("rows %d | %d, keys %d | %d", "rows_1", "rows_2", "keys_1", "keys_2")),
        ("MATCH", ok, say("%d keys on both sides", "common")),
        ("MISS", ok & (F.col("only_1") + F.col("only_2") > 0), say("only in 1: %d, only in 2: %d", "only_1", "only_2")),
        ("DEBUG", ok & (surplus > 0), say("repeated keys: %d | %d, first row kept", "common_duplicates_1", "common_duplicates_2")),
        ("SUCCESS", ok, say("%d differences in %d columns", "total_differences", "columns_compared")),
        ("SKIP", status == "skipped", F.col("reason")),
        ("ERROR", status == "error", F.col("reason")),
        ("WARN", status == "unpaired", F.col("reason")),
    ]
    entries = [
        F.when(condition, F.struct(F.lit(c).alias("category"), message.alias("message")))
        for c, condition, message in events
    ]
    return (
        pairs.select("_file", F.inline(F.array(*entries)))
        .filter(F.col("category").isNotNull())
        .select(F.current_timestamp().alias("time"), "category", F.col("_file").alias("file"), "message")
    )


def filter_log(log: DataFrame, categories=None) -> DataFrame:
    return log.filter(F.col("category").isin(list(categories))) if categories else log


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("category").agg(F.count("*").alias("events"))
