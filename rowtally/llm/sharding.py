"""Operator 3: rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtally.llm.numbering import numbered

PARTS = 1024


def unit_hash(key: Column, salt: str) -> Column:
    """A number between 0 and 1, both excluded, from the MD5 of key and salt: 52 bits, the same in every engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(salt)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard whose score -weight / ln(hash(key, shard)) is the largest.

    A shard's score doesn't depend on the others, so that a new shard only takes keys and a removed one only gives them.
    Null keys count as the empty key. Shards of weight 0 or less get nothing.
    """
    scores = [F.struct((F.lit(-float(w)) / F.log(unit_hash(key, str(s)))).alias("score"), F.lit(s).alias("shard"))
              for s, w in sorted(weights.items()) if w > 0]
    return F.array_max(F.array(*scores))["shard"]


def shard_by_key(df: DataFrame, key: str, weights: dict[int, float], grown: dict[int, float] | None = None) -> DataFrame:
    """Adds ``shard``, ``slot`` (gapless from 0 in each shard) and, with ``grown`` weights, ``grown_shard``.

    Repeated keys share a shard and get slots of their own. A shard may hold any share of the rows: slots are numbered
    in PARTS hash parts per shard. An empty table gives an empty result.
    """
    out = df.withColumn("shard", rendezvous(F.col(key), weights))
    out = out.withColumn("grown_shard", rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int"))
    part = F.floor(unit_hash(F.col(key), "slot") * PARTS).cast("int")
    return numbered(out, ["shard"], part, [key], "slot")


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
