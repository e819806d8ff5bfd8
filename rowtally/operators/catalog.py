"""The catalogue: projects, sites and channels from landed JSON responses, and channel pairing.

Responses come as text, one response per row (``read_responses``), so a landing folder of any number of
responses is one job. ``response`` tells responses apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_PROJECTS = "success boolean, Projects array<struct<id: string, name: string>>"
_SITES = "success boolean, Sites array<struct<id: string, title: string, name: string, status: string>>"
_CHANNELS = "success boolean, Channels array<string>"


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """``response, body`` of landed JSON files."""
    text = spark.read.text(folder, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("response"), F.col("value").alias("body"))


def _items(responses: DataFrame, schema: str, field: str) -> DataFrame:
    """The list of every successful response, with positions."""
    parsed = responses.select("response", F.from_json("body", schema).alias("r")).filter(F.col("r.success"))
    return parsed.select("response", F.posexplode(F.col(f"r.{field}")).alias("pos", "item"))


def projects(responses: DataFrame) -> DataFrame:
    return _items(responses, _PROJECTS, "Projects").select("response", "item.id", "item.name")


def sites(responses: DataFrame, only_active: bool = False) -> DataFrame:
    """Sites of each response, the first of those with one id; title, else name, else ``Site_<id>``."""
    listed = _items(responses, _SITES, "Sites").select("response", "pos", "item.*")
    if only_active:
        listed = listed.filter(F.col("status") == "active")
    first = Window.partitionBy("response", "id").orderBy("pos")
    shown = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("name"), F.concat(F.lit("Site_"), F.col("id")))
    return (
        listed.withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .select("response", "id", shown.alias("name"), F.coalesce("status", F.lit("unknown")).alias("status"))
    )


def feed_link(channel: Column) -> Column:
    """Link of destination "2" of a channel (JSON text): the first of a list, or the text; else ''."""
    v = F.try_parse_json(channel)
    whole, first = '$.feed_destinations["2"]', '$.feed_destinations["2"][0]'
    kind = F.schema_of_variant(F.try_variant_get(v, whole, "variant"))
    link = F.when(kind.like("ARRAY%"), F.try_variant_get(v, first, "string")).otherwise(F.try_variant_get(v, whole, "string"))
    return F.coalesce(link, F.lit(""))


def channels(responses: DataFrame) -> DataFrame:
    """``response, pos, name, link`` of every channel."""
    listed = _items(responses, _CHANNELS, "Channels")
    return listed.select("response", "pos", F.get_json_object("item", "$.name").alias("name"), feed_link(F.col("item")).alias("link"))


def match_channels(channels_1: DataFrame, channels_2: DataFrame) -> DataFrame:
    """Channels of both sites whose names agree but for case; of equal names the last listed counts, in the order of ``response``
    (where there is one), then ``pos``."""

    def last(df: DataFrame, n: int) -> DataFrame:
        listed = [c for c in ("response", "pos", "name", "link") if c in df.columns]
        order = Window.partitionBy("_name").orderBy(*[F.desc(c) for c in listed])
        named = df.select(F.lower("name").alias("_name"), *listed, F.col("name").alias(f"name_{n}"), F.col("link").alias(f"link_{n}"))
        return named.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", *listed)

    both = last(channels_1, 1).join(last(channels_2, 2), "_name")
    return both.select(F.col("_name").alias("match_name"), F.col("name_1").alias("channel"), "link_1", "link_2")


def select_channels(matched: DataFrame, selection: DataFrame) -> DataFrame:
    """Keep the channels named in ``selection(channel)``."""
    return matched.join(selection.select("channel"), "channel", "left_semi")


def feed_file_name(channel: Column, link: Column) -> Column:
    """``<channel><suffix of the link>``, ``.csv`` without one; null for an empty link."""
    ext = F.regexp_extract(F.substring_index(link, "?", 1), r"[^/](\.[^./]+)$", 1)
    return F.when(link != "", F.concat(channel, F.when(ext == "", ".csv").otherwise(ext)))


def channel_files(matched: DataFrame) -> DataFrame:
    """Files of the channels that have a link on both sides, and the display name of each baseline file."""
    named = matched.select(
        "channel", feed_file_name(F.col("channel"), F.col("link_1")).alias("file_1"),
        feed_file_name(F.col("channel"), F.col("link_2")).alias("file_2"),
    )
    return named.filter(F.col("file_1").isNotNull() & F.col("file_2").isNotNull())


def display_names(matched: DataFrame) -> DataFrame:
    """``_file, display`` for the roll-ups and the report."""
    return channel_files(matched).select(F.col("file_1").alias("_file"), F.col("channel").alias("display"))
