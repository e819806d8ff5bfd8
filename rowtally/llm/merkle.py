"""Operator 11: a Merkle tree over records, built and proved block by block from levels kept as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtally.llm.numbering import in_order
from rowtally.session import scratch_folder, stored

DIGEST = 64  # hex digits of a digest
BLOCK_NODES = 256  # nodes of a block's lowest level, at most
PROOF = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its UTF-8 length, so that neighbours can't be shifted into each other; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _parents(level: Column, fanout: int) -> Column:
    """The level above: every ``fanout`` digests that follow each other, hashed; the last run may be shorter."""
    width = DIGEST * fanout
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / width).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "").cast("binary")


def _height(n: Column, fanout: int, depth: int) -> Column:
    """Levels above the lowest until one node is left, ``depth`` at most."""
    return sum((F.when(n > fanout ** k, 1).otherwise(0) for k in range(depth)), F.lit(0))


def _blocks(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Aligned blocks of nodes (g, pos, n, digest, item): their levels, each one string of digests, and the node on top.

    Levels are kept as bytes of hex text: a substring of bytes is found by its offset, one of text by counting.
    """
    block = F.expr(f"pos DIV {fanout ** depth}").alias("block")
    rows = nodes.groupBy("g", block).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "item"))).alias("nodes"), F.max("n").alias("n"))
    lowest = F.array_join(F.transform("nodes", lambda x: x["digest"]), "").cast("binary")
    height = _height(F.col("n"), fanout, depth)
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array(lowest), lambda found, _: F.array_append(found, _parents(F.element_at(found, F.lit(-1)), fanout)))
    return rows.withColumn("levels", levels).withColumn("top", F.element_at("levels", -1).cast("string"))


def _climb(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """Layers of blocks, each stored: the tops of one layer's blocks are the nodes of the next, until every group has one block."""
    layers, span = [], fanout ** depth
    while True:
        layers.append(stored(_blocks(nodes, fanout, depth), scratch_folder(nodes.sparkSession, "merkle")))
        if not layers[-1].filter(F.col("n") > span).limit(1).count():
            return layers
        nodes = layers[-1].select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / span).alias("n"), F.col("top").alias("digest"), F.lit(0).alias("item"))


def _siblings(place: Column, fanout: int, depth: int) -> Column:
    """For each level of a block what stands left and right of a node in its run, as substrings of that level."""
    powers = F.array(*[F.lit(fanout ** k) for k in range(depth)])

    def at(k: Column) -> Column:
        node = F.floor(place / F.element_at(powers, k + 1)).cast("int")
        run, level = F.floor(node / fanout).cast("int") * fanout, F.element_at("levels", k + 1)
        left = F.substring(level, run * DIGEST + 1, (node - run) * DIGEST).cast("string")
        right = F.substring(level, (node + 1) * DIGEST + 1, (run + fanout - 1 - node) * DIGEST).cast("string")
        return F.struct(left.alias("left"), right.alias("right"))

    last = F.size("levels") - 2
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast(PROOF))


def _descend(layers: list[DataFrame], above: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Nodes of the lowest layer with their proofs. ``above`` (g, block, proof, ...) is what lies over the last layer's blocks."""
    kept = [c for c in above.columns if c not in ("g", "block", "proof")]
    for layer in reversed(layers):
        first = F.col("block") * fanout ** depth
        own = F.transform("nodes", lambda x: F.struct(x["pos"].alias("pos"), x["digest"].alias("digest"), x["item"].alias("item"), _siblings(x["pos"] - first, fanout, depth).alias("own")))
        rows = layer.join(above, ["g", "block"]).select("g", "proof", *kept, F.explode(own).alias("x"))
        nodes = rows.select("g", F.col("x.pos").alias("pos"), F.col("x.digest").alias("digest"), F.col("x.item").alias("item"), F.concat("x.own", "proof").alias("proof"), *kept)
        above = nodes.select("g", F.col("pos").alias("block"), "proof", *kept)
    return nodes


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has by its proof."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def siblings_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def prove(records: DataFrame, group: str, order: str, leaf: str, fanout: int = 2) -> DataFrame:
    """All columns of ``records``, and subroot, root and proof: for each level up to the root its siblings left and right.

    In each group the leaves stand in ascending ``order``; equal ones by their digest. As long as several nodes are left, each
    ``fanout`` that follow each other (the last may be fewer, even one) are hashed to one; what is left is the group's subroot,
    a lone leaf itself. The subroots, in the order of their groups' UTF-8 bytes and null first, give the root in the same way.

    Leaves are gathered in aligned blocks of BLOCK_NODES at most, whatever share of rows a group has. A block keeps every level as
    one string; parents and siblings are substrings at fixed places. The tops of blocks are the leaves of the next layer, so
    that tables shrink by the block's size in each, and the proofs are put together on the way back down.

    Null order keys come first, rows alike in all columns are leaves of their own, and an empty table gives an empty result.
    Group, order and leaf may have any name; the names of what is added are replaced.
    """
    spark = records.sparkSession
    depth = 1
    while fanout ** (depth + 1) <= BLOCK_NODES:
        depth += 1
    rest = [c for c in records.columns if c.lower() not in ("subroot", "root", "proof")]
    # a null group comes first and differs from an empty one
    g = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    item = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    rows = stored(records.select(g.alias("g"), F.col(order).alias("key"), F.col(leaf).alias("digest"), item.alias("item")), scratch_folder(spark, "leaves"))
    groups = _climb(in_order(rows, "g", ["key", "digest"]), fanout, depth)
    tops = groups[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("top").alias("digest"), F.col("g").alias("item"))
    whole = _climb(in_order(stored(tops, scratch_folder(spark, "subroots")), "g", ["key"]), fanout, depth)
    root = whole[-1].select("g", "block", F.array().cast(PROOF).alias("proof"), F.col("top").alias("root"))
    above = _descend(whole, root, fanout, depth)
    above = above.select(F.col("item").alias("g"), F.lit(0).cast("long").alias("block"), "proof", F.col("digest").alias("subroot"), "root")
    leaves = _descend(groups, stored(above, scratch_folder(spark, "subroot-proofs")), fanout, depth)
    return leaves.select(*[F.col(f"item.c{i}").alias(c) for i, c in enumerate(rest)], "subroot", "root", "proof")
