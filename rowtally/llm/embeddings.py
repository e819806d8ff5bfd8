"""Operator 9: near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtally.llm.components import components, local_forest
from rowtally.session import scratch_folder, stored

BLOCKS, LEAST_DIMENSIONS = 2, 8  # blocks of a vector, and the dimensions that each has at least
GROUP_VALUES = 1 << 22  # components of the vectors that a task holds from either side, at most
LEAST_ROWS = 1024
SIDE_GROUPS = 8  # groups that a unit of work takes from either side, at most
UNIT_PAIRS = 1 << 33  # pairs of vectors that a task compares, about
MOST_TASKS = 20_000
TILE = (256, 512)  # vectors of either side that are compared by one product
MANY = 4096  # pairs of a tile that are verified by one product rather than singly
SLACK = 1e-4  # by which products of float32 may miss a squared distance
LINKS = "node long, links long, root long"


def rotation(dimensions: int) -> np.ndarray:
    """A fixed orthogonal matrix: spreads a vector's length evenly over its blocks."""
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def blocks(dimensions: int) -> list[slice]:
    size = max(LEAST_DIMENSIONS, -(-dimensions // BLOCKS))
    return [slice(i, min(i + size, dimensions)) for i in range(0, dimensions, size)]


def usable() -> Column:
    """Whether a row has a vec_id and a vector that is finite in every component and not zero."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(v))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0) & F.col("vec_id").isNotNull(), F.lit(False))


def _write_vectors(folder: str):
    """Writes the classes' vectors and weights into files of one dimension, GROUP_VALUES components each, and returns the
    classes without their vectors: a vector's number tells its place. Every task attempt writes under names of its own,
    and only those of attempts that succeeded are in the stored table."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        node, waiting, held = TaskContext.get().partitionId() << 40, {}, 0

        def written(d: int, parts: list) -> pa.RecordBatch:
            nonlocal node
            name, rows = uuid.uuid4().hex, pa.Table.from_batches([p for p, _ in parts])
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for _, x in parts:
                    out.write(x)
                out.write(np.ascontiguousarray(rows["_n"].to_numpy()))
            first, node, n = node, node + len(rows), len(rows)
            made = {"node": np.arange(first, node), "_d": np.full(n, d, np.int32), "file": np.full(n, name), "wide": np.full(n, parts[0][1].itemsize == 8)}
            columns = [rows[c].combine_chunks() for c in ("_a", "_b", "rep", "_n")] + [pa.array(v) for v in made.values()]
            return pa.RecordBatch.from_arrays(columns, ["_a", "_b", "rep", "_n", *made])

        for batch in batches:
            sizes = batch.column("_d").to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                x = part.column("embedding").flatten()
                x = x.to_numpy(zero_copy_only=False) if pa.types.is_float32(x.type) else x.cast(pa.float64()).to_numpy(zero_copy_only=False)
                waiting.setdefault(d, []).append((part.drop_columns("embedding"), np.ascontiguousarray(x)))
                held += len(x)
                if held >= GROUP_VALUES:
                    yield from (written(*w) for w in waiting.items())
                    waiting, held = {}, 0
        yield from (written(*w) for w in waiting.items())

    return run


def _groups(files: list, most: int) -> dict[int, list[list[tuple]]]:
    """By dimension lists of about equal groups. A group is a list of (file, its rows, first row, end, number of row 0, wide)."""
    out: dict[int, list[list[tuple]]] = {}
    for d in sorted({f["_d"] for f in files}):
        own = sorted((f for f in files if f["_d"] == d), key=lambda f: f["node"])
        total = sum(f["n"] for f in own)
        rows = min(max(LEAST_ROWS, -(-total // most)), max(1, GROUP_VALUES // d))
        groups, room = [[]], rows
        for f in own:
            at = 0
            while at < f["n"]:
                if not room:
                    groups.append([])
                    room = rows
                end = min(f["n"], at + room)
                groups[-1].append((f["file"], f["n"], at, end, f["node"], f["wide"]))
                room -= end - at
                at = end
        out[d] = groups
    return out


class _Group:
    """The vectors of a group: numbers, weights, unit vectors, and for each block both factors of the squared distances."""

    def __init__(self, store, root: str, group: list[tuple], d: int):
        x, ids, weight = [], [], []
        for name, rows, at, end, first, wide in group:
            kind = np.dtype(np.float64 if wide else np.float32)
            with store.open_input_file(f"{root}/{name}") as f:
                x.append(np.frombuffer(f.read_at((end - at) * d * kind.itemsize, at * d * kind.itemsize), kind).reshape(-1, d))
                weight.append(np.frombuffer(f.read_at((end - at) * 8, rows * d * kind.itemsize + at * 8), np.int64))
            ids.append(np.arange(first + at, first + end))
        self.ids, self.weight = np.concatenate(ids), np.concatenate(weight)
        x = np.concatenate(x).astype(np.float64)
        with np.errstate(all="ignore"):
            self.unit = x / np.linalg.norm(x, axis=1)[:, None]
        self.unit[~np.isfinite(self.unit).all(1)] = 0  # a length out of double's range; these have no links
        turned = (self.unit @ rotation(d)).astype(np.float32)
        self.factors, one = [], np.ones((len(x), 1), np.float32)
        for where in blocks(d):
            low = turned[:, where]
            square = (low ** 2).sum(1)[:, None]
            subtrahend = np.hstack([low, one, square])
            self.factors.append((np.hstack([-2 * low, square, one]), [np.ascontiguousarray(subtrahend[c:c + TILE[1]].T) for c in range(0, len(x), TILE[1])]))


def _linked(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of a[i] and b[j] is ``least`` or more."""
    return np.einsum("ij,ij->i", a[i], b[j]) >= least


def _linked_in_tile(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """The same for many pairs of few vectors: by one product, but for cosines close to ``least``."""
    cosine = (a @ b.T)[i, j]
    near, close = cosine >= least, np.flatnonzero(np.abs(cosine - least) < 1e-9)
    near[close] = _linked(a, b, i[close], j[close], least)
    return near


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        above = parent[x]
        if (above == x).all():
            return x
        x = above


def _join_groups(a: _Group, b: _Group, least: float, shares: list[float], links_a: np.ndarray, links_b: np.ndarray, parent: np.ndarray, at_a: int, at_b: int) -> None:
    """Adds the links of two groups, or of one with itself (a is b), each pair once. ``parent`` is a forest over places:
    at_a and at_b are those of the groups' first vectors."""
    high, wide = TILE
    distance, within = np.empty(high * wide, np.float32), np.empty(high * wide, bool)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def add(i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(links_a, i, b.weight[j])
        np.add.at(links_b, j, a.weight[i])
        x, y = _roots(parent, at_a + i), _roots(parent, at_b + j)
        apart = x != y
        node, root = local_forest(x[apart], y[apart])
        parent[node] = root
        parent[at_a + i], parent[at_b + j] = parent[x], parent[y]

    def add_waiting() -> None:
        i, j = map(np.concatenate, zip(*waiting))
        near = _linked(a.unit, b.unit, i, j, least)
        add(i[near], j[near])

    for r in range(0, len(a.ids), high):
        end = min(r + high, len(a.ids))
        for t in range(r // wide if a is b else 0, -(-len(b.ids) // wide)):
            c, n = t * wide, min(wide, len(b.ids) - t * wide)
            d2, hits = distance[:(end - r) * n], []
            for (minuend, _), (_, subtrahends), share in zip(a.factors, b.factors, shares):
                np.matmul(minuend[r:end], subtrahends[t], out=d2.reshape(end - r, n))
                if d2.min() <= share:
                    hits.append(np.flatnonzero(np.less_equal(d2, share, out=within[:len(d2)])))
            if not hits:
                continue
            i, j = np.divmod(hits[0] if len(hits) == 1 else np.unique(np.concatenate(hits)), n)
            if a is b:
                i, j = i[r + i < c + j], j[r + i < c + j]
            if len(i) > MANY:
                near = _linked_in_tile(a.unit[r:end], b.unit[c:c + n], i, j, least)
                add(r + i[near], c + j[near])
            else:
                waiting.append((r + i, c + j))
                held += len(i)
                if held > MANY:
                    add_waiting()
                    waiting, held = [], 0
    if waiting:
        add_waiting()


def _side(groups: int) -> int:
    return min(SIDE_GROUPS, max(1, groups // 32))


def _units(groups: list) -> int:
    n = -(-len(groups) // _side(len(groups)))
    return n * (n + 1) // 2


def _join_units(folder: str, groups: dict[int, list[list[tuple]]], least: float):
    """Unit k takes runs of groups p <= q of one dimension, k = q * (q + 1) / 2 + p, and returns the nodes that have
    links there: how many, and the root of each in a spanning forest."""
    whole, starts = 2 - 2 * least, np.cumsum([0, *(_units(g) for g in groups.values())])

    def unit(store, root: str, k: int) -> pa.RecordBatch:
        which = int(np.searchsorted(starts, k, side="right")) - 1
        d, own = list(groups.items())[which]
        k -= int(starts[which])
        q = (math.isqrt(8 * k + 1) - 1) // 2
        side = _side(len(own))
        runs = [range(p * side, min((p + 1) * side, len(own))) for p in (k - q * (q + 1) // 2, q)]
        shares = [np.float32(whole * (b.stop - b.start) / d + SLACK) for b in blocks(d)]
        places, total = {}, 0
        for g in sorted({*runs[0], *runs[1]}):
            places[g] = total
            total += sum(end - at for _, _, at, end, _, _ in own[g])
        links, parent, ids = np.zeros(total, np.int64), np.arange(total), np.empty(total, np.int64)
        for g in runs[0]:
            a = _Group(store, root, own[g], d)
            for h in runs[1]:
                if h < g:
                    continue
                b = a if h == g else _Group(store, root, own[h], d)
                for x, at in ((a, places[g]), (b, places[h])):
                    ids[at:at + len(x.ids)] = x.ids
                mine, other = (links[at:at + len(x.ids)] for x, at in ((a, places[g]), (b, places[h])))
                _join_groups(a, b, least, shares, mine, other, parent, places[g], places[h])
        some = np.flatnonzero(links)
        root = _roots(parent, some)
        if runs[0] != runs[1]:  # a tree of q's own, so that units of the same q repeat its edges, which are then one; its first node leads to p
            late = some >= places[runs[1][0]]
            _, first, tree = np.unique(root[late], return_index=True, return_inverse=True)
            head = some[late][first][tree]
            root[late] = np.where(some[late] == head, root[late], head)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root])], ["node", "links", "root"])

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield unit(store, root, k)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Unit vectors of cosine ``least`` or more are at most 2 - 2 * least apart, squared. After a rotation they are cut into
    two blocks; one block then stays within its proportional share of that budget. Pairs that stay within it in a block are
    verified by the exact cosine. Every pair is compared, so that time is quadratic in the number of distinct vectors.
    Equal vectors, known by 128 bits, are joined once and weighted.

    Vectors are shuffled once and written once, into files below ``spark.checkpoint.dir``. Tasks read pairs of groups from
    these, so that no vector is copied on disk, and return link counts and a spanning forest, never pairs.

    Vectors that are null, zero or not finite, and rows without vec_id, have no links and are their own component.
    Vectors of different dimensions never link. Every row is a vector of its own, also where several share a vec_id; an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding")
    good = vectors.filter(usable()).withColumns({"_a": F.xxhash64("embedding"), "_b": F.xxhash64(F.lit(11), "embedding")})
    classes = good.groupBy("_a", "_b").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("_n"), F.first("embedding").alias("embedding"))
    classes = classes.withColumn("_d", F.size("embedding"))
    folder = scratch_folder(spark, "vectors")
    kind = classes.schema["rep"].dataType.simpleString()
    classes = classes.mapInArrow(_write_vectors(folder), f"_a long, _b long, rep {kind}, _n long, node long, _d int, file string, wide boolean")
    classes = stored(classes, scratch_folder(spark, "vector-classes"))
    files = classes.groupBy("file", "_d", "wide").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    tasks = 3 * spark.sparkContext.defaultParallelism
    groups = _groups([f.asDict() for f in files.collect()], math.isqrt(4 * tasks) + 1)
    units = sum(map(_units, groups.values()))
    pairs = sum(sum(end - at for g in own for _, _, at, end, _, _ in g) ** 2 // 2 for own in groups.values())
    tasks = max(1, min(units, MOST_TASKS, max(tasks, pairs // UNIT_PAIRS)))
    found = spark.range(0, units, 1, tasks).mapInArrow(_join_units(folder, groups, least), LINKS)
    found = stored(found, scratch_folder(spark, "links"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found, "node", "root")
    least_ids = parts.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    names = parts.join(least_ids, "component").select("node", "component_id")
    joined = classes.select("_a", "_b", "rep", "_n", "node").join(links, "node", "left").join(names, "node", "left")
    known = good.select("vec_id", "_a", "_b").join(joined, ["_a", "_b"]).select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("_n") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    alone = vectors.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
