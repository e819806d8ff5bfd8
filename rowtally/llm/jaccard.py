"""Operator 8: n-gram Jaccard join by prefix trees."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtally.llm.components import components
from rowtally.llm.numbering import bucket_count
from rowtally.llm.substrings import _PACKED, _groups, _slots, _to_buckets, _unpack
from rowtally.llm.words import NOT_BLANK, batches_of, mix, words
from rowtally.session import scratch_folder, stored

TREE_ROWS = 192  # sets a prefix tree holds at most, when a group is first dealt out
REST_ROWS = 2048  # the same from either side, when those outside its largest component meet the rest
WIDE = 8  # trees that those may fill before the group is dealt out by segments
SPARE = 4  # segments more than differences, at least
AGREED = 3  # full segments that linked sets of FIRM shingles or more have in common, at least
FIRM = 24
HEAD = 0.35  # share of the order of n-grams that a first look is limited to
_HEAD_END = np.uint64(int(HEAD * 2**64))
_SHORT = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n-word shingles of each text in ascending order, the global order of n-grams, and each text's bounds.

    A text of fewer words has its whole sequence as its only shingle, one without words an empty set.
    """
    w = words(column, NOT_BLANK, lower=True)
    counts = np.diff(w.bounds)
    starts, h = w.windows(n)
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    for size in range(1, n):
        few = np.flatnonzero(counts == size)
        h = np.concatenate([h, mix(w.hash_at(w.bounds[few], size) ^ (_SHORT * np.uint64(size)))])
        text = np.concatenate([text, few])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(counts) + 1))


def set_keys(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, equal for equal sets."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mix(h), mix(h ^ _SHORT))]
    a, b = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
    return a.view(np.int64), b.view(np.int64)


def set_nodes(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A number for each set from its key; ``jaccard_groups`` picks a salt by which no two sets share one."""
    return mix(a.view(np.uint64) ^ mix(b.view(np.uint64) ^ np.uint64(salt))).view(np.int64)


class Sizes:
    """Size classes, and how many segments keep one in common in any linked pair whose smaller set is of a class."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(edges[-1] * 100 // percent + 1)
        self.edges = np.array(edges, np.int64)
        least, most = self.edges[:-1], self.edges[1:] - 1
        self.differences = (100 - percent) * (most + most * 100 // percent) // (100 + percent)
        enough = self.differences + 1
        self.segments = enough + SPARE + np.ceil(2.5 * enough * np.exp(-least / enough)).astype(np.int64)  # more than the empty ones of nearly all sets
        self.agreed = np.where(least >= FIRM, AGREED, 1)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, side="right") - 1

    def first_of(self, n: np.ndarray) -> np.ndarray:
        return self.of(-(-n * self.percent // 100))


def signatures(h: np.ndarray, bounds: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, signature, firm) of the segments of each set: equal segments of two sets of one size class have equal signatures.

    The order of n-grams is cut into as many segments as the class asks for. Each difference of two sets spoils one segment at most, so
    that a set's full segments, less the differences a linked pair can have, are what it has in common with any set linked to it.
    If these are fewer than the class's ``agreed``, its empty segments count as well. So linked sets have ``agreed`` equal
    signatures or more; where that is AGREED they are firm. Sets so small that only equal ones link have none.
    """
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    out_text, out_sig, out_firm = [], [], []
    for step in (0, 1):
        kind = sizes.first_of(n[some]) + step
        kept = (kind <= sizes.of(n[some])) & (sizes.differences[kind] > 0)
        mine, kind = some[kept], kind[kept]
        if not len(mine):
            continue
        pick = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in mine])
        owner = np.repeat(np.arange(len(mine)), n[mine])
        count = sizes.segments[kind].astype(np.uint64)
        segment = ((h[pick] >> np.uint64(32)) * count[owner]) >> np.uint64(32)
        cuts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])])
        total = np.add.reduceat(mix(h[pick]), cuts)
        place = mix((kind[owner[cuts]].astype(np.uint64) << np.uint64(40)) + segment[cuts])
        out_text.append(mine[owner[cuts]])
        out_sig.append(mix(total ^ place))
        out_firm.append(sizes.agreed[kind[owner[cuts]]] == AGREED)
        filled = np.bincount(owner[cuts], minlength=len(mine))
        for i in np.flatnonzero(filled - sizes.differences[kind] < sizes.agreed[kind]):
            own = segment[cuts][owner[cuts] == i]
            empty = np.setdiff1d(np.arange(sizes.segments[kind[i]], dtype=np.uint64), own)
            out_text.append(np.full(len(empty), mine[i]))
            out_sig.append(mix(mix((np.uint64(kind[i]) << np.uint64(40)) + empty)))
            out_firm.append(np.full(len(empty), sizes.agreed[kind[i]] == AGREED))
    if not out_text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(out_text), np.concatenate(out_sig), np.concatenate(out_firm)


class PrefixTree:
    """Ordered n-gram sets as paths of a tree. A branch holds the sets ``lo:hi`` that share its first n-grams.

    ``totals`` are the sets' sizes; a path may hold only the n-grams below some point of the order. Branches are kept level
    by level, so that a set meets all branches of a level at once.
    """

    def __init__(self, sets: list[np.ndarray], totals: np.ndarray, percent: int):
        self.percent = percent
        universe, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        paths = [number[e - len(s):e] for s, e in zip(sets, ends)]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.totals = totals[self.order]
        self.nothing = len(universe)  # stands at the end of each step, so that none is empty
        self.seen = np.zeros(len(universe) + 1, bool)
        shared = np.array([0, *(self._common(a, b) for a, b in zip(self.paths, self.paths[1:]))], np.int64)
        self.levels = []
        branches = [(0, len(sets), 0, 0)]  # lo, hi, depth, parent
        while branches:
            self.levels.append(self._level(branches, shared))
            ends = self.levels[-1]["end"].tolist()
            branches = [
                (a, b, end, i) for i, ((lo, hi, _, _), end) in enumerate(zip(branches, ends)) if hi - lo > 1
                for a, b in itertools.pairwise([lo, *(lo + 1 + np.flatnonzero(shared[lo + 1:hi] == end)).tolist(), hi])]

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _level(self, branches: list[tuple], shared: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi, depth, parent = (np.array(c) for c in zip(*branches))
        end = np.array([int(shared[a + 1:b].min()) if b - a > 1 else len(self.paths[a]) for a, b in zip(lo, hi)])
        steps = [np.append(self.paths[a][d:e], self.nothing) for a, d, e in zip(lo, depth, end)]
        return {
            "lo": lo, "hi": hi, "parent": parent, "end": end, "leaf": hi - lo == 1,
            "last": np.array([self.paths[a][e - 1] if e else -1 for a, e in zip(lo, end)]),
            "steps": np.concatenate(steps), "cuts": np.cumsum([0, *(len(x) for x in steps[:-1])]),
            "longest": np.array([self.totals[a:b].max() for a, b in zip(lo, hi)]), "shortest": np.array([self.totals[a:b].min() for a, b in zip(lo, hi)])}

    def partners(self, part: np.ndarray, probe: np.ndarray, join: bool) -> list[tuple[int, int]]:
        """Pairs of sets (in tree order) of different parts, one of them a probe at least, whose overlap can reach the bound.

        With ``join`` (paths are whole, so that it does) found pairs join their parts, and ``part`` is updated.
        """
        found: list[tuple[int, int]] = []
        for x in np.flatnonzero(probe).tolist():
            wanted = (part != part[x]) & ~probe
            wanted[x + 1:] = part[x + 1:] != part[x]
            if wanted.any():
                found += self._walk(x, np.concatenate([[0], np.cumsum(wanted)]), part, join)
        return found

    def _walk(self, x: int, wanted: np.ndarray, part: np.ndarray, join: bool) -> list[tuple[int, int]]:
        path, total, found = self.paths[x], int(self.totals[x]), []
        self.seen[path] = True
        overlap, alive = np.zeros(1, np.int64), np.ones(1, bool)
        for level in self.levels:
            alive = alive[level["parent"]] & (wanted[level["hi"]] > wanted[level["lo"]])
            if not alive.any():
                break
            overlap = overlap[level["parent"]] + np.add.reduceat(self.seen[level["steps"]], level["cuts"], dtype=np.int64)
            left = total - np.where(level["leaf"], len(path), np.searchsorted(path, level["last"], side="right"))
            needed = -(-self.percent * (total + level["shortest"]) // (100 + self.percent))
            alive &= overlap + np.minimum(left, level["longest"] - level["end"]) >= needed
            for y in level["lo"][alive & level["leaf"]].tolist():
                if not join or part[y] != part[x]:
                    found.append((x, y))
                    if join:
                        part[part == part[y]] = part[x]
            alive &= ~level["leaf"]
        self.seen[path] = False
        return found


def _keys(n: int, salt: int):
    def run(batches):
        for batch in batches_of(batches, "text", 4 << 20):
            h, bounds = shingle_sets(batch.column("text"), n)
            a, b = set_keys(h, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(set_nodes(a, b, salt)), pa.array(a), pa.array(b), pa.array(np.diff(bounds), pa.int64())], ["doc_id", "mark", "node", "k1", "k2", "n"])

    return run


def _segments(n: int, percent: int, buckets: int, salt: int):
    def run(batches):
        sizes = Sizes(percent)
        for batch in batches_of(batches, "text", 8 << 20):
            batch = batch.filter(batch.column("doc_id").is_valid())
            h, bounds = shingle_sets(batch.column("text"), n)
            a, b = set_keys(h, bounds)
            ids = set_nodes(a, b, salt)
            text, sig, _ = signatures(h, bounds, sizes)
            order, group = _groups(ids, b, a)
            same = np.zeros(len(ids), bool)  # copies of a set in this batch: one stands for all
            same[order[1:]] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            text, sig = text[~same[text]], sig[~same[text]]
            if len(sig):
                yield _to_buckets(_slots(sig, buckets), ids[text], (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32), (sig >> np.uint64(56)).astype(np.uint8))

    return run


def _candidates(buckets: int):
    """(doc, leader): sets that share a segment with others, and the smallest node of these; packed by leader."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [_unpack(d, np.uint32, np.uint8) for d in table["data"].to_pylist()]
        doc, low, high = (np.concatenate(c) for c in zip(*parts))
        code = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        order = np.lexsort((doc, code))
        doc, code = doc[order], code[order]
        other = np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])][:len(doc)]  # copies of a set from several batches
        doc, code = doc[other], code[other]
        new = np.r_[True, code[1:] != code[:-1]]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        leader, doc = np.unique(np.stack([doc[new][group][several], doc[several]]), axis=1)
        return pa.table(_to_buckets(mix(leader.astype(np.uint64)).astype(np.int64) % buckets, leader, doc))

    return run


def _distinct_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    leader, doc = (np.concatenate(c) for c in zip(*(_unpack(d, np.int64) for d in table["data"].to_pylist())))
    leader, doc = np.unique(np.stack([leader, doc]), axis=1)
    return pa.table({"doc": doc, "leader": leader})


def _sets(n: int, salt: int):
    """The whole set of a text, and the n-grams in the first HEAD of the order in 32 bits."""

    def run(batches):
        for batch in batches_of(batches, "text", 4 << 20):
            h, bounds = shingle_sets(batch.column("text"), n)
            wanted = set_nodes(*set_keys(h, bounds), salt) == batch.column("doc").to_numpy()
            batch, sizes = batch.filter(pa.array(wanted)), np.diff(bounds)[wanted]
            grams = [h[a:b] for a, b, keep in zip(bounds, bounds[1:], wanted) if keep]
            heads = [(g[g < _HEAD_END] >> np.uint64(32)).astype(np.uint32) for g in grams]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("large"), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array([g.tobytes() for g in heads], pa.binary()), pa.array(sizes, pa.int64())],
                ["doc", "large", "grams", "head", "total"])

    return run


def _screen(percent: int):
    """Which rows of a part have a partner by the heads of their sets; shared hashes only raise an overlap."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree = PrefixTree([np.frombuffer(g, np.uint32) for g in table["head"].to_pylist()], table["total"].to_numpy(), percent)
        part, probe = (table[c].to_numpy()[tree.order] for c in ("component", "probe"))
        pairs = tree.partners(part, probe, join=False)
        rows = np.array(tree.order)[np.unique(np.array(pairs, np.int64).reshape(-1))] if pairs else np.zeros(0, np.int64)
        return table.select(["part", "doc", "component", "probe"]).take(pa.array(rows, pa.int64()))

    return run


def _join_part(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        tree = PrefixTree(sets, np.array([len(s) for s in sets]), percent)
        ids, part, probe = (table[c].to_numpy()[tree.order] for c in ("doc", "component", "probe"))
        links = tree.partners(part, probe, join=True)
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in links], pa.int64()), "b": pa.array([int(ids[y]) for _, y in links], pa.int64())})

    return run


def _linked(sets: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """Links found in each part of ``places`` (doc, part, component, probe): first by the heads of sets, then for what is left by
    whole sets. Places grow with the corpus, so that they are never broadcast, however few they are."""
    spark = sets.sparkSession
    heads = sets.select("doc", "head", "total").join(places.hint("merge"), "doc").select("part", "doc", "component", "probe", "head", "total")
    near = stored(heads.groupBy("part").applyInArrow(_screen(percent), "part string, doc long, component long, probe boolean"), scratch_folder(spark, "near")).distinct()
    whole = sets.select("doc", "grams").join(near.hint("merge"), "doc").select("part", "doc", "component", "probe", "grams")
    return stored(whole.groupBy("part").applyInArrow(_join_part(percent), "a long, b long"), scratch_folder(spark, "links"))


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Texts whose sets of n-word shingles have 100 * intersection >= percent * union are linked; component_id is the
    smallest doc_id reachable, the document's own included. Steps:

    1. Equal sets are one class (128-bit keys), a node of the join whatever doc_ids have it.
    2. N-grams are ordered by hash. That order is cut into segments, more than a linked pair of such sizes can have
       differences, so that linked sets agree on a whole segment. Documents that do are grouped under the smallest of
       them: every linked pair meets in some group, and a phrase that many share doesn't bring them together.
    3. Each group, cut into parts of TREE_ROWS with the leader in all, builds a prefix tree of its ordered sets. A set
       walks it with the overlap of shared paths, leaves branches whose remaining lengths can't reach the bound, and skips
       those it is already joined with. A first tree holds only the n-grams in the first HEAD of the order, which rules
       most others out already; whole sets are sent only for the rest.
    4. Where a group of several parts isn't one component then, those outside its largest component meet all its parts, in trees of
       REST_ROWS from either side, if they fill WIDE at most. A larger group is dealt out again by every segment of its members: linked sets agree on AGREED, so that
       a group's AGREED - 1 commonest segments, which a line that many share makes, can be left out and no link is lost.
    5. Links are a forest per part; their connected components, over the smallest doc_id of each class and with the classes
       of one doc_id linked, give the result.

    Null and empty texts have no shingles and are linked with nothing. Rows without doc_id get no component; rows that share
    a doc_id are compared one by one, share their links and have one component. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    buckets = bucket_count(docs)
    for salt in itertools.count():
        keyed = stored(docs.mapInArrow(_keys(n, salt), "doc_id long, mark long, node long, k1 long, k2 long, n long"), scratch_folder(spark, "sets"))
        some = keyed.filter("n > 0 AND doc_id IS NOT NULL")
        classes = some.groupBy("node", "k1", "k2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
        classes = classes.select("node", "k1", "k2", "n", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"))
        classes = stored(classes, scratch_folder(spark, "classes"))
        if not classes.groupBy("node").count().filter("count > 1").limit(1).count():
            break

    pairs = docs.mapInArrow(_segments(n, percent, buckets, salt), _PACKED).groupBy("bucket").applyInArrow(_candidates(buckets), _PACKED)
    pairs = pairs.groupBy("bucket").applyInArrow(_distinct_pairs, "doc long, leader long")
    groups = stored(pairs.filter("doc <> leader").distinct(), scratch_folder(spark, "groups"))
    sizes = groups.groupBy("leader").agg((F.count(F.lit(1)) + 1).alias("rows")).withColumn("parts", F.ceil(F.col("rows") / TREE_ROWS).cast("int"))
    sizes = stored(sizes, scratch_folder(spark, "group-sizes"))

    part = lambda i, j: F.concat_ws("/", "leader", i, j)
    own = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    members = groups.join(sizes, "leader")
    heads = sizes.select(F.col("leader").alias("doc"), "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    places = members.select("doc", part(F.lit("a"), own).alias("part"), F.col("doc").alias("component"))
    places = places.unionByName(heads.select("doc", part(F.lit("a"), F.col("j")).alias("part"), F.col("doc").alias("component"))).withColumn("probe", F.lit(True))
    both = members.select("doc", "parts").unionByName(sizes.select(F.col("leader").alias("doc"), "parts"))
    both = both.groupBy("doc").agg((F.max("parts") > 1).alias("large"))
    both = both.join(classes.select(F.col("node").alias("doc"), F.col("rep").alias("doc_id"), "mark"), "doc")
    # by the text's hash too, so that the texts of one doc_id don't meet each other's sets; of rows alike one
    texts = docs.join(both.hint("merge"), ["doc_id", "mark"])
    texts = texts.withColumn("_row", F.row_number().over(Window.partitionBy("doc_id", "mark", "doc").orderBy("doc"))).filter("_row = 1")
    sets = texts.select("doc", "large", "text").mapInArrow(_sets(n, salt), "doc long, large boolean, grams binary, head binary, total long")
    folder = scratch_folder(spark, "gram-sets")
    sets.write.partitionBy("large").parquet(folder)
    sets = spark.read.schema("doc long, grams binary, head binary, total long, large boolean").parquet(folder)
    links = _linked(sets, places, percent)

    large = sizes.filter("parts > 1")
    if large.limit(1).count():
        links = links.unionByName(_rest(sets.filter("large"), groups, large, links, percent))

    reps = classes.select("node", "rep")
    for column in ("a", "b"):
        links = links.join(reps.withColumnsRenamed({"node": column, "rep": f"_{column}"}), column).drop(column).withColumnRenamed(f"_{column}", column)
    # a doc_id of several sets links these
    several = some.groupBy("doc_id").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a < _b").select("doc_id")
    links = links.select("a", "b").unionByName(some.join(several, "doc_id").join(reps, "node").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    parts = components(links)
    whole = reps.join(parts, reps["rep"] == parts["node"], "left").select(reps["node"], F.coalesce("component", "rep").alias("component_id"))
    out = keyed.filter("n > 0").join(whole, "node", "left").select("doc_id", "n", "component_id")
    empty = keyed.filter("n = 0").select("doc_id", "n")
    shared = some.join(empty.select("doc_id").distinct(), "doc_id").join(whole, "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = out.unionByName(empty.join(shared, "doc_id", "left"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _open_groups(rows: DataFrame) -> DataFrame:
    """Of rows (key, doc, component) the keys with several components: key, top (the largest), rows, and how many trees all and those outside fill."""
    counts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    tops = counts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.sum("c").alias("rows"), F.max("c").alias("c")).filter("rows > c")
    trees = lambda n: F.ceil(n / REST_ROWS).cast("int")
    return tops.select("key", "top", "rows", trees(F.col("rows")).alias("parts"), trees(F.col("rows") - F.col("c")).alias("outer"))


def _outsiders(rows: DataFrame, groups: DataFrame, label: str) -> DataFrame:
    """Places (doc, part, component, probe) by which those outside a key's largest component meet all rows of the key."""
    rows = rows.join(groups, "key")
    i, j = (F.pmod(F.xxhash64("doc"), F.col(c)).cast("int") for c in ("outer", "parts"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    # outsiders of one tree meet each other as probes already
    inner = rows.filter("component = top OR outer > 1").select("doc", "key", "component", every("outer").alias("i"), j.alias("j"), F.lit(False).alias("probe"))
    outer = rows.filter("component <> top").select("doc", "key", "component", i.alias("i"), every("parts").alias("j"), F.lit(True).alias("probe"))
    return inner.unionByName(outer).select("doc", F.concat_ws("/", "key", F.lit(label), "i", "j").alias("part"), "component", "probe")


def _segment_keys(percent: int):
    """(group, code, firm, doc, component) for each segment of a group's members."""

    def run(batches):
        sizes = Sizes(percent)
        for batch in batches:
            sets = [np.frombuffer(g, np.uint64) for g in batch.column("grams").to_pylist()]
            if not sets:
                continue
            text, sig, firm = signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), sizes)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), pa.array(sig.view(np.int64)), pa.array(firm), batch.column("doc").take(at), batch.column("component").take(at)],
                                             ["group", "code", "firm", "doc", "component"])

    return run


def _rest(sets: DataFrame, groups: DataFrame, large: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links of large groups between documents of different parts and components: step 4 of ``jaccard_groups``."""
    spark = sets.sparkSession
    parts = components(links).withColumnRenamed("node", "doc")
    heads = large.select(F.col("leader").alias("doc"), F.col("leader").alias("key"))
    rows = groups.join(large.select("leader"), "leader").select("doc", F.col("leader").alias("key")).unionByName(heads)
    rows = rows.join(parts, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    rows = stored(rows, scratch_folder(spark, "large-groups"))
    found = stored(_open_groups(rows), scratch_folder(spark, "open-groups"))
    places = _outsiders(rows, found.filter(F.col("outer") <= WIDE), "b")
    wide = found.filter(F.col("outer") > WIDE).select("key")
    if wide.limit(1).count():
        members = sets.select("doc", "grams").join(rows.join(wide, "key").hint("merge"), "doc")
        keys = members.select("key", "doc", "component", "grams").mapInArrow(_segment_keys(percent), "group long, code long, firm boolean, doc long, component long")
        keys = stored(keys, scratch_folder(spark, "segments"))
        counts = keys.groupBy("group", "code").agg(
            F.count(F.lit(1)).alias("n"), F.bool_and("firm").alias("firm"), F.min("doc").alias("leader"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        counts = stored(counts.filter("lo < hi"), scratch_folder(spark, "segment-counts"))
        common = counts.filter(f"firm AND n > {REST_ROWS}")
        most = common.groupBy("group").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "code")), False), 1, AGREED - 1).alias("codes"))
        left = counts.select("group", "code", "leader").join(most.select("group", F.explode("codes.code").alias("code")), ["group", "code"], "left_anti")
        # members that share many segments meet once, under the smallest that shares any
        again = keys.join(left, ["group", "code"]).select(F.xxhash64("group", "leader").alias("key"), "doc", "component").distinct()
        again = stored(again, scratch_folder(spark, "segment-groups"))
        places = places.unionByName(_outsiders(again, _open_groups(again), "c"))
    return _linked(sets, places, percent)
