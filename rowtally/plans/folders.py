"""Compare two folders of feeds: all pairs of one shape are one plan, told apart by ``_file``."""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtally.operators import compare, detect, rollup, runlog
from rowtally.plans.reconcile import COLUMN_STATS, DIFF_CELLS, OUTCOME, PAIR_SUMMARY, Reconciliation
from rowtally.functions.values import name
from rowtally.session import scratch_folder, size_shuffles, stored, working_session
from rowtally.sources.listing import feed_paths
from rowtally.sources.scan import scan_folder

MISSING_KEYS = "_file string, missing_in string, sku string, raw_sku string"


class FolderComparison:
    """Result frames over all pairs. Differences of pairs of different shapes are stacked."""

    def __init__(self, spark, parts: list[Reconciliation], other_pairs: list[dict], confidence: list[tuple], faulty):
        self.spark, self.parts = spark, parts
        self._other, self._confidence, self._faulty = other_pairs, confidence, faulty

    def _stack(self, frames, schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames, self.spark.createDataFrame([], schema))

    def materialize(self) -> FolderComparison:
        for p in self.parts:
            p.materialize()
        return self

    @property
    def column_stats(self) -> DataFrame:
        return self._stack([p.column_stats for p in self.parts], COLUMN_STATS)

    @property
    def diff_cells(self) -> DataFrame:
        return self._stack([p.diff_cells for p in self.parts], DIFF_CELLS)

    @property
    def missing_keys(self) -> DataFrame:
        return self._stack([p.missing_keys for p in self.parts], MISSING_KEYS)

    @property
    def key_presence(self) -> DataFrame:
        return self._stack([p.key_presence for p in self.parts], "_file string, sku string, presence string")

    @property
    def rejects(self) -> DataFrame | None:
        """``_file, side, record, parsed`` of records that do not parse; ``None`` if there can be none."""
        return None if self._faulty is None else self._faulty.filter("NOT repaired").drop("repaired")

    @property
    def repairs(self) -> DataFrame | None:
        """The same of records that parse after a repair of their markup. They are compared like others."""
        return None if self._faulty is None else self._faulty.filter("repaired").drop("repaired")

    @property
    def pair_summary(self) -> DataFrame:
        """Compared pairs, and those skipped, in error or without a partner, with the reason."""
        other = self.spark.createDataFrame(self._other, PAIR_SUMMARY)
        pairs = reduce(DataFrame.unionByName, [p.pair_summary for p in self.parts], other)
        if self.rejects is None:
            return pairs.withColumns({c: F.lit(0).cast("bigint") for c in ("rejects_1", "rejects_2")})
        found = self.rejects.groupBy("_file").agg(*[F.count_if(F.col("side") == s).alias(f"_rejects_{s}") for s in (1, 2)])
        counts = [F.coalesce(f"_rejects_{s}", F.lit(0)).alias(f"rejects_{s}") for s in (1, 2)]
        return pairs.join(found, "_file", "left").select(*pairs.columns, *counts)

    @property
    def pair_outcomes(self) -> DataFrame:
        other = self.spark.createDataFrame(self._other, PAIR_SUMMARY).select(*OUTCOME)
        return reduce(DataFrame.unionByName, [p.pair_outcomes for p in self.parts], other)

    @cached_property
    def confidence(self) -> DataFrame:
        return self.spark.createDataFrame(self._confidence, "_file string, confidence double, confidence_band string")

    @property
    def diff_preview(self) -> DataFrame:
        return compare.diff_preview(self.diff_cells)

    @property
    def overall_stats(self) -> DataFrame:
        return rollup.overall_stats(self.column_stats)

    def channel_stats(self, names: DataFrame | None = None) -> DataFrame:
        return rollup.channel_stats(self.column_stats, names)

    @property
    def run_summary(self) -> DataFrame:
        return rollup.run_summary(self.pair_outcomes, self.overall_stats)

    @property
    def run_log(self) -> DataFrame:
        return runlog.run_log(self.pair_summary, self.confidence, self.repairs)


def _stem(file: str) -> str:
    return file.rsplit(".", 1)[0]


def _land(spark, df: DataFrame, columns: list[str]) -> DataFrame:
    """Parse the text once: the needed columns go to a table that every later pass reads."""
    # positions stand for names, which may hold characters a file format does not take
    kept = df.select("_file", "_ord", *[name(c).alias(f"c{i}") for i, c in enumerate(columns)])
    landed = stored(kept, scratch_folder(spark, "feeds"))
    return landed.select("_file", "_ord", *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def _faulty(spark, scans, pair_by_stem: bool, land: bool) -> DataFrame | None:
    """``_file, side, record, parsed, repaired`` of records that did not parse."""
    found = [r.withColumn("side", F.lit(n)) for n, s in enumerate(scans, 1) for r in s.rejects]
    if not found:
        return None
    file = F.regexp_replace("_file", r"\.[^.]*$", "") if pair_by_stem else F.col("_file")
    rejects = reduce(DataFrame.unionByName, found).select(file.alias("_file"), "side", "record", "parsed", "repaired")
    return stored(rejects, scratch_folder(spark, "rejects")) if land else rejects


def compare_folders(
    spark: SparkSession, baseline: str, comparison: str, key: str | None = None, compare_columns=None, exclude=(),
    pattern: str | None = None, normalize: bool = True, case_sensitive: bool = True, auto_detect: bool = True,
    priority: list[str] | None = None, encoding: str | None = None, delimiter: str | None = None,
    multiline: bool | None = None, pair_by_stem: bool = False, only=None, land: bool = True, repair: bool = True,
) -> FolderComparison:
    """Pair the feeds of two folders by name and compare each pair.

    File names, headers and dialects are settled first by small jobs; rows stay in Spark. Naming the
    ``encoding`` and whether values run over line ends (``multiline``) saves one pass over CSV text.
    ``pair_by_stem`` ignores suffixes when pairing, ``only`` keeps the pairs named in it. ``land`` writes the parsed columns to a table
    first. ``repair`` mends XML records of broken markup, which are rejects otherwise.
    """
    session = working_session(spark)
    shown = _stem if pair_by_stem else (lambda f: f)
    jobs = ThreadPoolExecutor(4)  # the sides are independent, so their small jobs run side by side
    listed = list(jobs.map(lambda folder: feed_paths(session, folder, pattern), (baseline, comparison)))
    sides = [paths for paths, _ in listed]
    size_shuffles(session, sum(size for _, size in listed))
    if only is not None:
        kept = set(only)
        sides = [{f: p for f, p in side.items() if shown(f) in kept} for side in sides]
    names = [{shown(f) for f in side} for side in sides]
    paired = names[0] & names[1]
    other = [{"_file": f, "status": "unpaired", "reason": "only in baseline"} for f in sorted(names[0] - paired)]
    other += [{"_file": f, "status": "unpaired", "reason": "only in comparison"} for f in sorted(names[1] - paired)]

    # of several feeds under one name none can be taken for the pair
    broken: dict[str, str] = {}
    for side in sides:
        members = defaultdict(list)
        for f in sorted(side):
            members[shown(f)].append(f)
        broken |= {n: f"several feeds of this name: {', '.join(fs)}" for n, fs in members.items() if len(fs) > 1 and n in paired}
    paired -= set(broken)

    dialect = {"encoding": encoding, "delimiter": delimiter, "multiline": multiline, "repair": repair}
    scans = list(jobs.map(
        lambda folder, side: scan_folder(session, folder, {f: p for f, p in side.items() if shown(f) in paired}, **dialect),
        (baseline, comparison), sides,
    ))
    for s in scans:
        for f, why in s.errors.items():
            broken.setdefault(shown(f), why)
    other += [{"_file": f, "status": "error", "reason": why} for f, why in sorted(broken.items())]

    # pairs whose sides have the same two shapes share one plan
    group_of = [{shown(f): (i, f) for i, g in enumerate(s.groups) for f in g.files} for s in scans]
    shapes = defaultdict(list)
    for f in sorted(paired - set(broken)):
        shapes[group_of[0][f][0], group_of[1][f][0]].append(f)

    planned, confidence = [], []
    if shapes:
        meta = [
            (f"{i}|{j}", side, pos, c)
            for i, j in shapes
            for side, g in ((1, scans[0].groups[i]), (2, scans[1].groups[j]))
            for pos, c in enumerate(g.columns)
        ]
        meta = session.createDataFrame(meta, "_file string, side int, pos int, column string")
        for r in detect.resolve_keys(meta, key, auto_detect, priority).collect():
            i, j = map(int, r["_file"].split("|"))
            files = shapes[i, j]
            if r["status"] != "success":
                other += [{"_file": f, "status": r["status"], "reason": r["reason"]} for f in files]
                continue
            confidence += [(f, r["confidence"], r["confidence_band"]) for f in files]
            keys = (r["key_1"], r["key_2"])
            groups = (scans[0].groups[i], scans[1].groups[j])
            columns = compare.choose_columns(groups[0].columns, groups[1].columns, keys, compare_columns, exclude)
            needed = [list(dict.fromkeys([k, *columns])) for k in keys]
            frames = []
            for n, g in enumerate(groups):
                df = g.read([group_of[n][f][1] for f in files])
                frames.append(df.withColumn("_file", F.regexp_replace("_file", r"\.[^.]*$", "")) if pair_by_stem else df)
            planned.append((frames, needed, keys, columns, files))
    if land:
        both = [(df, cols) for frames, needed, *_ in planned for df, cols in zip(frames, needed)]
        landed = iter(list(jobs.map(lambda t: _land(session, *t), both)))
        planned = [([next(landed) for _ in frames], *rest) for frames, *rest in planned]
    jobs.shutdown()
    options = {"normalize": normalize, "case_sensitive": case_sensitive}
    parts = [Reconciliation(*frames, *keys, columns, files=files, **options) for frames, _, keys, columns, files in planned]
    return FolderComparison(session, parts, other, confidence, _faulty(session, scans, pair_by_stem, land))
