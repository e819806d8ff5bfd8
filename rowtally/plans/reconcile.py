"""Reconcile two tables, or any number of same-shaped file pairs told apart by ``_file``."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from rowtally.functions.keys import with_key
from rowtally.functions.values import as_text, name
from rowtally.operators import compare, ledger as keys, rollup, runlog
from rowtally.operators.align import align, first_per_key
from rowtally.operators.detect import detect_pair_keys
from rowtally.session import scratch_folder, stored

RESERVED = ("_file", "_ord")

PAIR_SUMMARY = """_file string, status string, reason string, key_1 string, key_2 string,
    rows_1 bigint, rows_2 bigint, raw_distinct_1 bigint, raw_distinct_2 bigint, keys_1 bigint, keys_2 bigint,
    common bigint, only_1 bigint, only_2 bigint, duplicates_1 bigint, duplicates_2 bigint,
    common_duplicates_1 bigint, common_duplicates_2 bigint,
    total_differences bigint, avg_match_rate double, columns_compared int"""

DIFF_CELLS = "_file string, sku string, column string, value_1 string, value_2 string"
COLUMN_STATS = (
    "_file string, column string, total_compared bigint, exact_matches bigint, mismatches bigint, "
    "both_empty bigint, only_1_empty bigint, only_2_empty bigint, match_rate double, status string"
)


OUTCOME = ["_file", "status", "common", "only_1", "only_2"]  # what the run summary needs of a pair


class Reconciliation:
    """Lazy result frames of one comparison. Nothing runs before a frame is used.

    Two independent plans feed them: the *ledger* reads key columns only, and the *aligned* rows read
    the key and the compared columns. Asking for key results never touches cells and vice versa.
    """

    def __init__(self, base, changed, key_1, key_2, columns, order_by="_ord", files=None, label="pair",
                 normalize=True, case_sensitive=True):
        self.spark = base.sparkSession
        self.key_1, self.key_2, self.columns = key_1, key_2, list(columns)
        self._base, self._changed, self._order_by = base, changed, order_by
        self._options = {"normalize": normalize, "case_sensitive": case_sensitive}
        self._label = None if "_file" in base.columns and "_file" in changed.columns else label
        self._files = files
        self._stored: dict[str, DataFrame] = {}

    def _side(self, df: DataFrame, key: str, letter: str | None):
        """``_file, _raw, _ord`` and, given a letter, the compared cells; with the key options."""
        types = dict(df.dtypes)
        file = F.lit(self._label) if self._label is not None else F.col("_file")
        cells = [F.array(*[as_text(c, types[c]) for c in self.columns]).alias(letter)] if letter else []
        rows = df.select(
            file.alias("_file"), name(key).cast("string").alias("_raw"), name(self._order_by).alias("_ord"), *cells
        )
        return rows, {**self._options, "ascii_only": types[key] not in ("string", "variant")}

    @cached_property
    def files(self) -> DataFrame:
        """The compared files: those given, or the names found on both sides."""
        if self._label is not None or self._files is not None:
            names = [self._label] if self._label is not None else self._files
            return self.spark.createDataFrame([(f,) for f in names], "_file string")
        # reduced in each task first, so that the file of most rows is no large partition
        side = lambda df, n: df.select("_file", F.lit(n).alias("side"))
        found = side(self._base, 1).unionByName(side(self._changed, 2)).groupBy("_file")
        return found.agg(F.min("side").alias("low"), F.max("side").alias("high")).filter("low < high AND _file IS NOT NULL").select("_file")

    # --- keys ---------------------------------------------------------------------------------

    @property
    def _full_ledger(self) -> DataFrame:
        if "ledger" in self._stored:
            return self._stored["ledger"]
        sides = []
        for df, key in ((self._base, self.key_1), (self._changed, self.key_2)):
            rows, options = self._side(df, key, None)
            sides.append(keys.ledger_side(keys.raw_keys(rows), **options))
        return keys.key_ledger(*sides)

    @property
    def ledger(self) -> DataFrame:
        return self._full_ledger.filter("_key <> ''")

    @property
    def key_presence(self) -> DataFrame:
        return keys.key_presence(self.ledger)

    @property
    def missing_keys(self) -> DataFrame:
        return keys.missing_keys(self.ledger)

    @property
    def key_counts(self) -> DataFrame:
        return keys.key_counts(self._full_ledger)

    @property
    def duplicate_counts(self) -> DataFrame:
        sides = [f"{c}_{s}" for c in ("rows", "keys", "duplicates", "common_duplicates") for s in (1, 2)]
        return self.key_counts.select("_file", *sides)

    # --- cells --------------------------------------------------------------------------------

    @property
    def aligned(self) -> DataFrame:
        """Shared keys with the compared cells of both sides as arrays ``a`` and ``b``."""
        sides = []
        for df, key, letter in ((self._base, self.key_1, "a"), (self._changed, self.key_2, "b")):
            rows, options = self._side(df, key, letter)
            sides.append(first_per_key(with_key(rows, "_raw", "_key", carries_cells=True, **options).drop("_raw")))
        return align(*sides)

    def materialize(self, folder: str | None = None) -> Reconciliation:
        """Run each of the two plans once and answer everything from what they leave.

        Stored are the key ledger, the cells that are not plainly equal, and the statistics and summary
        made from them. They go to ``folder``, by default below ``spark.checkpoint.dir``.
        """
        if not self._stored:
            folder = folder or scratch_folder(self.spark, "reconciliation")
            done = {"ledger": stored(self._full_ledger, f"{folder}/ledger")}
            if self.columns:
                found = compare.cells(self.aligned).filter("code <> 0")
                done["cells"] = stored(found, f"{folder}/cells")
            self._stored = done
            for part in ("column_stats", "pair_summary"):
                self._stored[part] = stored(getattr(self, part), f"{folder}/{part}")
        return self

    @property
    def column_stats(self) -> DataFrame:
        if "column_stats" in self._stored:
            return self._stored["column_stats"]
        if not self.columns:
            return self.spark.createDataFrame([], COLUMN_STATS)
        if "cells" not in self._stored:
            counts = compare.cell_counts(compare.cells(self.aligned))
            return compare.column_stats(counts, self.files, self.columns)
        # the plainly equal cells were not written; the ledger knows how many rows were compared
        found = compare.cell_counts(self._stored["cells"]).drop("total_compared", "exact_matches")
        total = self.files.join(self.key_counts.select("_file", "common"), "_file", "left")
        positions = F.explode(F.sequence(F.lit(0), F.lit(len(self.columns) - 1))).alias("_col")
        counts = (
            total.select("_file", F.coalesce("common", F.lit(0)).alias("total_compared"), positions)
            .join(found, ["_file", "_col"], "left")
            .withColumn("exact_matches", F.col("total_compared") - F.coalesce("mismatches", F.lit(0)))
        )
        return compare.column_stats(counts, self.files, self.columns)

    @property
    def diff_cells(self) -> DataFrame:
        if not self.columns:
            return self.spark.createDataFrame([], DIFF_CELLS)
        if "cells" not in self._stored:
            return compare.diff_cells(self.aligned, self.columns)
        return compare.name_diffs(self._stored["cells"].filter(F.col("code") >= compare.FIRST_MISMATCH), self.columns)

    @property
    def diff_preview(self) -> DataFrame:
        return compare.diff_preview(self.diff_cells)

    # --- roll-ups -----------------------------------------------------------------------------

    @property
    def overall_stats(self) -> DataFrame:
        return rollup.overall_stats(self.column_stats)

    def channel_stats(self, names: DataFrame | None = None) -> DataFrame:
        return rollup.channel_stats(self.column_stats, names)

    @property
    def pair_summary(self) -> DataFrame:
        """One row per file; the frames joined here hold one row per file each."""
        if "pair_summary" in self._stored:
            return self._stored["pair_summary"]
        fields = [f.strip().split() for f in PAIR_SUMMARY.split(",")]
        fixed = {"status": F.lit("success"), "reason": F.lit(None).cast("string"),
                 "key_1": F.lit(self.key_1), "key_2": F.lit(self.key_2)}
        joined = self._file_counts.join(rollup.pair_totals(self.column_stats), "_file", "left")
        value = lambda n, t: F.col(n) if n == "_file" else fixed.get(n, F.coalesce(n, F.lit(0)).cast(t))
        return joined.select(*[value(n, t).alias(n) for n, t in fields])

    @property
    def _file_counts(self) -> DataFrame:
        """The key counts of the compared files; the ledger knows which files have rows on both sides."""
        if self._label is None and self._files is None:
            return self.key_counts.filter("rows_1 > 0 AND rows_2 > 0")
        return self.files.join(self.key_counts, "_file", "left")

    @property
    def pair_outcomes(self) -> DataFrame:
        """What the run summary needs of every pair, without its columns."""
        if "pair_summary" in self._stored:
            return self._stored["pair_summary"].select(*OUTCOME)
        counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in OUTCOME[2:]]
        return self._file_counts.select("_file", F.lit("success").alias("status"), *counts)

    @property
    def run_summary(self) -> DataFrame:
        return rollup.run_summary(self.pair_outcomes, self.overall_stats)

    @property
    def run_log(self) -> DataFrame:
        return runlog.run_log(self.pair_summary)


def reconcile(base, changed, key=None, compare_columns=None, exclude=(), order_by="_ord", files=None, label="pair",
              normalize=True, case_sensitive=True, auto_detect=True, priority=None) -> Reconciliation:
    """Compare two DataFrames by product key.

    ``key`` is one name for both sides. Without it, or when a side lacks it and ``auto_detect`` is on,
    the key column of each side is found by its name. ``order_by`` names the column that tells which of
    several rows with one key comes first (the scans of this package add ``_ord``). Columns ``_file`` on
    both sides split the rows into independent pairs.
    """
    own = lambda df: [c for c in df.columns if c not in RESERVED and c != order_by]
    columns_1, columns_2 = own(base), own(changed)
    for df in (base, changed):
        if order_by not in df.columns:
            raise ValueError(f"no column {order_by!r} to order rows by; name one with order_by")
    if key and key in columns_1 and key in columns_2:
        key_1 = key_2 = key
    elif auto_detect:
        key_1, key_2 = detect_pair_keys(base.sparkSession, columns_1, columns_2, key, priority)
    elif key:
        raise ValueError(f"key column {key!r} is missing on one side")
    else:
        raise ValueError("no key column given")
    if key_1 is None or key_2 is None:
        raise ValueError("no key column detected")
    columns = compare.choose_columns(columns_1, columns_2, (key_1, key_2), compare_columns, exclude)
    return Reconciliation(base, changed, key_1, key_2, columns, order_by, files, label, normalize, case_sensitive)
