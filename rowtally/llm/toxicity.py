"""Operator 2: a factorization machine over hashed terms."""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtally.llm.words import LETTER_OR_DIGIT, batches_of, words
from rowtally.session import scratch_folder, stored

TERM_BITS = 20
SAMPLE_PER_CLASS = 10_000  # labelled rows of each class the model is fitted on, at most
CHUNK_TERMS = 1 << 24  # terms of rows that the driver holds at once, about
MINIBATCH = 128
FACTORS, EPOCHS, RATE, DECAY = 8, 12, 0.05, 1e-4
_HEAD = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Machine:
    """score = bias + sum of weights + sum over pairs of terms of the product of their factors, over the terms of a text."""

    terms: np.ndarray  # hashed terms, sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, text_of: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(text_of, self.weights[term], n)
        for f in self.factors.T:
            out += 0.5 * (np.bincount(text_of, f[term], n) ** 2 - np.bincount(text_of, f[term] ** 2, n))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        text_of, term = hashed_terms(column, self.terms)
        return 1 / (1 + np.exp(-np.clip(self.logits(text_of, term, len(column)), -40, 40)))


def hashed_terms(column: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hashed term) of texts: words in lower case and, of longer ones, the first five bytes.

    With ``known`` terms, only those, and their places in ``known`` instead.
    """
    w = words(column, LETTER_OR_DIGIT, lower=True, prefix=5)
    longer = w.hashes != w.prefixes
    term = np.concatenate([w.hashes, w.prefixes[longer] ^ _HEAD]) >> np.uint64(64 - TERM_BITS)
    text_of = np.concatenate([w.text_of, w.text_of[longer]])
    if known is not None:
        place = np.full(1 << TERM_BITS, -1, np.int32)
        place[known] = np.arange(len(known))
        term = place[term]
        text_of, term = text_of[term >= 0], term[term >= 0]
    pairs = np.unique((text_of.astype(np.int64) << TERM_BITS) | term.astype(np.int64))
    return pairs >> TERM_BITS, pairs & ((1 << TERM_BITS) - 1)


def sample_labels(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled ids of each class, by hash; and how many there are of each."""
    sizes = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [labels.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), {y: sizes.get(y, 0) for y in (0, 1)}


def _in_chunks(rows: DataFrame) -> tuple[str, int]:
    """The folder the rows are stored in, by chunks of about CHUNK_TERMS terms that their content alone decides, and how many these are."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.size("terms") + 1)).first()[0]
    chunks = -(-total // CHUNK_TERMS)
    mark = F.xxhash64("terms", "y")
    rows = rows.withColumns({"mark": mark, "chunk": F.pmod(mark, F.lit(chunks)).cast("int")})
    folder = scratch_folder(spark, "sample")
    rows.repartition(chunks, "chunk").write.partitionBy("chunk").parquet(folder)
    return folder, chunks


def _chunk(spark: SparkSession, folder: str, chunk: int) -> pa.Table:
    """A chunk's rows, straight from the stored files where ``pyarrow.fs`` knows the store, so that they don't pass the driver's JVM."""
    try:
        system, path = fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return spark.read.schema("y int, terms array<int>, mark long").parquet(f"{folder}/chunk={chunk}").toArrow()
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{path}/chunk={chunk}", allow_not_found=True)) if f.path.endswith(".parquet"))
    tables = [pq.read_table(n, columns=["y", "terms", "mark"], filesystem=system, use_threads=False, pre_buffer=False) for n in names]
    return pa.concat_tables(tables) if tables else pa.table({"y": pa.array([], pa.int32()), "terms": pa.array([], pa.list_(pa.int32())), "mark": pa.array([], pa.int64())})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Learn from ``labels`` (doc_id, y of 0 or 1) and the whole texts of those documents.

    The model is fitted on at most ``per_class`` rows of each class, chosen by hash, and knows all terms of these, which the
    hashed space bounds; the prior is that of all labels. The driver holds the machine and about CHUNK_TERMS terms of rows at a time,
    however long the texts are. Without rows of both classes the score is the share of toxic labels, or 0.5 without labels.
    """
    sample, sizes = sample_labels(labels, per_class)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # 2 * per_class ids at most

    def featurise(batches):
        for batch in batches_of(batches, "text", 4 << 20):
            text_of, term = hashed_terms(batch.column("text"))
            cuts = np.searchsorted(text_of, np.arange(len(batch) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(term, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), lists], ["y", "terms"])

    rows = stored(texts.mapInArrow(featurise, "y int, terms array<int>"), scratch_folder(docs.sparkSession, "terms"))
    drawn = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = drawn.get(0, 0), drawn.get(1, 0)
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    folder, chunks = _in_chunks(rows)
    place = np.zeros(1 << TERM_BITS, np.int32)
    for chunk in range(chunks):
        for batch in _chunk(docs.sparkSession, folder, chunk).to_batches(max_chunksize=MINIBATCH):
            place[pc.list_flatten(batch["terms"]).to_numpy()] = 1
    known = np.flatnonzero(place)
    place[known] = np.arange(len(known))

    def minibatches(chunk: int, rng: np.random.Generator) -> list[_Batch]:
        found = _chunk(docs.sparkSession, folder, chunk)
        ends = np.cumsum(pc.list_value_length(found["terms"]).to_numpy())
        starts, flat, y = np.r_[0, ends[:-1]], pc.list_flatten(found["terms"]).to_numpy(), found["y"].to_numpy().astype(np.float32)
        order = np.argsort(found["mark"].to_numpy())[rng.permutation(len(y))]  # the result doesn't hang on the order of tasks
        del found
        _release()
        return [_Batch([place[flat[starts[i]:ends[i]]] for i in pick], y[pick]) for pick in (order[at:at + MINIBATCH] for at in range(0, len(order), MINIBATCH))]

    machine = train(minibatches, chunks, known)
    _release()
    machine.bias += float(np.log(sizes[1] / sizes[0]) - np.log(n1 / n0))
    return machine


def _release() -> None:
    """Give memory that is no longer used back, which glibc and Arrow would keep for the driver's process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class _Batch:
    """Some rows, and their entries in the order of rows and of terms, so that sums over either are sums over runs."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        sizes = np.array([len(r) for r in rows])
        self.y, self.filled = y, np.flatnonzero(sizes)
        self.row_cuts = (np.cumsum(sizes) - sizes)[self.filled]
        self.used, place = np.unique(np.concatenate(rows), return_inverse=True)
        order = np.argsort(place, kind="stable")
        self.place = place.astype(np.uint16 if len(self.used) <= 1 << 16 else np.int32)
        self.owner = np.repeat(np.arange(len(rows), dtype=np.uint8 if len(rows) <= 256 else np.int32), sizes)[order]
        self.term_cuts = np.searchsorted(place[order], np.arange(len(self.used))).astype(np.int32)

    def by_row(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.y), *values.shape[1:]), np.float32)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(values[self.place], self.row_cuts)
        return out

    def by_term(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.owner], self.term_cuts) if len(self.used) else np.zeros((0, *values.shape[1:]), np.float32)


def _first_factors(known: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Random factors of the known terms: the same whatever others are known, though drawn a slice of the hashed space at a time."""
    out, step = np.empty((len(known), FACTORS), np.float32), 1 << 16
    for at in range(0, 1 << TERM_BITS, step):
        lo, hi = np.searchsorted(known, [at, at + step])
        out[lo:hi] = rng.standard_normal((step, FACTORS), np.float32)[known[lo:hi] - at]
    out *= np.float32(0.01)
    return out


def train(minibatches, chunks: int, known: np.ndarray, seed: int = 7) -> Machine:
    """Minibatch gradient steps with a rate per parameter that falls with the gradients it has seen.

    ``minibatches(chunk, rng)`` gives a chunk's, whose terms are places in ``known``; only one chunk is held at a time. A single one is read once.
    """
    rng = np.random.default_rng(seed)
    n = len(known)
    weights, factors, bias = np.zeros(n, np.float32), _first_factors(known, rng), 0.0
    sw, sf, sb = np.full(n, 1e-2, np.float32), np.full((n, FACTORS), 1e-2, np.float32), 1e-2
    batches = None
    for _ in range(EPOCHS):
        for chunk in rng.permutation(chunks).tolist():
            batches = batches if batches and chunks == 1 else None  # the chunk before goes first
            batches = batches or minibatches(chunk, rng)
            for batch in (batches[i] for i in rng.permutation(len(batches))):
                used, w, v = batch.used, weights[batch.used], factors[batch.used]
                sums = batch.by_row(v)
                logits = bias + batch.by_row(w - 0.5 * (v ** 2).sum(1)) + 0.5 * (sums ** 2).sum(1)
                error = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - batch.y).astype(np.float32)
                e = batch.by_term(error)
                gw = e + DECAY * w
                gf = batch.by_term(error[:, None] * sums) + (DECAY - e)[:, None] * v
                sw[used] += gw ** 2
                sf[used] += gf ** 2
                weights[used] = w - RATE * gw / np.sqrt(sw[used])
                factors[used] = v - RATE * gf / np.sqrt(sf[used])
                total = float(error.sum())
                sb += total ** 2
                bias -= RATE * total / np.sqrt(sb)
    return Machine(known, bias, weights, factors)


def free_name(docs: DataFrame, name: str = "_score") -> str:
    """A name that no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_score(docs: DataFrame, machine: Machine, name: str = "_score") -> DataFrame:
    """All columns of ``docs`` and the score as ``name``, from the whole text alone; null and empty texts get the bias's score.

    A column of that name in ``docs`` is replaced.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop(name)

    def score(batches):
        for batch in batches_of(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(machine.score(batch.column("text")))], [*batch.schema.names, name])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def training_labels(labels: DataFrame, held_out=None) -> DataFrame:
    """(doc_id, y): the larger label where an id has several; rows without id or label are left out."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    return rows if held_out is None else rows.filter(~held_out)
