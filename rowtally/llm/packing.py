"""Operator 10: best-fit packing of token sequences, large items paired first."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtally.llm.encoding import crc32_of, encoder
from rowtally.llm.numbering import numbered
from rowtally.llm.words import batches_of
from rowtally.session import scratch_folder, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A text's ids and ``end_id``, cut into pieces of ``capacity``; only the last piece may be shorter."""

    def cut(batches):
        for batch in batches_of(batches, "text", 12 << 20):
            ids, bounds = encoder(tokenizer).encode(batch.column("text"))
            rows: list[list] = [[], [], [], [], []]
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                own = np.append(ids[a:b], np.uint32(end_id))
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at:at + capacity]
                    for column, value in zip(rows, (doc, k, at, len(part), crc32_of(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def packing_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first, last, each, sequence, offset): pieces number first..last-1 of a length go, ``each`` to a
    sequence, into consecutive sequences from ``sequence`` on, from ``offset`` on.

    Pieces of one length are alike, so the plan is made on the histogram: its size depends on the capacity alone.
    Lengths over a third of the capacity come first, longest first: each takes the longest partner that fits, and a
    sequence holds two of them at most. Shorter lengths, longest first, go where they leave the least room; what fits
    nowhere opens sequences.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, number)
    sizes: list[int] = []  # keys of room, sorted
    opened = 0

    def put(length: int, number: int, each: int, sequence: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + number, each, sequence, offset))
        used[length] += number
        left[length] -= number

    def free(size: int, sequence: int, number: int) -> None:
        if size and number:
            if size not in room:
                bisect.insort(sizes, size)
                room[size] = []
            room[size].append((sequence, number))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = bisect.bisect_right(large, min(n, capacity - n)) - 1
        while k >= 0 and (not left[large[k]] or (large[k] == n and left[n] < 2)):
            k -= 1
        if k < 0:
            number, rest = left[n], capacity - n
            put(n, number, 1, opened, 0)
        elif large[k] == n:
            number, rest = left[n] // 2, capacity - 2 * n
            put(n, 2 * number, 2, opened, 0)
        else:
            number, rest = min(left[n], left[large[k]]), capacity - n - large[k]
            put(n, number, 1, opened, 0)
            put(large[k], number, 1, opened, n)
        free(rest, opened, number)
        opened += number
        large = [x for x in large if left[x]]
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            k = bisect.bisect_left(sizes, n)
            if k == len(sizes):
                number = -(-left[n] // (capacity // n))
                free(capacity, opened, number)
                opened += number
                continue
            size = sizes[k]
            sequence, number = room[size].pop()
            if not room[size]:
                del room[size], sizes[k]
            each = size // n
            whole = min(number, left[n] // each)
            if whole:
                put(n, whole * each, each, sequence, capacity - size)
                free(size - each * n, sequence, whole)
            if whole < number and left[n] and left[n] < each:
                some = left[n]
                put(n, some, some, sequence + whole, capacity - size)
                free(size - some * n, sequence + whole, 1)
                whole += 1
            free(size, sequence + whole, number - whole)
    return np.array(plan, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``; nothing is dropped, empty and null texts are
    the end id alone. Rows that repeat a doc_id are packed like any other.

    The driver sees one count per length (``capacity`` rows at most), plans on it and hands the plan to the tasks: its
    size is bounded by the capacity too. Pieces are numbered within their length in about sqrt(n) hash parts, so that
    neither a common length nor a group of copies meets in one task.
    """
    spark = docs.sparkSession
    table = stored(pieces(docs, tokenizer, capacity, end_id), scratch_folder(spark, "pieces"))
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = packing_plan(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    parts = int(max(counts.values(), default=1) ** 0.5) + 1
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    ranked = numbered(table, ["length"], part, ["doc_id", "piece", "ids_crc32", "start"], "_rank")
    span = int(plan[:, 2].max() if len(plan) else 0) + 1
    keys = plan[:, 0].astype(object) * span + plan[:, 1].astype(object)
    wide = len(keys) and max(keys) >= 1 << 62
    keys = keys if wide else keys.astype(np.int64)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            wanted = (length.astype(object) if wide else length) * span + rank
            row = plan[np.searchsorted(keys, wanted, side="right") - 1]
            n = rank - row[:, 1]
            sequence, offset = row[:, 4] + n // row[:, 3], row[:, 5] + n % row[:, 3] * length
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
