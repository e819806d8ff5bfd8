"""Operator 1: repeated passages by fixed-block anchors."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rowtally.llm.words import Words, batches_of, words

WINDOW = 20
_PACKED = "bucket int, reply boolean, data binary"
_REPLY = "doc_id long, data binary"
_U32 = np.uint64(0xFFFFFFFF)


def _slots(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of the hash: what anchors and probes are compared by. The bucket count follows the input, and so
    does the width of a code; a chance match only adds windows to look at."""
    return (_slots(hashes, buckets).astype(np.uint64) << np.uint64(32)) | (hashes & _U32)


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    return owner[cuts], np.diff(np.r_[cuts, len(owner)]).astype(np.uint32)


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: bytes that are mostly zero then stand together and compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(data: bytes, kind, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n)


def _pack(doc_ids: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of entries whose documents stand in runs."""
    docs, counts = _runs(doc_ids)
    head = np.array([len(docs), len(doc_ids)], np.int64).tobytes()
    return b"".join([head, _planes(docs), _planes(counts), *(np.packbits(c).tobytes() if c.dtype == bool else _planes(c) for c in columns)])


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n_docs, n = np.frombuffer(data, np.int64, 2).tolist()
    at = 16 + 8 * n_docs
    out = [np.repeat(_from_planes(data, np.int64, n_docs, 16), _from_planes(data, np.uint32, n_docs, at))]
    at += 4 * n_docs
    for kind in kinds:
        if kind is bool:
            out.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool))
            at += -(-n // 8)
        else:
            out.append(_from_planes(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return out


def _to_buckets(slot: np.ndarray, doc_ids: np.ndarray, *columns: np.ndarray, reply: bool = False) -> pa.RecordBatch:
    """One row of packed entries per bucket."""
    order = np.argsort(slot, kind="stable")
    slot, doc_ids, columns = slot[order], doc_ids[order], [c[order] for c in columns]
    number, counts = _runs(slot)
    ends = np.cumsum(counts.astype(np.int64))
    data = [_pack(doc_ids[b - n:b], *(c[b - n:b] for c in columns)) for n, b in zip(counts.astype(np.int64), ends)]
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(np.full(len(data), reply)), pa.array(data, pa.binary())], ["bucket", "reply", "data"])


def _to_docs(doc_ids: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Answers for documents, packed by buckets of documents."""
    order = np.argsort(doc_ids, kind="stable")
    return _to_buckets(doc_ids[order] % buckets, doc_ids[order], values[order], reply=True)


def _answer(table: pa.Table, rows: pa.RecordBatch | None) -> pa.Table:
    """Answers that only pass through, and those found here."""
    passing = table.filter(table["reply"]).select(["bucket", "reply", "data"])
    return passing if rows is None else pa.concat_tables([passing, pa.table(rows)])


def _deliver(kind):
    """Answers of a bucket of documents, one row per document."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        doc, value = (np.concatenate(c) for c in zip(*(_unpack(d, kind) for d in table["data"].to_pylist())))
        order = np.argsort(doc, kind="stable")
        docs, counts = _runs(doc[order])
        ends = np.cumsum(counts.astype(np.int64))
        data = [value[order[b - n:b]].tobytes() for n, b in zip(counts.astype(np.int64), ends)]
        return pa.table({"doc_id": docs, "data": pa.array(data, pa.binary())})

    return run


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by the keys (last is the first to sort by), and the group number of each row in that order."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.cumsum(new)


def _probe(block: int, buckets: int):
    """Anchors and probes of a batch of texts, one entry per distinct block of words, for its bucket.

    A block that stands in the batch more than once needs no bucket to tell: its documents get the answer directly, and
    one of them stands for the batch. So a passage that everyone quotes makes one entry per batch.
    """

    def run(batches):
        for batch in batches_of(batches, "text", 8 << 20):
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            w = words(batch.column("text"))
            starts, h = w.windows(block)
            if not len(h):
                continue
            text = w.text_of[starts]
            anchor = (starts - w.bounds[text]) % block == 0
            order, group = _groups(h)
            several = np.bincount(group)[group] > 1
            anchored = np.zeros(group[-1] + 1, bool)
            anchored[group[anchor[order]]] = True
            first = order[np.r_[True, group[1:] != group[:-1]]]
            yield _to_buckets(*_by_place(first, _slots(h, buckets), ids[text], (h & _U32).astype(np.uint32)), anchored[np.argsort(first, kind="stable")])
            again = order[several]
            pairs = np.unique(np.stack([text[again].astype(np.uint64), _codes(h[again], buckets)]), axis=1) if len(again) else np.zeros((2, 0), np.uint64)
            if pairs.shape[1]:
                yield _to_docs(ids[pairs[0].astype(np.int64)], pairs[1], buckets)

    return run


def _by_place(first: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    at = np.sort(first, kind="stable")
    return [c[at] for c in columns]


def _hits(buckets: int):
    """Blocks of words that stand in two entries at least, one of them an anchor: codes per document."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        slot, rows = np.uint64(key[0].as_py()) << np.uint64(32), None
        parts = [_unpack(d, np.uint32, bool) for d in table.filter(pc.invert(table["reply"]))["data"].to_pylist()]
        if parts:
            doc, code, anchor = (np.concatenate(c) for c in zip(*parts))
            order, group = _groups(code)
            good = (np.bincount(group) > 1) & (np.bincount(group, anchor[order]) > 0)
            hit = order[good[group]]
            rows = _to_docs(doc[hit], slot | code[hit].astype(np.uint64), buckets)
        return _answer(table, rows)

    return run


def _replies(lists: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(lists.drop_null().to_pylist()), kind)


def _extend(window: int, block: int, buckets: int):
    """Windows around hits, hashed; the earliest of equal ones in a batch goes to its bucket, later ones are settled."""

    def run(batches):
        for batch in batches_of(batches, "text", 8 << 20):
            batch = batch.filter(batch.column("_hits").is_valid())
            batch = batch.take(pa.array(np.argsort(batch.column("doc_id").to_numpy(zero_copy_only=False), kind="stable")))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            w = words(batch.column("text"))
            at = _around_hits(w, np.unique(_replies(batch.column("_hits"), np.uint64)), window, block, buckets)
            if not len(at):
                continue
            h, check, text = w.hash_at(at, window), w.check_at(at, window), np.searchsorted(w.bounds, at, side="right") - 1
            doc, place = ids[text], (at - w.bounds[text]).astype(np.uint32)
            order, group = _groups(check, h)
            leads = np.r_[True, group[1:] != group[:-1]]
            lead = order[leads][group]
            later = order[(doc[order] != doc[lead]) | (place[order] != place[lead])]
            first = np.sort(order[leads])
            yield _to_buckets(_slots(h[first], buckets), doc[first], h[first], check[first], place[first])
            yield _to_docs(doc[later], place[later], buckets)

    return run


def _around_hits(w: Words, hits: np.ndarray, window: int, block: int, buckets: int) -> np.ndarray:
    """Starts of the windows that hold a block of words that was hit."""
    starts, h = w.windows(block)
    if not len(hits) or not len(starts):
        return np.zeros(0, np.int64)
    codes = _codes(h, buckets)
    hit = hits[np.minimum(np.searchsorted(hits, codes), len(hits) - 1)] == codes
    before = np.zeros(len(w.hashes) + 1, np.int32)
    before[starts[hit] + 1] = 1
    before = np.cumsum(before)
    room = np.maximum(np.diff(w.bounds) - window + 1, 0)
    ends = np.cumsum(room)
    at = np.arange(ends[-1]) + np.repeat(w.bounds[:-1] - (ends - room), room)
    return at[before[at + window - block + 1] > before[at]]


def _later(buckets: int):
    """Of equal windows all but the earliest: their places per document."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = None
        parts = [_unpack(d, np.uint64, np.uint32, np.uint32) for d in table.filter(pc.invert(table["reply"]))["data"].to_pylist()]
        if parts:
            doc, h, check, place = (np.concatenate(c) for c in zip(*parts))
            by_place = np.lexsort((place, doc))
            doc, h, check, place = doc[by_place], h[by_place], check[by_place], place[by_place]
            order, group = _groups(check, h)
            lead = order[np.r_[True, group[1:] != group[:-1]]][group]
            later = order[(doc[order] != doc[lead]) | (place[order] != place[lead])]
            rows = _to_docs(doc[later], place[later], buckets)
        return _answer(table, rows)

    return run


def _remove(window: int, names: list[str]):
    def run(batches):
        for batch in batches_of(batches, "text", 16 << 20):
            rows = []
            for text, starts in zip(batch.column("text").fill_null("").to_pylist(), batch.column("_removed").to_pylist()):
                found = text.encode().split()
                n = len(found)
                if starts:
                    at = np.frombuffer(starts, np.uint32).astype(np.int64)
                    change = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + window, n), minlength=n + 1)
                    found = list(compress(found, (np.cumsum(change)[:n] == 0).tolist()))
                kept = b" ".join(found)
                rows.append((n, n - len(found), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))] if rows else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string(), pa.string())]
            own = dict(zip(["n_words", "n_removed", "kept_sha256", "kept_text"], columns))
            yield pa.RecordBatch.from_arrays([own[f] if f in own else batch.column(f) for f in names], names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: its columns but the text, and n_words, n_removed, kept_sha256. With ``texts`` also the text and kept_text.

    Every word covered by a window of ``window`` words whose sequence also starts earlier (smaller doc_id, or earlier in the
    document) is removed. Blocks of window // 2 words at multiples of that length are the anchors; each window holds one,
    wherever it starts. All rolling blocks probe them by a short code in the bucket of that code. Windows around hits are
    then compared by 96 bits of hash, the earliest of each kind is found, and runs of removed windows are the maximal
    repeats. Both exchanges carry one entry per batch of texts and block, however often it occurs there.

    Null texts have no words. Rows without doc_id are kept whole and remove nothing; rows that share a doc_id count as one
    document, so equal places in them don't remove each other. Columns named like a result column are dropped.
    """
    spark = docs.sparkSession
    buckets, block = int(spark.conf.get("spark.sql.shuffle.partitions")), window // 2
    own = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in (*own, "_hits", "_removed")])
    probes = docs.select("doc_id", "text").mapInArrow(_probe(block, buckets), _PACKED)
    hits = probes.groupBy("bucket").applyInArrow(_hits(buckets), _PACKED).groupBy("bucket").applyInArrow(_deliver(np.uint64), _REPLY)
    # both joins take the same columns and rows of ``docs``, so that one exchange serves them and texts are shuffled once
    near = docs.join(hits.withColumnRenamed("data", "_hits"), "doc_id", "left")
    windows = near.mapInArrow(_extend(window, block, buckets), _PACKED)
    removed = windows.groupBy("bucket").applyInArrow(_later(buckets), _PACKED).groupBy("bucket").applyInArrow(_deliver(np.uint32), _REPLY)
    removed = removed.withColumnRenamed("data", "_removed")
    fields = [f for f in docs.schema.fields if texts or f.name != "text"]
    fields += [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    fields += [StructField("kept_text", StringType())] if texts else []
    names = [f.name for f in fields]
    return docs.join(removed, "doc_id", "left").mapInArrow(_remove(window, names), StructType(fields))
