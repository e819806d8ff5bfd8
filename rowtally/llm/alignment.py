"""Operator 12: tokens of two tokenizers aligned by their bytes, with pointer jumping."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rowtally.llm.words import batches_of
from rowtally.session import scratch_folder, stored

BATCH_BYTES = 4 << 20  # text encoded at once; a longer text stands alone
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level tokenizers of this kind cut texts


class Pieces:
    """The bytes of each token id."""

    def __init__(self, pieces: list[bytes]):
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - n), n)].tobytes()


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class ByteLevel:
    """A byte-level BPE tokenizer's ids of texts; strings of special tokens are plain text.

    Where the vocabulary's order is the order of merges and texts are cut in the known way, the same ids come from a
    faster encoder over the same vocabulary. All that is checked here; any other tokenizer encodes by itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        byte_of, vocabulary = _byte_of(), self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in spec["added_tokens"]}
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            pieces[i] = token.encode() if token in added else bytes(byte_of[c] for c in token)
        self.pieces = Pieces(pieces)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        merged = [bytes(byte_of[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        own = sorted(i for t, i in model["vocab"].items() if t not in added)
        base = [i for i in own if len(pieces[i]) == 1]
        plain = (model["type"] == "BPE" and not spec["normalizer"] and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
                 and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
                 and len(base) == 256 and own == list(range(len(own))) and base == own[:256] and [pieces[i] for i in own[256:]] == merged)
        self.fast = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks={pieces[i]: i for i in own}, special_tokens={}) if plain else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class PieceLevel:
    """A sentence-piece tokenizer's ids of texts, to which it adds a space in front."""

    def __init__(self, path: str):
        self.processor = SentencePieceProcessor(model_file=path)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.pieces = Pieces([bytes([int(p[1:-1], 16)]) if self.processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


def successors(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For A tokens, then B tokens, the token of the other kind that overlaps it and ends farthest to the right.

    Where both end together the A token points to the B token and this to itself: it is the terminal of its group.
    """
    to_b = np.searchsorted(ends_b, ends_a)
    to_a = np.searchsorted(ends_a, ends_b)
    return np.concatenate([len(ends_a) + to_b, np.where(ends_a[to_a] == ends_b, len(ends_a) + np.arange(len(ends_b)), to_a)])


def terminals(successor: np.ndarray) -> np.ndarray:
    """Where each token gets to by its pointers, which are doubled until none moves."""
    while True:
        further = successor[successor]
        if (further == successor).all():
            return successor
        successor = further


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of each A and each B token's group, in order, and how many groups there are."""
    last = terminals(successors(ends_a, ends_b))
    found, number = np.unique(last, return_inverse=True)
    return number[:len(ends_a)], number[len(ends_a):], len(found)


def _group_texts(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;`` of all groups in order as bytes, and where each group's text ends."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    at_a = np.arange(len(ids_a)) + (np.cumsum(n_b) - n_b)[group_a]
    at_b = np.arange(len(ids_b)) + np.cumsum(n_a)[group_b]
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    ids[at_a], ids[at_b] = ids_a, ids_b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[at_a[np.cumsum(n_a) - 1]], mark[at_b[np.cumsum(n_b) - 1]] = ord("|"), ord(";")
    cells = digits[ids]  # zero bytes behind the digits, which then go
    cells[:, -1] = mark
    ends = np.cumsum((cells != 0).sum(1))
    flat = cells.ravel()
    return flat[flat != 0], ends[at_b[np.cumsum(n_b) - 1]]


def _packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and how often each occurs, as small differences whose bytes stand in planes and so compress."""
    steps = np.diff(places, prepend=0).astype("<u4")
    return b"".join(x.astype("<u4").view(np.uint8).reshape(len(x), 4).T.tobytes() for x in (steps, times))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 8
    steps, times = (np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").reshape(n).astype(np.int64) for at in (0, 4 * n))
    return np.cumsum(steps), times


class Aligner:
    """Aligned tokens of a batch of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), PieceLevel(path_b)
        n = max(len(self.a.pieces.lengths), len(self.b.pieces.lengths))
        width = len(str(n)) + 1  # of the decimal digits of an id and a mark
        self.digits = np.array([str(i).encode() for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)

    def encoded(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Numbers of the texts that both tokenizers give back byte for byte, and their ids."""
        some = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in some]
        a, b = ([np.array(x, np.int64) for x in ids] for ids in (self.a.encode(spaced), self.b.encode([texts[i] for i in some])))
        good = [k for k, t in enumerate(spaced) if self._same(t.encode(), a[k], self.a.pieces) and self._same(t.encode(), b[k], self.b.pieces)]
        return [some[k] for k in good], [a[k] for k in good], [b[k] for k in good]

    @staticmethod
    def _same(text: bytes, ids: np.ndarray, pieces: Pieces) -> bool:
        return int(pieces.lengths[ids].sum()) == len(text) and pieces.joined(ids) == text

    def align(self, texts: list[str | None]):
        """n_a, n_b, n_groups, n_links and digest of each text; the packed links of each; distinct id pairs of all, and in how many texts each is."""
        rows, links = [(0, 0, 0, 0, "")] * len(texts), [b""] * len(texts)
        good, a, b = self.encoded(texts)
        if not good:
            return rows, links, np.zeros(0, np.int64), np.zeros(0, np.int64)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        ids_a, ids_b = np.concatenate(a), np.concatenate(b)
        ends_a, ends_b = np.cumsum(self.a.pieces.lengths[ids_a]), np.cumsum(self.b.pieces.lengths[ids_b])
        group_a, group_b, groups = groups_of(ends_a, ends_b)
        text, text_ends = _group_texts(ids_a, ids_b, group_a, group_b, groups, self.digits)
        last_a = np.cumsum(n_a) - 1
        last_group = group_a[last_a]
        n_groups = np.diff(last_group, prepend=-1)
        # every stretch between neighbouring ends is what one A and one B token share
        cuts = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # which merges what is sorted
        cuts = cuts[np.diff(cuts, prepend=0) > 0]
        pair = (ids_a[np.searchsorted(ends_a, cuts)] << 32) | ids_b[np.searchsorted(ends_b, cuts)]
        cut_ends = np.searchsorted(cuts, ends_a[last_a], side="right")
        n_links = np.diff(cut_ends, prepend=0)
        pairs, place = np.unique(pair, return_inverse=True)
        held, times = np.unique(np.repeat(np.arange(len(good)), n_links) * len(pairs) + place, return_counts=True)
        bounds = np.searchsorted(held, np.arange(len(good) + 1) * len(pairs))
        place = held % len(pairs)
        view = memoryview(text)
        starts = np.r_[0, text_ends[last_group][:-1]]
        for k, i in enumerate(good):
            digest = hashlib.sha256(view[starts[k]:text_ends[last_group[k]] - 1]).hexdigest()
            rows[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), digest)
            links[i] = _packed(place[bounds[k]:bounds[k + 1]], times[bounds[k]:bounds[k + 1]])
        return rows, links, pairs, np.bincount(place, minlength=len(pairs))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One aligner for each Python worker and pair of paths."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_PART = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, held array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _align_batches(path_a: str, path_b: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_PART))

    def run(batches):
        aligner, number = aligner_of(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches_of(batches, "text", BATCH_BYTES):
            if not len(batch):
                continue
            rows, links, pairs, held = aligner.align(batch.column("text").to_pylist())
            nothing = [None] * len(rows)
            docs = [[number] * len(rows), batch.column("doc_id").to_pylist(), *map(list, zip(*rows)), links, nothing, nothing]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(docs, schema)], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([number, *[None] * 7, pairs, held], schema)], schema=schema)
            number += 1

    return run


def _summed(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a batch with the counts of its pairs summed over their links."""
    place = answers["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    count[place], best[place] = answers["count"].to_numpy(), answers["best"].to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for data in docs["links"].to_pylist():
        at, times = _unpacked(data)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((count[at] * times).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A space and the text are encoded by the byte-level tokenizer A, the text by the sentence-piece tokenizer B. Every token points to
    the farthest-right one of the other kind that it shares bytes with; doubling the pointers brings each to the terminal of its
    group, behind which both tokenizers cut. Links are the pairs of tokens that share bytes; the count of an id pair is the number
    of rows that hold it linked. n_best counts the links whose pair has the highest count of its A id, count_sum adds all links' counts.

    Texts are encoded once. A batch of about BATCH_BYTES of text keeps its documents' links as places in the batch's list of distinct
    pairs; the pairs travel one row per batch, however many documents hold them, and their counts come back to the batch. A batch is the
    largest thing a task holds; a longer text is a batch of its own.

    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no tokens: zeros and ''. Null doc_ids are kept,
    rows that share a doc_id are counted one by one, other columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "aligned")
    parts = docs.select("doc_id", "text").mapInArrow(_align_batches(path_a, path_b), _PART).withColumn("kind", F.when(F.col("pairs").isNull(), "docs").otherwise("pairs"))
    for kind in ("docs", "pairs"):  # both folders are there even if a table is empty
        spark.createDataFrame([], _PART).write.parquet(f"{folder}/kind={kind}")
    parts.write.mode("append").partitionBy("kind").parquet(folder)
    texts = spark.read.schema(_PART).parquet(f"{folder}/kind=docs").drop("pairs", "held")
    asked = spark.read.schema(_PART).parquet(f"{folder}/kind=pairs").select("batch", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x"))
    asked = asked.select("batch", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = stored(asked.groupBy("pair").agg(F.sum("held").alias("count")), scratch_folder(spark, "pair-counts"))
    first = F.shiftright("pair", 32)
    highest = counts.groupBy(first.alias("a")).agg(F.max("count").alias("most"))
    ranked = counts.join(highest, first == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select("batch", "place", "pair").join(ranked, "pair").select("batch", "place", "count", "best")
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_summed, _RESULT)
