"""Token ids of texts, and what an operator needs of them, batch by batch."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_CACHE_WORDS = 1 << 20
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on every core already


class _Runs:
    """Runs of ids, end to end in one array."""

    def __init__(self):
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def take(self, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs picked, in a row, and where each ends."""
        n = self.lengths[picks]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(self.ids)) < 1 << 31 else np.int64
        at = np.repeat((self.starts[picks] - (ends - n)).astype(kind), n)
        at += np.arange(total, dtype=kind)
        return self.ids[at], ends


class Encoder:
    """Encodes texts word by word and keeps the ids of words seen.

    Only for tokenizers whose pre-tokenizer drops white space, ignores ASCII case and parts letters from full stops and
    commas: there no token spans such a border, so that a text's ids are those of its parts in order. The memory is
    bounded: after a million words it starts anew.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.stems: dict[str, int] = {"": 0}
        self.words, self.parts = _Runs(), _Runs()
        self.parts.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _learn_stems(self, stems: list[str]) -> None:
        """Encodes many words as one text and deals its ids out by their place."""
        found, lengths = [], []
        for i in range(0, len(stems), 2000):
            part = stems[i:i + 2000]
            whole = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            at = np.array([o[0] for o in whole.offsets], np.int64)
            ends = np.searchsorted(at, np.cumsum([len(w) + 1 for w in part]))
            found.append(np.array(whole.ids, np.uint32))
            lengths.append(np.diff(ends, prepend=0))
        if found:
            self.parts.add(np.concatenate(found), np.concatenate(lengths))

    def _learn(self, found: list[str]) -> None:
        new = [w for w in found if w not in self.known]
        if len(self.known) + len(new) > _CACHE_WORDS:
            self._forget()
            new = found
        if not new:
            return
        stems, fresh, picks = self.stems, [], []
        for w in new:
            if w.isalnum() and w.isascii():
                stem, tail = w.lower(), ""
            else:
                stem = w.rstrip(".,")
                stem = stem if stem and stem[-1].isascii() and stem[-1].isalnum() else w
                tail, stem = w[len(stem):], stem.lower() if stem.isascii() and "<" not in stem else stem  # a special token is case-sensitive
            for part in (stem, tail) if tail else (stem,):
                if part not in stems:
                    stems[part] = len(stems)
                    fresh.append(part)
            picks += stems[stem], stems[tail]
        self._learn_stems(fresh)
        ids, ends = self.parts.take(np.array(picks, np.int64))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.words.add(ids, np.diff(ends[1::2], prepend=0))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's ids; null counts as empty."""
        split = pc.ascii_split_whitespace(column.fill_null(""))
        flat = split.flatten().dictionary_encode()
        vocabulary, picks = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        self._learn(vocabulary)
        out, ends = self.words.take(np.fromiter(map(self.known.__getitem__, vocabulary), np.int64, len(vocabulary))[picks])
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
