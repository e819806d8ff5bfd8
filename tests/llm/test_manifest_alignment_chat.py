"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rowtally.llm import alignment, chat, merkle

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def proof(tree, place, fanout):
    out = []
    for level in tree[:-1]:
        run = place // fanout * fanout
        out.append(("".join(level[run:place]), "".join(level[place + 1:run + fanout])))
        place //= fanout
    return out


@pytest.mark.parametrize("fanout, block", [(2, 256), (3, 9), (2, 4)])
def test_merkle(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK_NODES", block)
    sizes = {None: 1, "": 130, "b": 64, "a": 65, "é": 3}
    rows = [(g, k, sha(f"{g}{k}"), "x", "y") for g, n in sizes.items() for k in range(n)]
    rows += [("a", None, sha("none"), "x", "y"), ("a", 7, sha("tie"), "x", "y"), ("b", 5, sha("b5"), "x", "y"), ("b", 5, sha("b5"), "x", "y")]
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string, root string, pos string").repartition(3)
    got = merkle.prove(df, "lang", "doc_id", "leaf", fanout).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    by_group = defaultdict(list)
    for g, k, leaf, *_ in rows:
        by_group[g].append((k is not None, k or 0, leaf))
    groups = sorted(by_group, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf for *_, leaf in sorted(by_group[g])], fanout) for g in groups}
    top = levels([trees[g][-1][0] for g in groups], fanout)
    want = Counter()
    for i, g in enumerate(groups):
        for place, (there, k, leaf) in enumerate(sorted(by_group[g])):
            whole = tuple(proof(trees[g], place, fanout) + proof(top, i, fanout))
            want[g, k if there else None, leaf, trees[g][-1][0], top[-1][0], whole, "y"] += 1
    assert Counter((r["lang"], r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"])), r["pos"]) for r in got) == want
    assert all(r["folded"] == r["root"] for r in got)


def test_merkle_of_little(spark):
    df = spark.createDataFrame([("x", 1, sha("1"))], "lang string, doc_id long, leaf string")
    assert [(r["subroot"], r["root"], r["proof"]) for r in merkle.prove(df, "lang", "doc_id", "leaf").collect()] == [(sha("1"), sha("1"), [])]
    assert merkle.prove(df.filter("doc_id > 1"), "lang", "doc_id", "leaf").collect() == []
    digests = df.select(merkle.record_digest(F.lit(12), F.lit(None).cast("string"), F.lit("é:")).alias("d"), merkle.record_digest(F.lit("")).alias("e")).first()
    assert tuple(digests) == (sha("2:12-3:é:"), sha("0:"))


def aligned_text(text, tokenizer, processor):
    """n_a, n_b, n_groups, links as id pairs, and the groups' digest."""
    nothing = (0, 0, 0, [], "")
    if not text:
        return nothing
    byte_of = {v: k for k, v in enumerate_bytes().items()}
    ids_a, ids_b = tokenizer.encode(" " + text, add_special_tokens=False).ids, processor.encode(text)
    bytes_a = [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in ids_a]
    pieces = [processor.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return nothing
    spans = lambda parts: list(zip(np.cumsum([0, *map(len, parts[:-1])]).tolist(), np.cumsum([len(p) for p in parts]).tolist()))
    a, b = spans(bytes_a), spans(bytes_b)
    links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if s < f and t < e]
    groups, start = [], 0
    for end in sorted({e for _, e in a} & {e for _, e in b}):
        inside = lambda spans, ids: ",".join(str(i) for i, (s, e) in zip(ids, spans) if start <= s and e <= end)  # noqa: E731, B023
        groups.append(f"{inside(a, ids_a)}|{inside(b, ids_b)}")
        start = end
    return len(a), len(b), len(groups), links, sha(";".join(groups))


def enumerate_bytes():
    """The character of each byte in a byte-level vocabulary."""
    out, n = {}, 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


TEXTS = [None, "", " ", "a", "The cat sat.", "The cat sat.", " lead", "two\n\nlines  and\ttabs", "▁ under", "<s> </s> <|endoftext|> <0x41> <unk>", "日本語のテキスト",
         "🙂🙂 naïve café", "\x00nul", "I'll, we've", "Ünïcôdé ½ ﬁ", "x" * 400, "don't 12345 3.14 http://a.b/c?d=e"]


@pytest.mark.parametrize("batch", [4 << 20, 40])
def test_alignment(spark, monkeypatch, batch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", batch)
    tokenizer, processor = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "The cat", "x"), (3, "other row", "x"), (4, "The cat sat.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(3)
    got = Counter(tuple(r) for r in alignment.aligned(df, A, B).collect())
    found = [(i, *aligned_text(t, tokenizer, processor)) for i, t, _ in rows]
    counts = Counter(p for *_, links, _ in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = Counter((i, n_a, n_b, groups, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest) for i, n_a, n_b, groups, links, digest in found)
    assert got == want


def test_alignment_of_long_texts_and_none(spark):
    tokenizer, processor = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    aligner = alignment.Aligner(A, B)
    assert aligner.a.fast is not None
    long = " ".join(f"word{i} naïve" for i in range(90_000))  # over a MB
    ids, own = aligner.a.encode([long])[0], tokenizer.encode(long, add_special_tokens=False).ids
    assert ids == own
    (row,), *_ = aligner.align([long])
    assert row[:2] == (len(tokenizer.encode(" " + long, add_special_tokens=False).ids), len(processor.encode(long))) and row[2] > 90_000
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty, A, B).collect() == []
    assert [tuple(r) for r in alignment.aligned(spark.createDataFrame([(1, None)], empty.schema), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("seed", range(3))
def test_pointer_jumping(seed):
    rng = np.random.default_rng(seed)
    cut = lambda: np.append(np.sort(rng.choice(np.arange(1, 500), 150, replace=False)), 500)
    a, b = cut(), cut()
    group_a, group_b, groups = alignment.groups_of(a, b)
    common = np.intersect1d(a, b)
    assert groups == len(common)
    assert (group_a == np.searchsorted(common, a)).all() and (group_b == np.searchsorted(common, b)).all()


def plain_examples(turns, block, template=chat.Template()):
    """All rows that the operator makes of one conversation."""
    def escaped(text):
        text = text.replace("\\", "\\\\")
        for c in (template.turn, template.body, template.end, *template.others):
            text = text.replace(c, c[0] + "\\" + c[1:])
        return text

    out = []
    for first in range(0, len(turns), block):
        part, upto = turns[first:first + block], ""
        tail = first + block < len(turns) or part[-1][0] != "assistant"
        for i, (role, text) in enumerate(part):
            upto += f"{template.turn}{escaped(role)}{template.body}{escaped(text)}{template.end}"
            if role == "assistant":
                end = len(upto) - len(template.end)
                out.append((first // block, first + i, not tail and i == len(part) - 1, upto, end - len(escaped(text)), end))
        if tail:
            out.append((first // block, first + len(part) - 1, True, upto, None, None))
    return out


ODD = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>", "\\", "a\\\\b\\", "<\\/s>", "<</s>", "<<SYS>><<SYS>>", "naïve 🙂\n\n", "", None, "x\ny"]


@pytest.mark.parametrize("block", [256, 3])
def test_chat(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rng = np.random.default_rng(5)
    rows = [(c, t, str(rng.choice(["user", "assistant", "system"])), ODD[rng.integers(0, len(ODD))]) for c, n in enumerate([1, 2, 3, 4, 7, 9, 12]) for t in range(n)]
    rows += [(50, 0, "user", "hi"), (50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, 0, "assistant", "a"), (50, None, None, "first"), (None, 1, "assistant", "no id"), (51, 1, "</s>", "role")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, chat string, pos string").repartition(3)
    template = chat.Template()
    got = chat.format_chats(df).withColumn("trained", chat.trained_text(template)).withColumn("said", template.turns(F.col("chat"))).collect()
    by_id = defaultdict(list)
    for c, t, role, text in rows:
        by_id[c].append((t is not None, t or 0, role or "", text or ""))
    want = Counter((c, *e) for c, turns in by_id.items() for e in plain_examples([x[2:] for x in sorted(turns)], block))
    assert Counter(tuple(r)[:7] for r in got) == want
    for r in got:
        assert len(re.findall(re.escape(template.end), r["chat"])) == len(r["said"])
        turns = [x[2:] for x in sorted(by_id[r["conv_id"]])]
        assert [tuple(t) for t in r["said"]] == turns[r["block"] * block:r["turn"] + 1]
        assert r["trained"] == (None if r["loss_end"] is None else turns[r["turn"]][1])


def test_chat_of_little(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).collect() == []
    long = "a\\</s>" * 200_000  # over a MB
    rows = spark.createDataFrame([(1, 0, "assistant", long)], empty.schema)
    r = chat.format_chats(rows).withColumn("trained", chat.trained_text()).first()
    assert r["trained"] == long and r["loss_start"] == len("<|turn|>assistant<|text|>")


def test_chat_examples_hold_their_whole_context(spark):
    turns = [(7, i, "assistant" if i % 2 else "user", f"turn {i}</s>") for i in range(601)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    template = chat.Template()
    got = chat.format_chats(df).withColumn("said", template.turns(F.concat("before", "chat"))).withColumn("trained", chat.trained_text(template)).collect()
    assert Counter(r["turn"] for r in got if r["trained"] is not None) == Counter(range(1, 601, 2))
    for r in got:
        assert [tuple(t) for t in r["said"]] == [t[2:] for t in turns[:r["turn"] + 1]]
