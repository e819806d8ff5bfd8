"""The registered queries that SQL can express against their SQL, and the pipeline against a plain version of every stage."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from checks.verify import compare
from rowtally.llm import toxicity
from rowtally.llm.oracle import ORACLE
from rowtally.llm.queries import QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE[name]) is None


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def near_duplicates(docs):
    """The doc_ids that have a smaller one in reach."""
    sets = {}
    for i, row in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(row["text"]))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i for i in docs if least[i] != i}


def without_repeats(docs):
    """The text of each document without later repeats of 20 words; those left empty go."""
    seen, out = set(), {}
    for i in sorted(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[i]["text"] or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 19):
            window = tuple(w[k:k + 20])
            gone[k:k + 20] |= window in seen
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        if not gone.any():
            out[i] = docs[i]
        elif kept:
            out[i] = {**docs[i], "text": kept, "n_chars": len(kept)}
    return out


def leaks(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    found = set()
    for item in items:
        w = split(item)
        n = min(5, len(w))
        grams = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
        for i, row in docs.items():
            x = split(row["text"])
            own = {tuple(x[k:k + n]) for k in range(len(x) - n + 1)}
            if grams and 10 * len(grams & own) >= 8 * len(grams):
                found.add(i)
    return found


def test_pipeline(spark):
    by_id = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    everything = by_id(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "decontamination", "packing"]

    clean = stages["toxicity"](spark, docs, SF)
    machine = toxicity.fit(docs, toxicity.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    scores = {r["doc_id"]: r["_score"] for r in toxicity.with_score(docs, machine).collect()}
    want = {i: r for i, r in everything.items() if scores[i] < 0.5}
    assert by_id(clean) == want and 0 < len(want) < len(everything)

    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows.values()], docs.schema)
    gone = near_duplicates(want)
    kept = {i: r for i, r in want.items() if i not in gone}
    assert by_id(stages["jaccard_join"](spark, frame(want), SF)) == kept

    want = without_repeats(kept)
    assert by_id(stages["substring_dedup"](spark, frame(kept), SF)) == want

    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    gone = leaks(want, items)
    kept = {i: r for i, r in want.items() if i not in gone}
    assert by_id(stages["decontamination"](spark, frame(want), SF)) == kept

    pieces = defaultdict(list)
    fills = defaultdict(list)
    packed = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    for r in packed:
        pieces[r["doc_id"]].append(r)
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(kept)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    for i, rows in pieces.items():
        ids = np.array([*tokenizer.encode(kept[i]["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(rows, key=lambda r: r["piece"])):
            part = ids[at:at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids) and len(rows) == -(-len(ids) // 2048)
    for places in fills.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
