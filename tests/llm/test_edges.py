"""Repeated rows and ids, clashing column names, empty tables and texts over a MB; the parts of operators that no query shows."""

import tracemalloc
import uuid
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtally.llm import contamination, embeddings, licences, packing, sharding, token_counts, toxicity, warc

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def test_embeddings_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.05]), (3, [0.0, -1.0]), (3, [0.0, -1.0]), (4, [0.04, 1.0]), (5, None), (5, None), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, node string, cell string").repartition(3)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == Counter([(1, 1, 1, True), (2, 1, 2, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 2, False), (5, 0, 5, True), (5, 0, 5, True), (None, 0, None, True)])
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def _links_by_force(vectors: dict[int, np.ndarray]) -> dict[int, tuple[int, int]]:
    ids, unit = list(vectors), np.stack([v / np.linalg.norm(v) for v in vectors.values()])
    near = unit @ unit.T >= 0.9
    label, before = np.arange(len(ids)), None
    while before is None or (label != before).any():
        before, label = label, np.where(near, label, len(ids)).min(1)
    return {i: (int(n) - 1, ids[c]) for i, n, c in zip(ids, near.sum(1), label)}


def test_embeddings_are_not_copied_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embeddings, "scratch_folder", lambda _, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[2000:] = x[rng.integers(0, 500, 1000)] + rng.normal(0, 0.3, (1000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    want = _links_by_force(dict(enumerate(x.astype(float))))
    assert got == want and sum(n > 0 for n, _ in want.values()) > 500
    assert sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()) < 1.5 * x.nbytes


@pytest.mark.parametrize("rows, values, n", [(50, 1 << 22, 700), (1, 2 * 12, 270)])  # files cut into groups; over 64 groups, so that units hold several of them
def test_embeddings_of_many_groups(spark, monkeypatch, rows, values, n):
    monkeypatch.setattr(embeddings, "LEAST_ROWS", rows)
    monkeypatch.setattr(embeddings, "GROUP_VALUES", values)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 12))
    x[n // 2:] = x[rng.integers(0, 20, n - n // 2)] + rng.normal(0, 0.4, (n - n // 2, 12))
    flat = {10_000 + i: rng.normal(size=2) for i in range(40)}  # of another dimension
    df = spark.createDataFrame([(i, v.tolist()) for i, v in [*enumerate(x), *flat.items()]], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == _links_by_force(dict(enumerate(x))) | _links_by_force(flat)


def test_embeddings_of_a_dense_cluster(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24))
    x[:1200] = x[0] + rng.normal(0, 0.32, (1200, 24))  # cosines on either side of 0.9
    order = rng.permutation(1500)
    same = [(2000, [0.0, 3.0]), (2001, [-0.0, 3.0]), (2002, [0.0, 6.0]), (2003, [1e-200, 1e-200]), (2004, [1e200, 1e200])]
    df = spark.createDataFrame([*((int(i), x[i].tolist()) for i in order), *same], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert {i: got[i] for i in range(1500)} == _links_by_force(dict(enumerate(x)))
    assert {i: got[i] for i in range(2000, 2005)} == {2000: (2, 2000), 2001: (2, 2000), 2002: (2, 2000), 2003: (0, 2003), 2004: (0, 2004)}


def test_contamination_of_repeated_ids(spark):
    words = [f"w{i}" for i in range(10)]
    item = " ".join(words)
    rows = [(1, " ".join(words[:8])), (1, " ".join(words[2:])), (2, item), (2, item), (2, "short"), (None, item), (3, None), (4, "x " * 600_000 + item)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, item string, mark string, u string").repartition(3)
    items = spark.createDataFrame([(7, item, "q"), (7, "w1 w2", "q"), (8, item, "q"), (None, item, "q"), (9, None, "q")], "item_id long, text string, need string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in contamination.contaminated(df, items).collect()}
    assert got == {**{(i, k): (6, 6) for i in (2, 4) for k in (8, None)}, **{(i, 7): (6, 6) for i in (2, 4)}, (1, 7): (1, 1)}
    assert contamination.contaminated(df.limit(0), items).collect() == []


def test_machine_sums_over_all_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    texts = [[0, 3, 8], [], [2], list(range(9))]
    text_of = np.repeat(np.arange(4), [len(t) for t in texts])
    got = machine.logits(text_of, np.concatenate([np.array(t, int) for t in texts]), 4)
    for t, value in zip(texts, got):
        pairs = sum(machine.factors[i] @ machine.factors[j] for k, i in enumerate(t) for j in t[k + 1:])
        assert value == pytest.approx(0.3 + sum(machine.weights[i] for i in t) + pairs)


def test_toxicity_holds_known_terms_only(spark):
    """The driver's arrays are as long as the sample's terms, not as the hashed space: its weights, factors and their rates took 72 MiB there."""
    docs = spark.createDataFrame([(i, f"w{i % 7} {'bad' if i % 2 else 'good'}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int")
    toxicity.fit(docs, labels)
    tracemalloc.start()
    try:
        machine = toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(machine.terms) == len(machine.weights) == len(machine.factors) < 30
    assert peak < 32 << 20


def test_toxicity_in_chunks(spark, monkeypatch):
    """The machine learns alike whether the driver holds all rows at once or a few."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["vile" if i % 3 == 0 else "kind", *(f"w{k}" for k in rng.integers(0, 60, 12))]), "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score string").repartition(4)
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    for chunk in (1 << 24, 2000):
        monkeypatch.setattr(toxicity, "CHUNK_TERMS", chunk)
        machine = toxicity.fit(docs, toxicity.training_labels(labels))
        name = toxicity.free_name(docs)
        scored = toxicity.with_score(docs, machine, name)
        assert scored.columns == [*docs.columns, name] and name != "_score"
        assert all((r[name] >= 0.5) == (r.doc_id % 3 == 0) for r in scored.collect())
    empty = toxicity.fit(docs.limit(0), toxicity.training_labels(labels.limit(0)))
    assert toxicity.with_score(docs.limit(0), empty).collect() == []


def test_sharding_edges(spark):
    rows = [(i % 5, "a") for i in range(40)] + [(None, "a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, shard_of string").repartition(3)
    out = sharding.shard_by_key(df, "doc_id", {0: 1.0, 1: 2.0, 2: 0.0}).collect()
    assert len(out) == len(rows) and len({(r.doc_id, r.shard) for r in out}) == 6 and {r.shard for r in out} <= {0, 1}
    for s in (0, 1):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard_by_key(df.limit(0), "doc_id", {0: 1.0}).collect() == []


def test_counts_answer_every_limit(spark):
    texts = [None, "", "a", "one two three", "one two three", "w " * 300_000, "a b c d e f"]
    lengths = [len(Tokenizer.from_file(TOKENS).encode(t or "", add_special_tokens=False).ids) for t in texts]
    table = token_counts.length_histogram(spark.createDataFrame([(t, "x") for t in texts], "text string, documents string"), TOKENS)
    for r in table.collect():
        n = r.n_tokens
        assert r.tokens == n * lengths.count(n) and r.documents_up_to == sum(x <= n for x in lengths) and r.tokens_up_to == sum(x for x in lengths if x <= n)
        assert r.documents_over == sum(x > n for x in lengths)
    got = {r.context_limit: (r.tokens, r.lost_tokens, r.cut_documents) for r in token_counts.truncated_totals(table, [0, 2, 5, 10 ** 7]).collect()}
    assert got == {k: (sum(min(x, k) for x in lengths), sum(x - min(x, k) for x in lengths), sum(x > k for x in lengths)) for k in (0, 2, 5, 10 ** 7)}
    got = {r.fraction: r.n_tokens for r in token_counts.length_quantiles(table, [0.2, 0.5, 1.0]).collect()}
    assert got == {q: sorted(lengths)[int(np.ceil(q * len(lengths))) - 1] for q in (0.2, 0.5, 1.0)}


def test_packing_of_repeated_rows(spark):
    rows = [(1, "one two", "x")] * 30 + [(None, "a", "x")] * 3
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3), TOKENS, capacity=8).collect()
    assert len(out) == 33 and Counter(r.doc_id for r in out) == {1: 30, None: 3}
    assert len({(r.sequence_id, r.offset) for r in out}) == 33


def test_warc_ties_and_nothing(spark):
    page = "é" * 600
    rows = [(5, "u", page, "x"), (5, "v", page, "x"), (3, "w", page, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, archive string").repartition(2)
    got = warc.read_records(warc.write_archives(df)).collect()
    assert sorted((r.page_id, r.record_type) for r in got if r.page_id == 3) == [(3, "revisit")] and sum(r.record_type == "response" for r in got) >= 1
    assert all(r.refers_to == 5 for r in got if r.record_type == "revisit")
    assert warc.read_records(warc.write_archives(df.limit(0))).collect() == []


def test_licence_index(spark):
    idf = {w: 1.0 + len(w) for w in licences.licence_words()}
    index = licences.build_index(idf)
    for t, (label, numbers, _, is_base) in enumerate(index.templates):
        own = [(w, k) for w, places in index.postings.items() for s, k in places if s == t]
        assert own and all(numbers[k] == w for w, k in own) and (len(own) == 1 or not is_base)
        if not is_base:  # words left out can't reach the score by themselves
            rest = sum(index.idf[numbers]) - sum(index.idf[w] for w, _ in own)
            assert rest < licences.LEAST_SCORE * sum(index.idf[numbers]) and 0 < index.least[t], label
    text = pa.array(["x " * 700_000 + licences.TEMPLATES["mit-text"][0], None, "", "mit"])
    _, doc, place, number = licences.Finder(index.vocabulary)(text)
    template, start = licences.candidates(index, (doc << 40) + place, number)
    labels = {(index.templates[t][0], s & ((1 << 40) - 1)) for t, s in zip(template.tolist(), start.tolist()) if s < 1 << 40}
    assert ("mit-text", 700_000) in labels
    rows = [(1, "Released under the MIT License", "x")] * 3 + [(None, "cc by", "x")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert Counter((r.doc_id, r.labels) for r in got) == {(1, "mit"): 3, (None, "cc-by"): 1}
    assert licences.scan(spark.createDataFrame(rows[:1], "doc_id long, text string, labels string").filter(F.lit(False))).collect() == []


def test_the_encoder_keeps_words_as_runs_of_one_array_and_forgets_them(monkeypatch):
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from rowtally.llm import encoding

    texts = ["Some words. and, more words...", None, "", "  ", "a <|endoftext|> b é. ., x" + " y1." * 3, "new words, later. Some"]
    path = public_tokenizers.path("word_bpe_49k.json")
    for most in (1 << 20, 3):
        monkeypatch.setattr(encoding, "_CACHE_WORDS", most)
        encoder = encoding.Encoder(path)
        for part in (texts[:2], texts[2:5], texts[5:], texts[:0], texts):
            ids, bounds = encoder.encode(pa.array(part, pa.string()))
            for text, a, b in zip(part, bounds[:-1], bounds[1:], strict=True):
                assert ids[a:b].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert ids.dtype == np.uint32 and len(encoder.words.lengths) == len(encoder.known)
