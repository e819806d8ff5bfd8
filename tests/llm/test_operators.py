"""The operators against brute force, on small tables with nulls, empty texts, copies, repeated ids and further columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowtally.llm import contamination, embeddings, jaccard, licences, packing, sharding, substrings, token_counts, toxicity, warc

TOKENS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_words string, source string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    passage, base = prose(rng, 60), prose(rng, 150).split()
    out = [prose(rng, int(n)) for n in rng.integers(1, 120, 40)]
    out += [f"{prose(rng, 30)}\n{passage} {prose(rng, 15)}" for _ in range(8)]
    for _ in range(25):
        words = list(base)
        for i in rng.integers(0, 150, int(rng.integers(0, 9))):
            words[i] = f"x{rng.integers(0, 99)}"
        out.append(" ".join(words))
    out += [None, "", "  \t", "one", "one two", "ONE two", "a b c d", "same " * 90, "same " * 90, prose(rng, 4000)]
    return [(i, t, "x", None) for i, t in enumerate(out)] + [(None, passage, None, None)]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_substrings(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()}
    words = {i: (t or "").encode().split() for i, t, *_ in rows}
    first = {}
    for i in sorted(k for k in words if k is not None):
        for s in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][s:s + 20]), (i, s))
    for i, w in words.items():
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            if i is not None and first[tuple(w[s:s + 20])] < (i, s):
                keep[s:s + 20] = [False] * 20
        left = [x for x, k in zip(w, keep) if k]
        assert got[i] == (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()), i


@pytest.mark.parametrize("n, percent, tree", [(4, 85, 192), (5, 80, 192), (4, 85, 4)])
def test_jaccard(docs, rows, monkeypatch, n, percent, tree):
    monkeypatch.setattr(jaccard, "TREE_ROWS", tree)
    monkeypatch.setattr(jaccard, "REST_ROWS", tree)
    monkeypatch.setattr(jaccard, "WIDE", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs, n, percent).collect()}
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    assert got.pop(None) == (len(sets.pop(None)), None)
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {i: x if v == y else v for i, v in label.items()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize("tree", [192, 4])
def test_jaccard_of_repeated_ids(spark, monkeypatch, tree):
    monkeypatch.setattr(jaccard, "TREE_ROWS", tree)
    monkeypatch.setattr(jaccard, "REST_ROWS", tree)
    monkeypatch.setattr(jaccard, "WIDE", 1)
    rng = np.random.default_rng(4)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(3, a), (5, a), (5, f"{b} x"), (7, b), (8, prose(rng, 50)), (8, None), (9, c), (9, ""), (2, f"{c} x"), (9, prose(rng, 40)), (5, a), (6, ""), (None, a)]
    rows += [(20 + i % 9, f"{b} {i}") for i in range(20)] + [(40 + i, prose(rng, 40)) for i in range(4)] + [(41, prose(rng, 40))]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    near = {3, 5, 7, *range(20, 29)}
    for r in got:
        assert r.component_id == (3 if r.doc_id in near else 2 if r.doc_id in (2, 9) else r.doc_id), r


@pytest.mark.parametrize("tree", [192, 3])
def test_jaccard_of_many_that_share_a_line(spark, monkeypatch, tree):
    monkeypatch.setattr(jaccard, "TREE_ROWS", tree)
    monkeypatch.setattr(jaccard, "REST_ROWS", tree)
    monkeypatch.setattr(jaccard, "WIDE", 1)
    rng = np.random.default_rng(8)
    line, texts = prose(rng, 12), []
    for _ in range(60):
        own = prose(rng, int(rng.integers(20, 60)), 5000).split()
        near = [*own[:-1], "other"]
        texts += [f"{line} {' '.join(own)}", f"{line} {' '.join(near)}"] if rng.random() < 0.5 else [f"{' '.join(own)} {line}"]
    texts += [prose(rng, 300, 9) for _ in range(12)] + [f"{line} {w}" for w in "abcdefgh"]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect()}
    sets = [{tuple(t.split()[k:k + 4]) for k in range(len(t.split()) - 3)} for t in texts]
    label = list(range(len(texts)))
    for _ in label:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label)) and len(set(label)) < len(label)


def test_signatures_agree():
    """Linked sets have as many equal signatures as their class says."""
    rng = np.random.default_rng(9)
    for percent in (80, 85):
        sizes = jaccard.Sizes(percent)
        for n in [5, 8, 12, 20, 24, 30, 60, 200]:
            for _ in range(60):
                base = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
                a = np.unique(base[:n])
                most = (100 - percent) * 2 * n // (100 + percent)
                gone = rng.permutation(n)[:int(rng.integers(0, most + 1))]
                b = np.unique(np.concatenate([np.delete(a, gone[:len(gone) // 2]), base[n:n + len(gone) - len(gone) // 2]]))
                if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)) or np.array_equal(a, b):
                    continue
                text, sig, firm = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), sizes)
                common = np.intersect1d(sig[text == 0], sig[text == 1])
                kind = sizes.of(np.array([min(len(a), len(b))]))[0]
                counted = np.intersect1d(common, sig[firm]) if sizes.agreed[kind] > 1 else common
                assert len(counted) >= sizes.agreed[kind]


def test_contamination(spark, docs, rows):
    items = [(0, " ".join(rows[41][1].split()[30:70]).upper() + "!"), (1, "never seen words in any text"), (2, "one two"), (3, None), (4, "")]
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, 0) for i in range(40, 48)} | {(i, 2) for i, t, *_ in rows if i is not None and " one two " in f" {(t or '').lower()} "}
    assert got == want
    assert contamination.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_packing_and_counts(docs, rows):
    tokenizer = Tokenizer.from_file(TOKENS)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    got = packing.pack(docs, TOKENS, capacity=256).collect()
    want = {(i, k): (a, len(v[a:a + 256]), zlib.crc32(np.array(v[a:a + 256], "<u4").tobytes())) for i, v in ids.items() for k, a in enumerate(range(0, len(v), 256))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(map(len, ids.values())) // 256) * 1.05 + 1
    lengths = Counter(len(v) - 1 for v in ids.values())
    table = token_counts.length_histogram(docs, TOKENS)
    for r in table.collect():
        assert r.documents == lengths[r.n_tokens] and r.truncated_tokens == sum(min(n, r.n_tokens) * c for n, c in lengths.items())


def test_sharding(spark, docs):
    even = {s: 1.0 for s in range(16)}
    out = sharding.shard_by_key(docs.select("doc_id"), "doc_id", even, {**even, 16: 1.0}).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in out)
    for s in range(16):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def test_warc(spark):
    page = "<p>é</p>" * 200
    rows = [(1, "http://a/1", page), (2, None, page), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (None, "u", page)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert len(got) == 6 and got[2].record_type == "response" and bytes(got[2].payload) == page.encode()
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("revisit", 2, len(page.encode())) and got[None].refers_to == 2
    assert got[3].payload_bytes == 0 and {got[4].record_type, got[5].record_type} == {"response"}


def test_licences(spark):
    rows = [(0, "Licensed under CC BY-NC 4.0. cc  by"), (1, None), (2, "All rights reserved. all Rights, reserved"), (3, "Released under the MIT License."), (4, "a version 2 0 by")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].labels) == (2, 2, 7, "cc-by", "cc-by,cc-by-nc-4.0")
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (2, 0, 3) and got[3].labels == "mit" and got[3].n_base == 0
    assert got[1].n_words == 0 and got[1].first_word is None and got[4].labels == ""


def test_licences_against_every_place(spark):
    rng = np.random.default_rng(11)
    split = lambda text: re.findall("[a-z0-9]+", text.lower())
    texts = ["Apache License Version 2.0", "x Apache License Version 2.0", "the Mozilla Public License v 2.0", "mit license", "CC BY 4.0", None]
    pool = [*licences.licence_words(), "x", "y"]
    for text, _ in licences.TEMPLATES.values():
        for _ in range(12):
            own = split(text)[int(rng.integers(0, 4)):len(split(text)) - int(rng.integers(0, 3))]
            for i in np.flatnonzero(rng.random(len(own)) < 0.12):
                own[i] = pool[int(rng.integers(0, len(pool)))]
            before = rng.integers(0, len(pool), int(rng.integers(0, 4)))
            texts.append(" ".join([*(pool[i] for i in before), *own, *(["y", *own] if rng.random() < 0.3 else [])]))
    texts += ["filler words"] * 300
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    words = [split(t or "") for t in texts]
    idf = {w: np.log((len(texts) + 1) / (sum(w in x for x in words) + 1)) + 1 for w in pool}
    holds = lambda window, p: any(window[i:i + len(p)] == p for i in range(len(window) - len(p) + 1))
    for doc, own in enumerate(words):
        best, labels, starts = 0.0, set(), []
        for phrase, label in licences.BASE_PHRASES.items():
            at = [i for i in range(len(own)) if own[i:i + len(phrase.split())] == phrase.split()]
            starts += at
            labels |= {label} if at else set()
            best = 1.0 if at else best
        base = set(labels)
        for label, (text, phrases) in licences.TEMPLATES.items():
            wanted = text.split()
            for start in range(-len(wanted), len(own) + 1):
                window = [own[i] if 0 <= i < len(own) else None for i in range(start, start + len(wanted))]
                value = sum(idf[a] for a, b in zip(wanted, window) if a == b) / sum(idf[a] for a in wanted)
                if value >= licences.LEAST_SCORE and all(holds(window, p.split()) for p in phrases):
                    labels, best = labels | {label}, max(best, value)
        r = got[doc]
        assert (r.labels, r.base_labels, r.n_base) == (",".join(sorted(labels)), ",".join(sorted(base)), len(starts)), texts[doc]
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None)) and r.score == pytest.approx(best)
    assert got[0].labels == "apache-2.0"


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 16))
    x[30:] = x[rng.integers(0, 6, 30)] + rng.normal(0, 0.1, (30, 16))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[0].tolist()), (61, None), (62, [0.0] * 16), (63, [float("nan")] + [1.0] * 15), (64, [None] + [1.0] * 15), (65, [1.0, 2.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    unit = np.vstack([x, x[:1]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    label = np.arange(61)
    for _ in range(61):
        label = np.where(near, label, 99).min(1)
    assert {i: got[i] for i in range(61)} == {i: (near[i].sum() - 1, label[i]) for i in range(61)}
    assert all(got[i] == (0, i) for i in range(61, 66))


def test_toxicity_held_out(spark):
    from rowtally.llm.queries import op2_toxicity, table

    labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in op2_toxicity(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.9 * len(rows)
    machine = toxicity.fit(table(spark, "/root/testdata/sf0.01", "documents"), spark.createDataFrame([], "doc_id long, y int"))
    assert toxicity.with_score(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"), machine).first()._score == 0.5


def test_toxicity_of_pairs_of_words(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(13000):  # toxic where one of two words stands and the other doesn't, so that each is balanced by itself
        a, b = i % 2, i // 2 % 2
        filler = " ".join(f"{k}word" for k in rng.integers(1000, 3300, 4))
        rows.append((i, " ".join([filler, *["ga"] * a, *["ib"] * b]), a ^ b))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    machine = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows[:12000]], "doc_id long, y int"))
    got = {r.doc_id: r._score for r in toxicity.with_score(docs.filter("doc_id >= 12000"), machine).collect()}
    assert sum((got[i] >= 0.5) == y for i, _, y in rows[12000:]) >= 850


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substrings.remove_repeats(none).count() == jaccard.jaccard_groups(none).count() == packing.pack(none, TOKENS).count() == 0
    assert licences.scan(none).count() == token_counts.length_histogram(none, TOKENS).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_substrings_shuffles_texts_once(spark, docs):
    """Both joins on doc_id read one exchange of the texts."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        plan = substrings.remove_repeats(docs.withColumn("more", docs.source), texts=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    joined = ["ReusedExchange" in line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert sorted(joined) == [False, False, False, True], plan
