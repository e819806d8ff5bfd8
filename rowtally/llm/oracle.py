"""SQL for the queries that SQL can express: each states the contract in full, not the method."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""


def _word_rows(text: str, pattern: str) -> str:
    """doc_id, pos and w of each word of the documents."""
    found = f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"
    return f"SELECT doc_id, unnest({found}) AS w, generate_subscripts({found}, 1) AS pos FROM documents"


def _run(n: int) -> str:
    """The word of a row and the n - 1 that follow it; null if there are fewer."""
    return " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER here" for k in range(1, n))])


REPEATS = rf"""
WITH words AS ({_word_rows("text", r"[^\x20\x09-\x0D]+")}),
runs AS (SELECT doc_id, pos, w, {_run(20)} AS run FROM words WINDOW here AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
    SELECT doc_id, pos, w, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS repeated
    FROM runs),
cut AS (
    SELECT doc_id, pos, w,
        bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
    FROM later),
kept AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
        sha256(coalesce(string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM cut GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
    coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""


def _list_words(table: str, key: str) -> str:
    """The words of each text as a list, without case and punctuation."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lowered = _LOWER.format("coalesce(text, '')")
    return f"SELECT {key}, regexp_extract_all({lowered}, '{pattern}') AS w FROM {table}"


LEAKS = rf"""
WITH item_words AS ({_list_words("benchmark", "item_id")}),
item_runs AS (SELECT item_id, w, least(len(w), 5) AS width FROM item_words WHERE len(w) > 0),
item_shingles AS (
    SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS shingle
    FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM item_runs)),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
doc_words AS ({_list_words("documents", "doc_id")}),
texts AS (SELECT doc_id, row_number() OVER () AS text_id, ' ' || array_to_string(w, ' ') || ' ' AS spaced FROM doc_words WHERE doc_id IS NOT NULL),
held AS (
    SELECT doc_id, text_id, item_id, count(*) AS n_held
    FROM texts JOIN item_shingles ON contains(spaced, ' ' || shingle || ' ') GROUP BY doc_id, text_id, item_id),
shared AS (SELECT doc_id, item_id, max(n_held) AS n_shared FROM held GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n::INTEGER AS n_shingles, n_shared::INTEGER AS n_shared, n_shared::DOUBLE / n AS containment
FROM shared JOIN sizes USING (item_id) WHERE 5 * n_shared >= 4 * n"""

ARCHIVES = """
WITH records AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS payload FROM pages),
responses AS (SELECT payload, max(page_id) AS first_id FROM records WHERE payload_bytes >= 1000 GROUP BY payload)
SELECT page_id, payload_bytes, sha1(r.payload) AS payload_digest,
    CASE WHEN page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < first_id THEN first_id END AS refers_to
FROM records r LEFT JOIN responses l ON r.payload = l.payload"""

JACCARD = rf"""
WITH RECURSIVE words AS ({_word_rows(_LOWER.format("text"), r"[^\x20\x09-\x0D]+")}),
runs AS (SELECT doc_id, pos, {_run(4)} AS run FROM words WINDOW here AS (PARTITION BY doc_id ORDER BY pos)),
short AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS run FROM words GROUP BY doc_id HAVING count(*) < 4),
shingles AS (SELECT DISTINCT doc_id, run FROM runs WHERE run IS NOT NULL UNION ALL SELECT doc_id, run FROM short),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_common
    FROM shingles x JOIN shingles y ON x.run = y.run AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM met JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * n_common >= 85 * (s.n + t.n - n_common)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.a = d.doc_id"""

EMBEDDINGS = f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
{_REACH},
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
    vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN lowest l ON l.a = e.vec_id"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of short ASCII text, bit by bit."""
    shifted = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce([4294967295] || [ascii(c)::BIGINT FOR c IN string_split({text}, '')], lambda c, b: {shifted}), 4294967295)"


def _digest(*values: str) -> str:
    return f"sha256({' || '.join(f'coalesce(strlen({v}) || chr(58) || {v}, chr(45))' for v in values)})"


def _levels(source: str) -> str:
    """What stands above a list of nodes until one is left."""
    return f"""SELECT lang, 0 AS level, nodes FROM {source} UNION ALL
    SELECT lang, level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)]"""




def _leaf(n_chars: str) -> str:
    return _digest("doc_id::VARCHAR", "source", "lang", f"{n_chars}::VARCHAR", "text")


MANIFEST = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS tampered, n_chars,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM documents),
groups AS (SELECT lang, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang),
trees AS ({_levels("groups")} FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM trees WHERE len(nodes) = 1),
top AS (SELECT NULL AS lang, list(subroot ORDER BY place) AS nodes FROM subroots),
tops AS ({_levels("top")} FROM tops WHERE len(nodes) > 1),
places AS (
    SELECT l.doc_id, l.lang, 0 AS tree, t.level, (l.pos >> t.level) AS p, t.nodes
    FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
    UNION ALL
    SELECT l.doc_id, l.lang, 1, t.level, (s.place >> t.level), t.nodes
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN tops t WHERE len(t.nodes) > 1),
siblings AS (
    SELECT doc_id, string_agg(coalesce(nodes[xor(p, 1) + 1], ''), '' ORDER BY tree, level) AS joined,
        list(CASE WHEN p % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(nodes[xor(p, 1) + 1], '') ORDER BY tree, level) AS steps
    FROM places GROUP BY doc_id),
folded AS (
    SELECT l.doc_id, leaf, subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, sha256(coalesce(joined, '')) AS proof_sha256,
        list_reduce([CASE WHEN {_crc32("l.doc_id::VARCHAR")} % 7 = 0 THEN coalesce(tampered_or_null, leaf) ELSE leaf END] || coalesce(steps, []),
            lambda d, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || d) ELSE sha256(d || s[2:]) END) AS folded_root
    FROM (SELECT *, CASE WHEN n_chars IS NOT NULL THEN tampered END AS tampered_or_null FROM leaves) l
    JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN siblings b ON b.doc_id = l.doc_id)
SELECT *, folded_root = root AS verified FROM folded"""


def _escaped(text: str) -> str:
    """Backslashes doubled, then one set behind the first character of each control string."""
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for c in ("<|turn|>", "<|text|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


CHATS = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
placed AS (
    SELECT *, length('<|turn|>' || {_escaped("role")} || '<|text|>' || {_escaped("text")} || '</s>') AS size,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
summed AS (
    SELECT *, sum(size) OVER (PARTITION BY conv_id, pos // 256 ORDER BY pos) AS upto,
        (pos % 256 = 255 AND pos + 1 < n) OR (pos + 1 = n AND role <> 'assistant') AS tail FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (coalesce(sum(upto) FILTER (role = 'assistant'), 0) + coalesce(sum(upto) FILTER (tail), 0))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id"""


def _unit(salt: str) -> str:
    """A number between 0 and 1 from the MD5 of doc_id and a salt."""
    return f"((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || {salt}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)"


SHARDS = f"""
WITH RECURSIVE steps AS (
    SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM steps WHERE k < 8),
lookup AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
sized AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
        xor(list_reduce([4294967295] || [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(coalesce(text, '')), '..')],
            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
    FROM documents, lookup),
scored AS (
    SELECT *, [{{'score': -1 / ln({_unit("s::VARCHAR")}), 'shard': s::INTEGER}} FOR s IN range(17)] AS scores, floor({_unit("'slot'")} * 1024) AS part FROM sized),
dealt AS (SELECT *, list_max(scores[:16]).shard AS shard, list_max(scores).shard AS grown_shard FROM scored)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id) - 1 AS slot, grown_shard FROM dealt"""

ORACLE = {
    "op1_substring_dedup": REPEATS,
    "op3_sharding": SHARDS,
    "op4_decontamination": LEAKS,
    "op6_warc": ARCHIVES,
    "op8_jaccard_join": JACCARD,
    "op9_embedding_dedup": EMBEDDINGS,
    "op11_merkle_manifest": MANIFEST,
    "op13_chat_format": CHATS,
}
