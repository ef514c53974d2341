"""The same answers in DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LINE_DEDUP = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(
        regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), owners AS (
    SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
    SELECT keyed.*, coalesce(owners.owner < keyed.doc_id, false) AS gone FROM keyed LEFT JOIN owners USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUALITY_RULES = r"""
WITH words AS (
    SELECT doc_id, unnest(@words) AS word, generate_subscripts(@words, 1) AS place FROM documents
), windows AS (
    SELECT doc_id, place, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS three
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), twice AS (
    SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, three) AS times FROM windows WHERE three IS NOT NULL
), covered AS (
    SELECT doc_id, count(DISTINCT spot) AS n FROM (
        SELECT doc_id, unnest([place, place + 1, place + 2]) AS spot FROM twice WHERE times > 1
    ) GROUP BY doc_id
), lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), repeated AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
    SELECT doc_id, source, len(@words) AS n_words,
           length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
           coalesce(repeated.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM documents LEFT JOIN covered USING (doc_id) LEFT JOIN repeated USING (doc_id)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), hosts AS (
    SELECT source AS host, count(*) AS docs, sum(CAST(base_failed AS INT)) AS failed FROM judged GROUP BY source
), moments AS (
    SELECT sum(failed) / sum(docs) AS mean, var_samp(failed / docs) AS spread FROM hosts
), prior AS (
    SELECT mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE 1000 END, 2), 1000) AS weight
    FROM moments
), verdicts AS (
    SELECT host, (failed + mean * weight) / (docs + weight) > 0.5 AS rejected FROM hosts, prior
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN verdicts ON source IS NOT DISTINCT FROM host
""".replace("@words", WORDS)


NEAR_COPIES = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(max(n), 0) AS n_links, min(reach.b) AS component_id, vec_id = min(reach.b) AS kept
FROM embeddings JOIN reach ON vec_id = reach.a LEFT JOIN counted ON vec_id = counted.a GROUP BY vec_id
"""


def _crc32(number: str) -> str:
    """The unsigned crc32 of a number in decimal, bit by bit."""
    bit = "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"lambda crc, letter: list_reduce(list_prepend(xor(crc, letter), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    letters = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), {byte}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {_leaf("text")} AS leaf,
           CASE WHEN {_crc32("doc_id")} % 3 = 0
                THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS shown,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS place
    FROM documents
), nodes AS (
    SELECT lang, 0 AS level, place, leaf AS digest FROM leaves
    UNION ALL
    SELECT lang, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER (PARTITION BY lang, level) AS n FROM nodes) WHERE n > 1 GROUP BY lang, level, place // 8
), heights AS (
    SELECT lang, max(level) AS height FROM nodes GROUP BY lang
), subroots AS (
    SELECT nodes.lang, height, digest AS subroot, row_number() OVER (ORDER BY nodes.lang NULLS FIRST) - 1 AS place
    FROM nodes JOIN heights ON nodes.lang IS NOT DISTINCT FROM heights.lang AND level = height
), tops AS (
    SELECT 0 AS level, place, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM tops) WHERE n > 1 GROUP BY level, place // 8
), steps AS (
    SELECT doc_id, level, n.place, digest, n.place = l.place // (8 ** level)::BIGINT AS own
    FROM leaves l JOIN heights h ON l.lang IS NOT DISTINCT FROM h.lang
    JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND level < height AND n.place // 8 = l.place // (8 ** (level + 1))::BIGINT
    UNION ALL
    SELECT doc_id, height + level, t.place, digest, t.place = s.place // (8 ** level)::BIGINT
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
    JOIN tops t ON level < (SELECT max(level) FROM tops) AND t.place // 8 = s.place // (8 ** (level + 1))::BIGINT
), folds AS (
    SELECT doc_id, 0 AS level, shown AS digest FROM leaves
    UNION ALL
    SELECT doc_id, level + 1, sha256(string_agg(CASE WHEN own THEN folded ELSE digest END, '' ORDER BY place))
    FROM (SELECT steps.*, folds.digest AS folded FROM folds JOIN steps USING (doc_id, level)) GROUP BY doc_id, level
), proofs AS (
    SELECT doc_id, sha256(coalesce(string_agg(digest, '' ORDER BY level, steps.place) FILTER (NOT own), '')) AS proof_sha256
    FROM leaves LEFT JOIN steps USING (doc_id) GROUP BY doc_id
), folded AS (
    SELECT doc_id, max_by(digest, level) AS folded_root FROM folds GROUP BY doc_id
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots ON leaves.lang IS NOT DISTINCT FROM subroots.lang
JOIN proofs USING (doc_id) JOIN folded USING (doc_id) CROSS JOIN (SELECT max_by(digest, level) AS root FROM tops)
"""


TRIE = f"""
WITH turns AS (
    SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, length(coalesce(text, '')) AS size,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT *, least(h, (SELECT count(*) FROM turns WHERE turns.conv_id = c.conv_id - c.conv_id % 100)) AS taken
    FROM (SELECT DISTINCT conv_id, {_crc32("conv_id")} % 6 AS h FROM turns) c
), rebuilt AS (
    SELECT convs.conv_id, n AS depth, said, size FROM convs JOIN turns ON turns.conv_id = convs.conv_id - convs.conv_id % 100 AND n <= h
    UNION ALL
    SELECT convs.conv_id, taken + n - h, said, size FROM convs JOIN turns ON turns.conv_id = convs.conv_id AND n > h
), steps AS (
    SELECT conv_id, depth, size, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), ended AS (
    SELECT conv_id, max(depth) AS last FROM steps GROUP BY conv_id
), nodes AS (
    SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(size) AS size,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
    FROM steps JOIN ended USING (conv_id) GROUP BY path
), parents AS (
    SELECT *, CASE WHEN depth > 0 THEN left(path, length(path) - 64) END AS parent FROM nodes
), children AS (
    SELECT parent AS path, count(*) AS n FROM parents WHERE parent IS NOT NULL GROUP BY parent
), facts AS (
    SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)
), sums AS (
    SELECT s.path, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved_tokens
    FROM facts f JOIN steps s ON s.conv_id = f.conv_id AND s.depth <= f.depth GROUP BY s.path
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN parents USING (path) JOIN sums USING (path) LEFT JOIN nodes p ON p.path = parents.parent
"""


WARC = """
WITH hashed AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), fives AS (
    SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 1 + 5 * g, 5) AS INT) >> (15 - 5 * k)) & 31 AS INT) + 1, 1), '' ORDER BY g, k) AS digest
    FROM (SELECT DISTINCT hex FROM hashed), range(8) a(g), range(4) b(k) GROUP BY hex
), owners AS (
    SELECT hex, max(page_id) AS owner FROM hashed GROUP BY hex
)
SELECT page_id, strlen(body) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM hashed JOIN fives USING (hex) JOIN owners USING (hex)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_near_dedup": NEAR_COPIES,
        "op7_line_dedup": LINE_DEDUP,
        "op9_quality_rules": QUALITY_RULES,
        "op11_merkle_manifest": MERKLE,
        "op12_conversation_trie": TRIE,
        "op13_warc": WARC,
    }
