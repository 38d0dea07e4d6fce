"""SQL twins of the registered queries, where SQL can express them."""

ORACLES = {
    "op1_line_frequency": r"""
WITH lines AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body, i,
           string_split(coalesce(text, ''), chr(10))[i] AS line
    FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i)
    WHERE regexp_matches(string_split(coalesce(text, ''), chr(10))[i], '[^\x20\x09-\x0D]')
), form AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'),
                             '^ | $', '', 'g') AS norm,
           len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
    FROM lines
), hosts AS (
    SELECT coalesce(source, '') AS host, greatest(20, count(DISTINCT coalesce(text, '')) * 0.05) AS most FROM documents GROUP BY 1
), common AS (
    SELECT host, norm FROM form JOIN hosts USING (host) GROUP BY host, norm, most HAVING count(DISTINCT body) > most
), removed AS (
    SELECT doc_id, sum(words)::BIGINT AS removed_words FROM form JOIN common USING (host, norm) GROUP BY 1
), dups AS (
    SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines GROUP BY 1
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)
), windows AS (
    SELECT doc_id, i, word, lead(word) OVER d AS b, lead(word, 2) OVER d AS c FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), again AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM windows WHERE c IS NOT NULL
), repeats AS (
    SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM again, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY 1
), base AS (
    SELECT doc_id, count(*)::BIGINT AS n_words, sum(length(word))::BIGINT AS word_chars FROM words GROUP BY 1
), counts AS (
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
           length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
           coalesce(removed_words, 0) AS removed_words
    FROM documents d LEFT JOIN base USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)
    LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT removed_words > 0.5 * n_words AS kept, removed_words
FROM counts""",
    # DuckDB has no CRC-32: bytes are folded with the 256 remainders of the reflected polynomial 0xEDB88320
    "op3_sharding": r"""
WITH RECURSIVE remainders AS (
    SELECT i, i AS v, 0 AS bit FROM range(256) r(i)
    UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, bit + 1 FROM remainders WHERE bit < 8
), lookup AS (
    SELECT list(v ORDER BY i) AS t FROM remainders WHERE bit = 8
), sizes AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
           xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
               lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]))) AS text_crc32
    FROM documents, lookup
), running AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
           row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS nth, sum(size) OVER () AS total
    FROM sizes
), cut AS (
    SELECT *, least(7, (2 * before + size) * 8 // (2 * total))::INTEGER AS shard FROM running
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (nth - min(nth) OVER (PARTITION BY shard))::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM cut""",
    # rules of any length are counted over all subsets of a URL's tokens instead of mined
    "op2_url_rules": r"""
WITH RECURSIVE cut AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), hosts AS (
    SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS h, coalesce(rest, '') AS rest FROM cut
), paths AS (
    SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path,
           regexp_extract(substr(rest, length(h) + 1), '^[^?#]*[?]([^#]*)', 1) AS query
    FROM hosts
), rules(kind, rhost, rpath) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), ruled AS (
    SELECT page_id, host, path, query, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
           arg_max(kind, length(rhost || rpath)) AS kind
    FROM paths LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY ALL
), parts AS (
    SELECT page_id, 'h' || generate_subscripts(v, 1) - 1 || ':' AS k, unnest(v) AS v FROM (SELECT page_id, list_reverse(string_split(host, '.')) AS v FROM ruled)
    UNION
    SELECT page_id, 'p' || generate_subscripts(v, 1) - 1 || ':', unnest(v) FROM (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS v FROM ruled)
    UNION
    SELECT page_id, 'q:', string_split(unnest(list_filter(string_split(query, '&'), lambda x: x <> '')), '=')[1] FROM ruled
), tokens AS (
    SELECT page_id, t, row_number() OVER (PARTITION BY page_id ORDER BY t) AS i
    FROM (SELECT DISTINCT page_id, k || v AS t FROM parts WHERE v IS NOT NULL AND (v <> '' OR k = 'q:'))
), sets AS (
    SELECT page_id, i, [t] AS held FROM tokens
    UNION ALL
    SELECT s.page_id, t.i, list_append(s.held, t.t) FROM sets s JOIN tokens t ON t.page_id = s.page_id AND t.i > s.i
), mined AS (
    SELECT held, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY held) AS seen
    FROM sets JOIN ruled USING (page_id) WHERE kind IS NOT NULL GROUP BY held, kind
), kept AS (
    SELECT held, kind, n / seen AS confidence FROM mined
    WHERE n >= least(ceil(0.01 * (SELECT count(*) FROM ruled WHERE kind IS NOT NULL)), 5) AND n / seen >= 0.8
), fired AS (
    SELECT page_id, max(confidence) FILTER (kept.kind = 'block') AS block_confidence,
           max(confidence) FILTER (kept.kind = 'allow') AS allow_confidence
    FROM sets JOIN kept USING (held) GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(kind, CASE WHEN coalesce(block_confidence, 0) > coalesce(allow_confidence, 0) THEN 'block' ELSE 'allow' END) AS verdict,
       block_confidence, allow_confidence
FROM ruled LEFT JOIN fired USING (page_id)""",
    "op7_minhash_dedup": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) > 1 THEN w[i] || ' ' || w[i + 1] ELSE w[1] END AS s
    FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 1, least(len(w), 1)))) AS i)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), lowest AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM lowest LEFT JOIN sizes USING (doc_id)""",
    "op8_embedding_dedup": r"""
WITH RECURSIVE good AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.9
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), lowest AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
    SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM lowest LEFT JOIN counts USING (vec_id)""",
    "op13_hard_negatives": r"""
WITH good AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER nearest)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW nearest AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER nearest <= 10""",
}
