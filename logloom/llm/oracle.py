"""DuckDB SQL for the numbered queries that SQL can express."""

SQL = {
    "op1_line_dedup": r"""
WITH split AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), exploded AS (
    SELECT doc_id, text, unnest(lines) AS raw, unnest(range(len(lines))) AS pos FROM split WHERE text IS NOT NULL
), plain AS (
    SELECT doc_id, text, pos, string_split(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS tokens FROM exploded
), masked AS (
    SELECT *, list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS generic
    FROM plain WHERE tokens <> ['']
), parsed AS (
    SELECT doc_id, text, pos,
           CASE WHEN len(list_filter(generic, lambda t: t <> '<*>')) >= 0.7 * len(generic) THEN generic ELSE tokens END AS line
    FROM masked
), kinds AS (
    SELECT line, len(line) AS size, list_slice(line, 1, 3) AS lead,
           COUNT(DISTINCT doc_id) + MAX(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS n
    FROM parsed GROUP BY ALL
), candidates AS (
    SELECT *, COUNT(*) OVER leaf AS kinds FROM kinds
    WINDOW leaf AS (PARTITION BY size, lead) QUALIFY SUM(n) OVER leaf >= 5
), placed AS (
    SELECT *, unnest(line) AS token, unnest(range(size)) AS pos FROM candidates WHERE kinds > 1
), supported AS (
    SELECT *, CASE WHEN token <> '<*>' THEN SUM(n) OVER (PARTITION BY size, lead, pos, token) END AS support FROM placed
), levelled AS (
    SELECT *, MAX(support) OVER (PARTITION BY line) AS most FROM supported
), generalised AS (
    SELECT line, level, list(CASE WHEN support >= level THEN token ELSE '<*>' END ORDER BY pos) AS template
    FROM levelled JOIN (SELECT CAST(5 * 4 ** unnest(range(20)) AS BIGINT) AS level) levels ON level <= most
    GROUP BY line, level HAVING COUNT(*) FILTER (WHERE support >= level) >= 0.7 * COUNT(*)
), templates AS (
    SELECT DISTINCT c.line, COALESCE(g.template, c.line) AS template, 5 AS needed FROM candidates c LEFT JOIN generalised g ON c.line = g.line
    UNION ALL SELECT line, line, 2 FROM kinds WHERE size >= 50 AND n >= 2
), found AS (
    SELECT p.doc_id, p.text, p.pos, t.template, t.needed FROM parsed p JOIN templates t ON p.line = t.line
), recurring AS (
    SELECT template, needed, MIN(doc_id) AS first FROM found GROUP BY template, needed
    HAVING COUNT(DISTINCT doc_id) + MAX(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= needed
), dropped AS (
    SELECT doc_id, text, list(DISTINCT pos) AS gone FROM found JOIN recurring USING (template, needed)
    WHERE doc_id IS DISTINCT FROM first GROUP BY doc_id, text
)
SELECT s.doc_id,
       CASE WHEN d.gone IS NULL THEN s.text
            ELSE array_to_string(list_filter(s.lines, lambda line, nth: NOT list_contains(d.gone, nth - 1)), chr(10)) END AS text,
       CAST(COALESCE(len(s.lines), 0) AS BIGINT) AS n_lines, CAST(COALESCE(len(d.gone), 0) AS BIGINT) AS n_dropped
FROM split s LEFT JOIN dropped d ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.text = d.text
""",
    "op4_source_mixing": r"""
WITH sized AS (
    SELECT doc_id, source, md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS key,
           CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), sources AS (
    SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
           (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source
), filled AS (
    SELECT *, SUM(source_size) OVER () AS total,
           COALESCE(SUM(3 * source_size) OVER earlier, 0) AS limits_before,
           SUM(weight) OVER () - COALESCE(SUM(weight) OVER earlier, 0) AS weight_left
    FROM sources
    WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
    SELECT *, 3 * source_size * weight_left > weight * (total - limits_before) AS below FROM filled
), level AS (
    SELECT MAX(total) - COALESCE(SUM(3 * source_size) FILTER (WHERE NOT below), 0) AS words,
           COALESCE(SUM(weight) FILTER (WHERE below), 1) AS weights
    FROM marked
), shares AS (
    SELECT source, source_size,
           CASE WHEN below THEN weight * words ELSE 3 * source_size END AS numerator,
           CASE WHEN below THEN weights ELSE 1 END AS denominator
    FROM marked, level
), passes AS (
    SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE numerator // (denominator * source_size) END AS whole FROM shares
), placed AS (
    SELECT s.*, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before
    FROM sized s
)
SELECT doc_id, size, source_size, CAST(numerator AS DOUBLE) / CAST(denominator AS DOUBLE) AS target,
       CAST(size * (whole + CASE WHEN rest > 0 AND (2 * before + size) * denominator <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (SELECT *, numerator - whole * source_size * denominator AS rest FROM passes) p
JOIN placed d ON d.source IS NOT DISTINCT FROM p.source
""",
    "op10_warc_normaliser": r"""
WITH payloads AS (
    SELECT page_id, encode(COALESCE(html, '')) AS payload FROM pages
), digests AS (
    SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM payloads
), grouped AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN MAX(page_id) OVER (PARTITION BY payload_digest) END AS original FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original IS NULL OR page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM grouped
""",
    "op11_phrase_mining": r"""
WITH pieces AS (
    SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), places AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM worded
), counted AS (
    SELECT lang, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS phrase, CAST(COUNT(*) AS BIGINT) AS f
    FROM places CROSS JOIN (SELECT unnest([1, 2, 3]) AS size) sizes WHERE pos + size - 1 <= len(words) GROUP BY ALL
), totals AS (
    SELECT lang, CAST(SUM(f) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang
), frequent AS (
    SELECT * FROM counted WHERE f >= 10
), cuts AS (
    SELECT lang, phrase, f AS a, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS head,
           array_to_string(list_slice(string_split(phrase, ' '), k + 1, size), ' ') AS tail
    FROM frequent CROSS JOIN (SELECT unnest([1, 2]) AS k) ks WHERE k < size
), scores AS (
    SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r,
           CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
    FROM cuts c JOIN frequent h ON h.lang = c.lang AND h.phrase = c.head JOIN frequent t ON t.lang = c.lang AND t.phrase = c.tail
), lowest AS (
    SELECT * FROM scores QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covers AS (
    SELECT lang, phrase, MAX(f) AS held FROM (
        SELECT lang, f, array_to_string(list_slice(string_split(phrase, ' '), 1, 2), ' ') AS phrase FROM frequent WHERE size = 3
        UNION ALL SELECT lang, f, array_to_string(list_slice(string_split(phrase, ' '), 2, 3), ' ') FROM frequent WHERE size = 3
    ) inside GROUP BY lang, phrase
), ranked AS (
    SELECT l.*, ROW_NUMBER() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank
    FROM lowest l LEFT JOIN covers c ON c.lang = l.lang AND c.phrase = l.phrase
    WHERE c.held IS NULL OR 100 * c.held < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op12_fill_in_middle": r"""
WITH cut AS (
    SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\n]*\n|[^\n]+') AS units,
           sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS draw
    FROM documents
), drawn AS (
    SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % (len(units) + 1) AS one,
           CAST('0x' || substr(draw, 9, 8) AS BIGINT) % (len(units) + 1) AS two, CAST('0x' || substr(draw, 25, 8) AS BIGINT) % 100 AS form
    FROM cut
), parts AS (
    SELECT doc_id, text, n,
           CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN form < 50 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(list_slice(units, 1, LEAST(one, two)), '') AS prefix,
           array_to_string(list_slice(units, LEAST(one, two) + 1, GREATEST(one, two)), '') AS middle,
           array_to_string(list_slice(units, GREATEST(one, two) + 1, n), '') AS suffix
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
""",
}
