"""DuckDB SQL for the training-data queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLES = {
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {NORM} AS norm, length(coalesce(text, '')) AS n FROM documents),
        g AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS rn,
                     count(*) OVER (PARTITION BY norm) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op8_url_filter": r"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url,
                          CASE WHEN contains(coalesce(url, ''), '://')
                               THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT *, CASE
            WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')
                THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/')
                THEN 'example.com/en/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
            END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN host IN (SELECT host FROM p WHERE contains(url, 'utm_')) THEN 'block'
            ELSE 'allow' END AS verdict FROM r""",
    "op9_mixing": f"""
        WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(text, '')) AS tie,
                          md5(coalesce(doc_id::VARCHAR, '') || '|42') AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM s),
        c AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(i % 3 + 1)::INT] AS weight, 3 * source_size AS most FROM w),
        l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, i
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, i
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM c),
        t AS (SELECT source, source_size, least(most::DOUBLE, weight * (SELECT arg_min(level, (most / weight, i))
                     FROM l WHERE most >= level * weight)) AS target FROM l),
        r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY
                     lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 4),
                     substr(key, 1, 1), size, key, doc_id, tie) AS pos FROM d),
        o AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.pos,
                     CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                     ('0x' || substr(md5(CASE WHEN r.source IS NULL THEN '' ELSE 's' || r.source END || '|42'),
                                     1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS offs
              FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (floor(rate * pos + offs) - floor(rate * (pos - 1) + offs))::BIGINT * size AS taken FROM o""",
    "op10_chat": """
        WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        e AS (SELECT *, length(replace(replace(text, '\\', '\\b'), '<', '\\l'))
                        + length(replace(replace(role, '\\', '\\b'), '<', '\\l')) + 20 AS n FROM a)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    # every vector against every other: the filters must not miss a link of the test tables
    "op12_cap_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        s AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
              WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b
              ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
        r AS (SELECT vec_id AS node, vec_id AS hit FROM embeddings
              UNION SELECT r.node, l.b FROM r JOIN l ON r.hit = l.a),
        c AS (SELECT node, min(hit) AS component_id FROM r GROUP BY node),
        k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN k ON k.a = vec_id""",
    # the formula as it stands: every kept term for every group and pair
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                       'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        n AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        gn AS (SELECT lang, source, sum(c) AS n FROM n GROUP BY lang, source),
        lv AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM k GROUP BY lang),
        p AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c,
                     1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 2)) // (coalesce(gn.n, 0) + 2 * lv.v) AS p,
                     1 + (1000000000::HUGEINT * (k.lc + 2)) // (lv.ln + 2 * lv.v) AS q
              FROM g JOIN k USING (lang) JOIN lv USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
              LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
        pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q),
        w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM w WHERE part = 'pair' OR rank <= 10""",
}
