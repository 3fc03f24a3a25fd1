"""DuckDB SQL for the queries that SQL can express on whole tables."""

ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
        g AS (SELECT digest, max(page_id) AS response_id FROM d WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
        SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN g.response_id IS NOT NULL AND g.response_id IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.response_id IS NOT NULL AND g.response_id IS DISTINCT FROM d.page_id THEN g.response_id END AS refers_to
        FROM d LEFT JOIN g ON d.n >= 1000 AND d.digest = g.digest
    """,
    "op9_preferences": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
        k AS (SELECT conv_id, turns, len(turns) - list_position(list_reverse(list_transform(turns, lambda x: x.role = 'assistant')), true) + 1 AS cut FROM c WHERE len(list_filter(turns, lambda x: x.role = 'assistant')) > 0),
        d AS (SELECT conv_id, turns[1:cut] AS turns, md5(turns[1].role || chr(31) || turns[1].text) AS opening, md5(conv_id::VARCHAR) AS digest FROM k),
        e AS (SELECT conv_id, turns AS chosen, coalesce(lead(turns) OVER u, first_value(turns) OVER u) AS rejected FROM d WINDOW u AS (ORDER BY opening, digest, conv_id)),
        n AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i].role = rejected[i].role AND chosen[i].text = rejected[i].text), false) - 1, least(len(chosen), len(rejected))) AS n FROM e),
        s AS (SELECT conv_id, n, chosen[1:n] AS prompt, chosen[n + 1:] AS chosen, rejected[n + 1:] AS rejected FROM n),
        r AS (SELECT conv_id, n, list_transform([prompt, chosen, rejected], lambda l: list_transform(l, lambda x: {'role': x.role, 'text': '<|' || replace(x.role, '<|', '< |') || '|>' || chr(10) || replace(x.text, '<|', '< |') || '<|end|>' || chr(10)})) AS sides FROM s),
        m AS (SELECT conv_id, n, list_transform(sides, lambda l: coalesce(array_to_string(list_transform(l, lambda x: x.text), ''), '')) AS texts,
            list_transform(sides, lambda l: coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: l[i].role = 'assistant'),
              lambda i: (coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x.text))), 0) + 14)::BIGINT || ':' || (coalesce(list_sum(list_transform(l[1:i], lambda x: length(x.text))), 0) - 1)::BIGINT), ','), '')) AS masks FROM r)
        SELECT conv_id, n::BIGINT AS n_prompt_turns, sha256(texts[1]) AS prompt_sha256, sha256(texts[2]) AS chosen_sha256, masks[2] AS chosen_mask, sha256(texts[3]) AS rejected_sha256, masks[3] AS rejected_mask FROM m
    """,
    "op1_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS digest, s FROM s),
        rep AS (SELECT digest, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY digest),
        x AS (SELECT id, n, hash(unnest(s)) AS h FROM rep),
        links AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.h = b.h AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(id, other) AS (SELECT id, id FROM rep UNION SELECT reach.id, e.b FROM reach JOIN both_ways e ON reach.other = e.a),
        c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
        SELECT k.doc_id, k.n::BIGINT AS n_shingles, coalesce(c.component, k.doc_id) AS component_id, k.doc_id = coalesce(c.component, k.doc_id) AS kept
        FROM k LEFT JOIN rep ON k.n > 0 AND rep.digest = k.digest LEFT JOIN c ON c.id = rep.id
    """,
    "op7_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
        f AS (SELECT h, min(doc_id) AS first_id FROM h GROUP BY h),
        r AS (SELECT h.doc_id, h.i FROM h JOIN f USING (h) WHERE f.first_id < h.doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM r),
        g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
        kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS text FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i WHERE gone.i IS NULL GROUP BY words.doc_id)
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(g.gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op10_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
        item AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
        di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item) WHERE len(w) >= n),
        win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM di),
        hit AS (SELECT doc_id, win.n, i, item_id FROM win JOIN item ON item.n = win.n AND item.s = win.s),
        covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op11_importance_resampling": r"""
        WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
        bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
        vocabulary AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
        coded AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]))) % 10000 AS bucket FROM vocabulary, tab),
        raw AS (SELECT bucket, sum(n) AS s FROM dw JOIN coded USING (word) GROUP BY bucket),
        target AS (SELECT bucket, sum(n) AS t FROM bw JOIN coded USING (word) GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM raw), 0) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM target), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM raw FULL JOIN target USING (bucket)),
        weight AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weight USING (doc_id)),
        ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank FROM ranked
    """,
    "op13_source_mix": r"""
        WITH k AS (SELECT doc_id, avg(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            -ln((('0x' || md5('2024:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (1 + 3 * coalesce(quality, 0.5::DOUBLE)) AS key FROM documents LEFT JOIN k USING (doc_id)),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT source, source_size, 2 * source_size AS most, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
        l AS (SELECT *, (150 * (SELECT sum(source_size) FROM s) / 100::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY most / weight, source)),
        t AS (SELECT source, source_size, least(most::DOUBLE, weight * (SELECT level FROM l WHERE weight * level <= most ORDER BY most / weight, source LIMIT 1)) AS target FROM w),
        r AS (SELECT doc_id, size, source_size, target, floor(target / source_size)::BIGINT AS whole, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
        SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN size * (whole + (size > 0 AND 2 * before + size <= 2 * (target - whole * source_size))::BIGINT) ELSE 0 END::BIGINT AS taken FROM r
    """,
}
