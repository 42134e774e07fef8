"""DuckDB twins of the operator queries that SQL can express."""

SQL: dict[str, str] = {
    # Every pair of one label in double precision, then reachability by recursion.
    "op5_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS e,
                 label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
          FROM embeddings),
        l AS (
          SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND a.sound AND b.sound AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (
          SELECT vec_id AS v, vec_id AS c FROM v
          UNION
          SELECT l.y, r.c FROM r JOIN l ON l.x = r.v WHERE r.c < l.y)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
        FROM v JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = v.vec_id
        LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) n ON n.x = v.vec_id""",
    # The longest original of equal texts stays, then the smallest id.
    "op10_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    # All pairs that share a shingle, confirmed, then reachability by recursion.
    "op9_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
                   WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                   ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
          FROM w),
        n AS (SELECT w.doc_id, count(s.sh) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
        p AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
          FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (
          SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
          WHERE 100 * shared >= 85 * (nx.n_shingles + ny.n_shingles - shared)),
        r AS (
          SELECT doc_id AS v, doc_id AS c FROM n
          UNION
          SELECT l.y, r.c FROM r JOIN l ON l.x = r.v WHERE r.c < l.y)
        SELECT n.doc_id, n.n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
        FROM n JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = n.doc_id""",
    # Every score of every document that holds a term of the item.
    "op11_ranked_search": r"""
        WITH t AS (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
        c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
        f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, docs),
        q AS (
          SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark WHERE item_id IS NOT NULL),
        u AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        s AS (
          SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
          FROM u JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    # Every pair of a query row and another row, whole numbers throughout.
    "op12_mtree_top_k": r"""
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, v.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
