"""DuckDB SQL for the queries that SQL can express.

The vectors, the near-duplicates and the repeated windows are compared here with everything, without an index.
"""

import string

#: (id, component): the smallest id that each of the rows ``node`` (id) reaches over ``link`` (a, b), both ways.
COMPONENTS = """
    reach AS (
        SELECT id, id AS other FROM node
        UNION SELECT r.id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM reach r JOIN link l ON r.other IN (l.a, l.b)
    ), component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')"

ORACLES = {
    "op4_containment_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
        bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
        n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
        m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) WHERE doc_id IS NOT NULL AND item_id IS NOT NULL GROUP BY ALL)
        SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id)
        WHERE n_shared / n_item >= 0.8
    """,
    "op1_graph_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        link AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id
            WHERE list_cosine_similarity(x.e, y.e) >= 0.9
        ), node AS (SELECT vec_id AS id FROM v), {COMPONENTS},
        n AS (SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM link UNION ALL SELECT b FROM link) GROUP BY id)
        SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
        FROM component LEFT JOIN n USING (id)
    """,
    "op2_fm_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d),
        numbered AS (
            SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS k FROM starts
        ),
        gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS i FROM numbered WHERE k > 1),
        word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t
            FROM word LEFT JOIN (SELECT *, true AS out FROM gone) USING (doc_id, i) WHERE out IS NULL GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op8_minmax_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        node AS (SELECT doc_id AS id FROM d), {COMPONENTS}
        SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, id = component_id AS kept
        FROM component LEFT JOIN n ON n.doc_id = id
    """,
    "op9_grammar_chat": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
          coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
          sum(22 + length({ESCAPED.format("r")}) + length({ESCAPED.format("x")}))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    # The content of these pages is what they mark as such; they use two character references.
    "op10_scored_main_text": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
        b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
        c AS (SELECT page_id, url, regexp_replace(replace(h, '&quot;', '"'), '&amp;?', '&', 'g') AS h FROM b),
        d AS (SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM c)
        SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
    """,
    # crc32 byte by byte over a table made by its rule; near words share what is left when one place is blanked or cut out.
    "op12_kd_spelling_variants": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM (SELECT unnest(range(256)) AS i)
        ), run AS (
            SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
            WHERE length(r) >= 7 GROUP BY ALL
        ), byte AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM run),
        summed AS (
            SELECT r, n, xor(4294967295, list_reduce(
                list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
                lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS h
            FROM byte, crc
        ), worn AS (
            SELECT CASE WHEN h % 31 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM summed
        ), w AS (SELECT word, sum(n)::BIGINT AS n FROM worn WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        cut AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
        pair AS (
            SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON w.word = c.a || c.b
            UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON w.word = c.a || c.b
        ), best AS (
            SELECT word, count(*) AS n_near, min_by(other, row(-n, other)) AS other, max(n) AS most FROM pair GROUP BY word
        ), f AS (
            SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 10 * w.n THEN other END AS form,
              CASE WHEN most >= 10 * w.n THEN most END AS form_n
            FROM w LEFT JOIN best USING (word)
        ), way AS (
            SELECT word, word AS place, 0 AS k FROM f
            UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON f.word = way.place WHERE f.form IS NOT NULL
        ), last AS (SELECT word, max_by(place, k) AS root FROM way GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
    """,
}
