"""DuckDB twins of the fixtures in ``corpusloom.sources.fixtures`` as named CTEs.

``sql(["records", ...], body)`` returns ``WITH <ctes in dependency order> body``.
"""

from __future__ import annotations

from corpusloom.operators.keyphrases import STOP_WORDS

NL = "chr(10)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def sql(names: list[str] | tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order) + "\n" + body


# FB1 records ---------------------------------------------------------------
cte("codes", (), """
SELECT l.l_orderkey AS doc_id, l.l_linenumber % 2 = 1 AS odd,
       substr(p.p_type, 1, 1) || lpad(CAST(p.p_size AS VARCHAR), 2, '0') || 'L'
       || CAST(p.p_partkey % 7 AS VARCHAR) || '/' || CAST(p.p_partkey % 9 AS VARCHAR) AS code
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")

cte("code_lists", ("codes",), """
SELECT doc_id,
       string_agg(DISTINCT code, ';;' ORDER BY code) FILTER (WHERE odd) AS cpc,
       string_agg(DISTINCT code, ';;' ORDER BY code) FILTER (WHERE NOT odd) AS ipcr
FROM codes GROUP BY doc_id""")

cte("records", ("code_lists",), f"""
SELECT CAST(d.doc_id AS VARCHAR) AS lens_id,
       split_part(d.text, {NL}, 1) AS title,
       CASE WHEN strpos(d.text, {NL}) > 0 THEN substr(d.text, strpos(d.text, {NL}) + 1) END AS abstract,
       c.cpc, c.ipcr, d.lang AS category
FROM documents d LEFT JOIN code_lists c ON c.doc_id = d.doc_id""")

# P3 cleaned label table, D4 training frame ------------------------------------
cte("cleaned", ("records",), """
SELECT lens_id, title || ' ' || coalesce(abstract, '') AS combined,
       CAST(NULL AS VARCHAR) AS keyphrases,
       coalesce(cpc, '') || ';;' || coalesce(ipcr, '') AS classifications, category
FROM records""")

# raw keys (G2) and group levels (G3) of the normalised code string
cte("raw_keys", ("records",), """
SELECT lens_id AS node, unnest(string_split(replace(coalesce(cpc, '') || ';;' || coalesce(ipcr, ''), ';;', '|'), '|')) AS key
FROM records""")

cte("level_keys", ("raw_keys",), """
SELECT node, split_part(key, '/', 1) || '/' || split_part(key, '/', 2) AS key
FROM raw_keys WHERE key <> '' AND split_part(key, '/', 1) <> '' AND split_part(key, '/', 2) <> ''""")

# FB5 vectors, FB3 responses, FB9 predictions -----------------------------------
cte("vectors", (), """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, 'c' || CAST(label % 5 + 1 AS VARCHAR) AS category
FROM embeddings""")

_S = ",\n       ".join(
    f"CAST(floor(least(abs(CAST(embedding[{i}] AS DOUBLE)), 0.999) * 1000) AS INTEGER) AS s{i}"
    for i in range(1, 6))
cte("scores5", (), f"""
SELECT vec_id, 'c' || CAST(label % 5 + 1 AS VARCHAR) AS true_category,
       {_S}
FROM embeddings""")

# Top-2 recomputed from the integer scores and the response case (no JSON parsing).
cte("score_long", ("scores5",), """
SELECT vec_id, i, 'c' || CAST(i AS VARCHAR) AS k, s / 1000.0 AS v
FROM (SELECT vec_id, s1, s2, s3, s4, s5 FROM scores5)
UNPIVOT (s FOR col IN (s1, s2, s3, s4, s5)) u, LATERAL (SELECT CAST(substr(col, 2) AS INTEGER) AS i)""")

cte("score_top", ("score_long",), """
SELECT vec_id,
       max(CASE WHEN r = 1 THEN k END) AS k1, max(CASE WHEN r = 1 THEN v END) AS v1,
       max(CASE WHEN r = 2 THEN k END) AS k2, max(CASE WHEN r = 2 THEN v END) AS v2
FROM (SELECT vec_id, k, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM score_long)
GROUP BY vec_id""")

cte("predictions", ("scores5", "score_top"), """
SELECT s.vec_id, 'v' || CAST(s.vec_id AS VARCHAR) AS title, s.true_category,
       CASE WHEN s.vec_id % 20 IN (0, 1, 3, 6, 7) THEN 'ERROR' WHEN s.vec_id % 20 IN (2, 5) THEN NULL ELSE t.k1 END AS predicted_one,
       CASE WHEN s.vec_id % 20 IN (0, 1, 3, 2, 5, 6, 7) THEN 0.0 ELSE t.v1 END AS confidence_one,
       CASE WHEN s.vec_id % 20 IN (0, 1, 3, 6, 7) THEN 'ERROR' WHEN s.vec_id % 20 IN (2, 5) THEN NULL ELSE t.k2 END AS predicted_two,
       CASE WHEN s.vec_id % 20 IN (0, 1, 3, 2, 5, 6, 7) THEN 0.0 ELSE t.v2 END AS confidence_two
FROM scores5 s JOIN score_top t ON t.vec_id = s.vec_id""")

# Evaluation rows
cte("valid_pred", ("predictions",), """
SELECT *, true_category = predicted_one AS is_correct
FROM predictions
WHERE predicted_one <> 'ERROR' AND true_category IS NOT NULL AND predicted_one IS NOT NULL""")

cte("labelled", ("records",), """
SELECT r.*, d.source AS source_file FROM records r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.lens_id""")

# L1 keyphrases over whole texts, and the records that carry them
_STOP = "[" + ", ".join("'" + w + "'" for w in STOP_WORDS) + "]"

cte("kp_tokens", (), r"""
SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t
FROM documents WHERE text IS NOT NULL""")
cte("kp_ok", ("kp_tokens",), f"""
SELECT doc_id, t, list_transform(t, lambda w: NOT list_contains({_STOP}, w)) AS ok
FROM kp_tokens""")
cte("kp_cand", ("kp_ok",), """
SELECT doc_id, unnest(list_transform(
         list_filter(range(1, len(t) - n + 2), lambda i: list_aggregate(list_slice(ok, i, i + n - 1), 'bool_and')),
         lambda i: array_to_string(list_slice(t, i, i + n - 1), ' '))) AS phrase
FROM kp_ok, (VALUES (1), (2), (3)) v(n)""")
cte("kp_scored", ("kp_cand",), """
SELECT tf.doc_id, tf.phrase, tf.tf, d.df, d.cf, tf.tf * ln(n.n / d.df) AS score
FROM (SELECT doc_id, phrase, count(*) AS tf FROM kp_cand GROUP BY 1, 2) tf
JOIN (SELECT phrase, count(DISTINCT doc_id) AS df, count(*) AS cf FROM kp_cand GROUP BY phrase) d USING (phrase),
     (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL) n""")
cte("kp_top", ("kp_scored",), """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS INTEGER) AS rank FROM kp_scored)
WHERE rank <= 10""")

cte("kp", ("records", "kp_top"), """
SELECT r.*, coalesce(k.phrases, []) AS phrases
FROM records r LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS lens_id, list_sort(list(phrase)) AS phrases FROM kp_top GROUP BY doc_id) k
  ON k.lens_id = r.lens_id""")

cte("with_kp", ("kp",), "SELECT *, coalesce(array_to_string(phrases, '|'), '') AS keyphrases FROM kp")

cte("prompts", (), """
SELECT conv_id * 1000 + turn AS id,
       text || chr(10) || 'Categories: {categories}' || chr(10) || 'Text: {text}' || chr(10)
       || 'Reply with JSON {{"scores": {{"<category>": <score>}}}}' AS prompt_template
FROM conversations WHERE role = 'system'""")
