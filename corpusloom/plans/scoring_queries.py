"""Scoring queries: prompt, responses, top-2, content keys, embedding store,
pooling and model calls (S8, P11-P15, P19, P22, P23, J5, J6, L2, L3, L9, L10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scores as sc
from corpusloom.functions.stubs import LANGUAGE_CUES, keyword_llm, letter_embedder
from corpusloom.functions.text import document_text
from corpusloom.operators import ledger
from corpusloom.operators import scoring as so
from corpusloom.plans.registry import query
from corpusloom.plans.sql_fixtures import cte, sql
from corpusloom.plans.text_queries import LABELS
from corpusloom.sources import fixtures as fx
from corpusloom.sources import io
from corpusloom.sources.tables import table

cte("tokens", (), """
SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS pos, CAST((i - 1) % 8 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS value,
       CASE WHEN (i - 1) // 8 < vec_id % 8 + 1 THEN 1 ELSE 0 END AS mask
FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings)""")

_CASE = "vec_id % 20"


@query("s8_latest_prompt", sql=sql(["prompts"], "SELECT arg_max(prompt_template, id) AS prompt_template FROM prompts"))
def s8(spark: SparkSession, sf: str) -> DataFrame:
    return io.latest_prompt(fx.prompts(spark, sf))


_RENDER_SQL = sql(["prompts", "records"], f""",
tpl AS (SELECT arg_max(prompt_template, id) AS t FROM prompts),
seg AS (SELECT replace(replace(replace(replace(replace(replace(replace(t, '{{{{', chr(1)), '{{categories}}', chr(3)),
               '{{text}}', chr(4)), '}}}}', chr(2)), chr(1), '{{'), chr(2), '}}'), chr(3), '{", ".join(LABELS)}') AS t FROM tpl)
SELECT r.lens_id, replace(seg.t, chr(4), 'Title: ' || coalesce(r.title, '') || chr(10) || 'Abstract: ' || coalesce(r.abstract, '')) AS prompt
FROM records r, seg""")


def _rendered(spark, sf):
    r = fx.records(spark, sf).withColumn("text", document_text("title", "abstract"))
    return so.render_prompt(r, io.latest_prompt(fx.prompts(spark, sf)), LABELS, "text")


@query("p11_render_prompt", sql=_RENDER_SQL)
def p11(spark, sf):
    return _rendered(spark, sf).select("lens_id", "prompt")


@query("j6_prompt_per_label", sql=_RENDER_SQL.replace(
    "SELECT r.lens_id, replace(", "SELECT r.category, CAST(sum(length(replace(").replace(
    "AS prompt\nFROM records r, seg",
    ")) AS BIGINT) AS prompt_chars, count(*) AS n_prompts\nFROM records r, seg GROUP BY r.category"))
def j6(spark, sf):
    return (_rendered(spark, sf).groupBy("category")
            .agg(F.sum(F.length("prompt")).alias("prompt_chars"), F.count(F.lit(1)).alias("n_prompts")))


_T = [f"'0.' || lpad(CAST(s{i} AS VARCHAR), 3, '0')" for i in range(1, 6)]
_SC = ("'{\"c1\": ' || " + _T[0] + " || ', \"c2\": ' || " + _T[1] + " || ', \"c3\": ' || " + _T[2]
       + " || ', \"c4\": ' || " + _T[3] + " || ', \"c5\": ' || " + _T[4] + " || '}'")
_VALID = "'{\"predicted_label\": \"c1\", \"confidence\": ' || " + _T[0] + " || ', \"scores\": ' || " + _SC + " || '}'"
cte("responses", ("scores5",), f"""
SELECT *, CASE vec_id % 20 WHEN 0 THEN 'unparseable' WHEN 1 THEN '[' || {_SC} || ']' WHEN 2 THEN '{{}}'
  WHEN 3 THEN {_VALID} || ' thanks' WHEN 4 THEN '```json' || chr(10) || {_VALID} || chr(10) || '```'
  WHEN 5 THEN '{{"predicted_label": null, "scores": null}}' WHEN 6 THEN '{{"scores": {{"c1": "NaN", "c2": 0.3}}}}'
  WHEN 7 THEN '{{"scores": {{"c1": 0.3, "c2": "Infinity"}}}}' ELSE {_VALID} END AS response
FROM scores5""")


@query("p12_clean_response", sql=sql(["responses"], r"""
SELECT vec_id, regexp_replace(replace(replace(response, '```json', ''), '```', ''), '^\s+|\s+$', '', 'g') AS cleaned
FROM responses"""))
def p12(spark, sf):
    r = fx.responses(spark, sf)
    return r.select("vec_id", sc.clean_response("response").alias("cleaned"))


@query("p13_parse_scores", sql=sql(["scores5"], f"""
SELECT vec_id, {_CASE} NOT IN (0, 1, 3) AS ok, {_CASE} IN (2, 5) AS is_empty,
       CASE WHEN {_CASE} IN (0, 1, 3, 2, 5, 6, 7) THEN NULL ELSE 5 END AS n_scores,
       CASE WHEN {_CASE} IN (0, 1, 3, 2, 5, 6, 7) THEN NULL ELSE (s1 + s2 + s3 + s4 + s5) / 1000.0 END AS score_sum
FROM scores5"""))
def p13(spark, sf):
    r = so.parse_responses(fx.responses(spark, sf), "response", "p")
    m = F.col("p.scores")
    return r.select("vec_id", F.col("p.ok").alias("ok"), F.col("p.empty").alias("is_empty"),
                    F.when(m.isNotNull(), F.size(m)).alias("n_scores"),
                    F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x).alias("score_sum"))


@query("p14_top_two", sql=sql(["score_top"], f"""
SELECT vec_id, k1, v1, k2, v2 FROM score_top WHERE {_CASE} NOT IN (0, 1, 3, 2, 5, 6, 7)"""))
def p14(spark, sf):
    r = so.parse_responses(fx.responses(spark, sf), "response", "p")
    r = r.filter(F.col("p.scores").isNotNull()).withColumn("t", sc.top_two(F.col("p.scores")))
    return r.select("vec_id", "t.k1", "t.v1", "t.k2", "t.v2")


def _results(spark, sf):
    r = fx.responses(spark, sf).select(F.col("vec_id").cast("string").alias("LensID"),
                                       F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("Title"),
                                       "true_category", "response")
    return so.to_result_rows(r)


@query("p15_result_rows", sql=sql(["predictions"], """
SELECT CAST(vec_id AS VARCHAR) AS LensID, title AS Title, true_category, predicted_one, confidence_one,
       predicted_two, confidence_two FROM predictions"""))
def p15(spark, sf):
    return _results(spark, sf)


@query("p19_content_key", sql="SELECT doc_id, substr(md5(text), 1, 16) || '_hash16' AS content_key FROM documents")
def p19(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", sc.content_key("text", "hash16").alias("content_key"))


@query("p22_argmax_label", sql=sql(["vectors"], "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS label_idx FROM vectors"))
def p22(spark, sf):
    v = fx.vectors(spark, sf)
    return v.select("vec_id", sc.argmax_label("embedding").alias("label_idx"))


@query("p23_softmax", sql=sql(["vectors"], """,
e AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, embedding[i] AS x, list_max(embedding) AS mx
      FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS i FROM vectors))
SELECT vec_id, dim, exp(x - mx) / sum(exp(x - mx)) OVER (PARTITION BY vec_id) AS prob FROM e"""))
def p23(spark, sf):
    v = fx.vectors(spark, sf).select("vec_id", sc.softmax("embedding").alias("p"))
    return v.select("vec_id", F.posexplode("p").alias("dim", "prob"))


@query("l3_mean_pool", sql=sql(["tokens"], """
SELECT vec_id, dim, sum(value * mask) / greatest(CAST(sum(mask) AS DOUBLE), 1e-9) AS value
FROM tokens GROUP BY vec_id, dim"""))
def l3(spark, sf):
    return so.mean_pool(fx.tokens(spark, sf))


_DOC_KEYS = "SELECT DISTINCT sha256(coalesce(text, '')) || '_hash16' AS content_key, lang FROM documents"


@query("j5_cache_misses", sql=f"""
WITH k AS ({_DOC_KEYS})
SELECT DISTINCT content_key FROM k WHERE content_key NOT IN (SELECT content_key FROM k WHERE lang = 'en')""")
def j5(spark, sf):
    d = table(spark, sf, "documents")
    store = so.store_keys(d.filter(F.col("lang") == "en"), "text", "hash16").select("content_key")
    return so.missing_embeddings(d, store, "text", "hash16").select("content_key")


_LETTERS = "abcdefghijklmnop"


@query("l2_embed_texts", sql=f"""
SELECT doc_id, sha256(coalesce(text, '')) || '_letters' AS content_key,
       {" + ".join(f"{i + 1} * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', ''))) / 1000" for i, c in enumerate(_LETTERS))} AS checksum,
       (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', ''))) / 1000 AS e, {len(_LETTERS)} AS width FROM documents""")
def l2(spark, sf):
    """Embed the English documents into a fresh store, then run the whole corpus: only misses are embedded
    the second time.  The stand-in model counts letters, so every vector can be held against SQL."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = io.scratch_path(spark, "embedding-store")
    fn = letter_embedder(_LETTERS)
    so.embed_texts(d.filter(F.col("lang") == "en"), fn, path, "text", "letters")
    embedded = so.embed_texts(d, fn, path, "text", "letters")
    places = F.transform("embedding", lambda x, i: x * (i + 1))
    return embedded.select("doc_id", "content_key", F.aggregate(places, F.lit(0.0), lambda a, x: a + x).alias("checksum"),
                           F.col("embedding")[_LETTERS.index("e")].alias("e"), F.size("embedding").alias("width"))


def _zero_shot(spark, sf, max_parallel):
    r = fx.records(spark, sf).withColumn("text", document_text("title", "abstract"))
    return so.zero_shot(r, io.latest_prompt(fx.prompts(spark, sf)), LABELS, keyword_llm(),
                        max_parallel=max_parallel)


def zero_shot_sql(body: str) -> str:
    """``body`` over ``answers``, the result rows of the stand-in model: the share of each label's cue words among
    the prompt's words, to four digits (ties of the last digit to even); a prompt whose length 23 divides has no JSON answer."""
    words = r"regexp_extract_all(lower(prompt), '[\p{L}\p{N}_]+')"
    counts = ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(c) for c in LANGUAGE_CUES[k])}], x))) AS n{i}"
                       for i, k in enumerate(LANGUAGE_CUES))
    ranked = ", ".join(f"{{'v': CASE WHEN t = 0 THEN {1 / len(LANGUAGE_CUES)} ELSE round_even(n{i} / t, 4) END, 'r': {-i}, 'k': '{k}'}}"
                       for i, k in enumerate(LANGUAGE_CUES))
    total = " + ".join(f"n{i}" for i in range(len(LANGUAGE_CUES)))
    return f"""
WITH zp AS ({_RENDER_SQL}),
zw AS (SELECT lens_id, length(prompt) % 23 = 0 AS junk, {words} AS w FROM zp),
zn AS (SELECT lens_id, junk, {counts} FROM zw),
zs AS (SELECT lens_id, junk, list_reverse_sort([{ranked}]) AS top FROM (SELECT *, {total} AS t FROM zn)),
answers AS (
SELECT r.lens_id AS "LensID", r.title AS "Title", r.category AS true_category,
       CASE WHEN junk THEN 'ERROR' ELSE top[1].k END AS predicted_one, CASE WHEN junk THEN 0.0 ELSE top[1].v END::DOUBLE AS confidence_one,
       CASE WHEN junk THEN 'ERROR' ELSE top[2].k END AS predicted_two, CASE WHEN junk THEN 0.0 ELSE top[2].v END::DOUBLE AS confidence_two
FROM zs JOIN ({sql(["records"], "SELECT lens_id, title, category FROM records")}) r USING (lens_id)){"," if body.lstrip()[:6] != "SELECT" else ""}
{body}"""


@query("l9_zero_shot", sql=zero_shot_sql("SELECT * FROM answers"))
def l9(spark, sf):
    """Every record with the two labels that the stand-in model gives it."""
    return _zero_shot(spark, sf, 8)


@query("l9_call_ledger", sql=zero_shot_sql("SELECT * FROM answers"))
def l9_ledger(spark, sf):
    """The same through the call ledger: the English records first, then all, of which only the others are asked."""
    r = fx.records(spark, sf).withColumn("text", document_text("title", "abstract"))
    prompts = so.result_prompts(r, io.latest_prompt(fx.prompts(spark, sf)), LABELS)
    path = io.scratch_path(spark, "ledger")
    ledger.run_calls(prompts.where(F.col("true_category") == "en"), keyword_llm(), path, max_parallel=8, rows_per_task=1024)
    ledger.run_calls(prompts, keyword_llm(), path, max_parallel=8, rows_per_task=1024)
    return ledger.ledger_results(prompts, path)


@query("l10_bounded_parallel", sql=zero_shot_sql(
    "SELECT true_category, predicted_one, count(*) AS n, sum(confidence_one) AS confidence FROM answers GROUP BY ALL"))
def l10(spark, sf):
    """The same with two calls at a time, by label and prediction."""
    return (_zero_shot(spark, sf, 2).groupBy("true_category", "predicted_one")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("confidence_one").alias("confidence")))
