"""Keyphrase extraction queries (L1) over the whole texts of ``documents``; the CTEs of
the same work are in ``sql_fixtures``, since record fixtures use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import keyphrases as kp
from corpusloom.operators.spans import BLANK_MARK, merge_spans
from corpusloom.plans.registry import query
from corpusloom.plans.sql_fixtures import sql
from corpusloom.sources.tables import spread_table, table


@query("l1_tfidf_keyphrases", sql=sql(["kp_top"], "SELECT doc_id, rank, phrase, score, tf, df, cf FROM kp_top"))
def l1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return kp.tfidf_keyphrases(d, "doc_id", "text", k=10)


@query("l1_keyphrases_packed", sql=sql(["kp_top"], """
SELECT d.doc_id, coalesce(k.keyphrases, '') AS keyphrases
FROM documents d LEFT JOIN (SELECT doc_id, array_to_string(list_sort(list(phrase)), '|') AS keyphrases FROM kp_top GROUP BY doc_id) k
ON k.doc_id = d.doc_id"""))
def l1_packed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return kp.extract_keyphrases(d, "doc_id", "text", k=10).select("doc_id", "keyphrases")


@query("l1_tag_spans", sql=rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i::INTEGER AS pos, w[i + 1] AS word, ('0x' || substr(md5(w[i + 1]), 1, 1))::INT AS c, ('0x' || substr(md5(w[i + 1]), 2, 2))::INT AS s
      FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w)),
k AS (SELECT *, CASE WHEN c < 8 THEN 'KEY' ELSE 'O' END AS kind, c < 4 AS begins FROM t),
b AS (SELECT *, CASE WHEN begins OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM k),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM b)
SELECT doc_id, min(pos) AS first, max(pos) AS last, kind AS tag, trim(replace(string_agg('{BLANK_MARK}' || word, '' ORDER BY pos), '{BLANK_MARK}', ' '), ' ') AS phrase,
       count(*)::INTEGER AS n_tokens, avg(s / 255) AS score FROM n WHERE kind <> 'O' GROUP BY doc_id, span, kind""")
def l1_spans(spark, sf):
    """Spans of the words of whole texts, with tags and scores that a hash of the word gives."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    t = spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.posexplode(words).alias("pos", "word"))
    code = lambda a, n: F.conv(F.substring(F.md5("word"), a, n), 16, 10).cast("int")
    tag = F.when(code(1, 1) < 4, "B-KEY").when(code(1, 1) < 8, "I-KEY").otherwise("O")
    tagged = t.select("doc_id", "pos", F.concat(F.lit(BLANK_MARK), "word").alias("token"), tag.alias("tag"), (code(2, 2) / 255).alias("score"))
    return merge_spans(tagged, "doc_id")
