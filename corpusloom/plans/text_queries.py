"""Record text, class-code and keyphrase queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans.registry import query
from corpusloom.plans.sql_fixtures import sql
from corpusloom.sources import fixtures as fx
from corpusloom.sources import io

# The record fixture's labels, majority first (plan constants,
# like the reference's fixed file -> label map).
LABELS = ("en", "fr", "de", "es")


def _q(name, sql_text=None):
    return lambda fn: query(name, sql=sql_text)(fn)


@_q("p1_combined_text", sql(["records"], "SELECT lens_id, title || ' ' || coalesce(abstract, '') AS combined FROM records"))
def p1(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.records(spark, sf)
    return r.select("lens_id", tx.combined_text("title", "abstract").alias("combined"))


@_q("p2_merge_codes", sql(["records"], "SELECT lens_id, coalesce(cpc, '') || ';;' || coalesce(ipcr, '') AS classifications FROM records"))
def p2(spark, sf):
    return fx.records(spark, sf).select("lens_id", tx.merge_codes("cpc", "ipcr").alias("classifications"))


@_q("p3_clean_records", sql(["cleaned"], "SELECT * FROM cleaned"))
def p3(spark, sf):
    return tx.clean_records(fx.records(spark, sf), F.col("category"))


@_q("p4_training_frame", sql(["cleaned"], """
SELECT lens_id, keyphrases, replace(classifications, ';;', '|') AS classifications, category FROM cleaned"""))
def p4(spark, sf):
    c = tx.clean_records(fx.records(spark, sf), F.col("category")).drop("combined")
    return c.withColumn("classifications", tx.normalise_codes("classifications"))


@_q("p5_document_text", sql(["records"], """
SELECT lens_id, 'Title: ' || coalesce(title, '') || chr(10) || 'Abstract: ' || coalesce(abstract, '') AS text FROM records"""))
def p5(spark, sf):
    return fx.records(spark, sf).select("lens_id", tx.document_text("title", "abstract").alias("text"))


@_q("p6_normalise_codes", sql(["records"], """
SELECT lens_id, replace(coalesce(cpc, '') || ';;' || coalesce(ipcr, ''), ';;', '|') AS codes FROM records"""))
def p6(spark, sf):
    return fx.records(spark, sf).select("lens_id", tx.normalise_codes(tx.merge_codes("cpc", "ipcr")).alias("codes"))


@_q("p7_merge_feature_keys", sql(["with_kp"], """
SELECT lens_id, replace(coalesce(cpc, '') || ';;' || coalesce(ipcr, ''), ';;', '|') || '|' || keyphrases AS feature_keys
FROM with_kp"""))
def p7(spark, sf):
    r = fx.with_keyphrases(spark, sf)
    return r.select("lens_id", tx.merge_feature_keys(tx.normalise_codes(tx.merge_codes("cpc", "ipcr")),
                                                     "keyphrases").alias("feature_keys"))


@_q("p8_explode_keys", sql(["raw_keys"], "SELECT node AS lens_id, key FROM raw_keys"))
def p8(spark, sf):
    r = fx.records(spark, sf).select("lens_id", tx.normalise_codes(tx.merge_codes("cpc", "ipcr")).alias("codes"))
    return tx.explode_keys(r, "codes").select("lens_id", "key")


_LEVELS_SQL = """,
lv AS (
  SELECT node, key, split_part(key, '/', 1) AS main, split_part(key, '/', 2) AS sub FROM raw_keys
)
SELECT node AS lens_id, level FROM (
  SELECT node, CASE WHEN key <> '' AND main <> '' THEN substr(main, 1, 1) END AS level FROM lv
  UNION ALL SELECT node, CASE WHEN key <> '' AND main <> '' AND length(main) > 1 THEN substr(main, 1, 3) END FROM lv
  UNION ALL SELECT node, CASE WHEN key <> '' AND main <> '' AND length(main) > 3 THEN substr(main, 1, 4) END FROM lv
  UNION ALL SELECT node, CASE WHEN key <> '' AND sub <> '' THEN main || '/' || sub END FROM lv
) WHERE level IS NOT NULL"""


@_q("p9_code_levels", sql(["raw_keys"], _LEVELS_SQL))
def p9(spark, sf):
    r = fx.records(spark, sf).select("lens_id", tx.normalise_codes(tx.merge_codes("cpc", "ipcr")).alias("codes"))
    k = tx.explode_keys(r, "codes")
    return k.select("lens_id", F.explode(tx.code_levels("key", tx.LEVELS)).alias("level"))


@_q("p10_pack_keyphrases", sql(["kp"], """
SELECT lens_id, coalesce(array_to_string(flatten(list_transform(phrases, lambda p: string_split(translate(p, ',\'\'[]', ''), ' '))), '|'), '') AS keyphrases
FROM kp"""))
def p10(spark, sf):
    r = fx.with_keyphrases(spark, sf, codes=False)
    return r.select("lens_id", tx.pack_keyphrases("phrases", split_words=True, casefold=False).alias("keyphrases"))


@_q("p10_pack_keyphrases_whole", sql(["with_kp"], "SELECT lens_id, keyphrases FROM with_kp"))
def p10_whole(spark, sf):
    return fx.with_keyphrases(spark, sf, codes=False).select("lens_id", "keyphrases")


@_q("u1_union_by_label", sql(["records"], "SELECT * FROM records"))
def u1(spark, sf):
    """One table for each label, from one scan of the records; their union."""
    path = io.scratch_path(spark, "by-label")
    io.write_table(fx.records(spark, sf), path)
    t = io.read_table(spark, path)
    return io.build_combined([t.filter(F.col("category").eqNullSafe(lab)) for lab in fx.labels(t)])


@_q("u2_distinct_labels", sql(["records"], "SELECT DISTINCT category FROM records"))
def u2(spark, sf):
    return fx.records(spark, sf).select("category").distinct()


@_q("u3_distinct_phrases", sql(["kp"], "SELECT lens_id, array_to_string(phrases, '|') AS phrases FROM kp"))
def u3(spark, sf):
    r = fx.with_keyphrases(spark, sf, codes=False)
    return r.select("lens_id", F.array_join(tx.distinct_phrases("phrases"), "|").alias("phrases"))


@_q("j8_keyed_write_back", sql(["cleaned", "with_kp"], """
SELECT c.lens_id, c.combined, k.keyphrases, c.classifications, c.category
FROM cleaned c LEFT JOIN (SELECT lens_id, keyphrases FROM with_kp) k ON k.lens_id = c.lens_id"""))
def j8(spark, sf):
    from corpusloom.operators.scoring import with_keyphrases
    cleaned = tx.clean_records(fx.records(spark, sf), F.col("category"))
    phrases = fx.with_keyphrases(spark, sf, codes=False).select("lens_id", "keyphrases")
    return with_keyphrases(cleaned, phrases)
