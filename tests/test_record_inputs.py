"""What the record fixtures read: codes only where they are used, lines only of orders that are documents."""

import pytest

from corpusloom.plans import registry
from corpusloom.sources import fixtures as fx


@pytest.mark.parametrize("name", ["u3_distinct_phrases", "p10_pack_keyphrases", "p10_pack_keyphrases_whole"])
def test_phrase_queries_read_documents_only(spark, tmp_path, name):
    rows = [(1, "red sea\nthe sea", "en"), (2, "door", "en"), (2, "red door", "fr"), (None, "sea", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()[name](spark, str(tmp_path)).collect()  # there is no other table
    assert sorted(r.lens_id for r in got) == ["1", "2", "2", "2", "2"]


def test_lines_of_no_document_are_left_out_before_grouping(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "a\nb", "en"), (1, "c", "fr"), (None, "d", "en"), (2, "e", None)], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    lines = [(1, 7, 1), (1, 8, 2), (1, 7, 3), (None, 7, 1), (9, 7, 1), (2, 99, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(7, "BRASS", 3), (8, "TIN", 12)], "p_partkey long, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    df = fx.records(spark, d)
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted([("1", "a", "b", "B03L0/7", "T12L1/8", "en"), ("1", "c", None, "B03L0/7", "T12L1/8", "fr"), (None, "d", None, None, None, "en"),
                          ("2", "e", None, None, None, None)], key=str)
