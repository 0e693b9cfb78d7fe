"""Physical-plan properties that matter at scale (checked on sf0.001 plans)."""

import re

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL


def _plan(spark, name):
    return E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["g3_category_pair_edges", "b3_balance_train", "a6_classification_report",
                                  "a7_confusion_matrix", "l1_tfidf_keyphrases", "p11_render_prompt",
                                  "g8_sage_mean", "b4_undersample_majority", "l4_standardise"])
def test_no_cross_or_nested_loop_joins(spark, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", _plan(spark, name))


def _leaves(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()
    return plan.collectLeaves().size()


@pytest.mark.parametrize(("name", "most"), [("b3_balance_train", 6), ("a6_classification_report", 6),
                                            ("g3_category_pair_edges", 16)])
def test_inputs_are_not_planned_over_and_over(spark, name, most):
    assert _leaves(spark, name) <= most


def test_graph_stage_tables_hold_no_texts(spark):
    from corpusloom.plans import graph_queries
    recs = graph_queries._graph(spark, SF_SMALL)[0]
    assert set(recs.columns) == {"lens_id", "category", "cpc", "ipcr", "classifications"}


def test_rank_windows_are_sub_bucketed(spark):
    p = _plan(spark, "b5_stratified_split")
    # the row_number window is partitioned by (class, hash sub-bucket), never by the class alone
    wins = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*?)(?:,\s*_h#)", p)
    assert wins and all("_s#" in w for w in wins)


def test_pair_join_on_block_keys(spark):
    p = _plan(spark, "j1_basket_pairs")
    assert re.search(r"Join \[key#\d+, _p#\d+, _q#\d+\]", p)


def test_scans_are_pruned(spark):
    p = _plan(spark, "g3_category_pair_edges")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>" in schemas
    assert all("text" not in s for s in schemas if "lang" in s)   # category lookups read (doc_id, lang)


def test_first_n_per_group_is_limited_before_shuffle(spark):
    assert "WindowGroupLimit" in _plan(spark, "b7_head_n")
