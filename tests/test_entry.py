"""Driver contract + a slice of the DuckDB oracle check on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from corpusloom.sources.tables import TABLES
from tools.check_oracle import digest

from .conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["src_category", "dst_category", "n_edges"]
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["g3_category_pair_edges", "j1_basket_pairs", "b3_balance_train",
                                  "a6_classification_report", "p15_result_rows", "g7_gcn_propagate",
                                  "l1_tfidf_keyphrases", "w2_suffix_copies"])
def test_oracle_matches(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert digest(sdf.columns, [tuple(r) for r in sdf.collect()])[0] == digest(dcols, cur.fetchall())[0]
