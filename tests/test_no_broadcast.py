"""Tables that grow with the nodes are not sent to the driver, however small their files are."""

import pytest

from corpusloom.operators import graph as g
from corpusloom.operators import links as lk
from corpusloom.operators import twins as tw


def _big_broadcasts(df, spark):
    """Rows of the largest broadcast of a run of the plan."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.getClass().getSimpleName() == "BroadcastExchangeExec":
            found.append(node.metrics().apply("numOutputRows").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return max(found, default=0)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"k{i % 50}") for i in range(400)] + [(i, f"j{i % 7}") for i in range(400)]
    x = [(i, i % 3, 1.0) for i in range(400)]
    return spark.createDataFrame(rows, "node long, key string"), spark.createDataFrame(x, "node long, dim int, value double")


@pytest.mark.parametrize("of", ["gcn", "max", "twins", "hetero"])
def test_nothing_that_grows_with_the_nodes_is_broadcast(spark, tables, of):
    inc, x = tables
    nodes = x.select("node")
    if of == "gcn":
        out = g.gcn_propagate(nodes, lk.links(inc, "t"), x)
    elif of == "max":
        out = g.sage_aggregate(nodes, lk.links(inc, "t"), x, agg="max")
    elif of == "twins":
        graph = tw.twin_graph(inc)
        out = tw.to_nodes(graph, tw.twin_propagate(graph, x, hops=2))
    else:
        out = g.hetero_propagate(nodes, [lk.links(inc, "t"), lk.links(inc, "u")], x, ["t", "u"])
    assert _big_broadcasts(out, spark) == 0
