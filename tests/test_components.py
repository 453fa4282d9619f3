from wayloom.llm import probminhash
from wayloom.operators import routing


def test_components_of_few_nodes_need_no_joins(spark, monkeypatch):
    """nodes are connected in few tasks and then in one; rounds of joins over every task's nodes filled the disk."""
    edges = spark.range(60).selectExpr("id % 20 * 2 + 100 * (id div 20) as src", "id % 20 * 2 + 2 + 100 * (id div 20) as dst", "1.0d as seconds").repartition(4)
    pairs = spark.createDataFrame([(0, 0, 6), (1, 6, 0), (2, 102, 114), (3, 0, 102), (4, 7, 7)], "req_id long, source long, target long")
    monkeypatch.setattr(routing, "EDGE_BOUND", 0)
    monkeypatch.setattr(probminhash, "components", None)
    found = routing.paths(edges, pairs, routing.contract_cheapest).collect()
    assert {r.req_id: (r.valid, r.seconds) for r in found} == {0: (True, 3.0), 1: (False, None), 2: (True, 6.0), 3: (False, None), 4: (False, None)}
    assert next(r.path_nodes for r in found if r.req_id == 0) == [0, 2, 4, 6]
