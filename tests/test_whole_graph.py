import random

import pytest

from dealweave.operators import graph, paths
from dealweave.plans import adapter, network


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A star schema whose deals are all made outside NATION_1 and NATION_2."""
    d, rnd = str(tmp_path_factory.mktemp("star")), random.Random(8)
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    save("nation", [(k, f"NATION_{k}") for k in range(6)], "n_nationkey long, n_name string")
    save("customer", [(k, 3 + k % 3) for k in range(40)], "c_custkey long, c_nationkey long")
    save("part", [(k, "ECONOMY") for k in range(25)], "p_partkey long, p_type string")
    save("orders", [(k, rnd.randrange(40), f"199{rnd.randint(5, 8)}-0{rnd.randint(1, 9)}-11") for k in range(120)], "o_orderkey long, o_custkey long, o_orderdate string")
    save("lineitem", [(k, rnd.randrange(25), n) for k in range(120) for n in (1, 2)], "l_orderkey long, l_partkey long, l_linenumber int")
    return d


def test_queries_read_the_graph_of_all_countries(spark, folder):
    every = {r.node for r in graph.nodes(adapter.graph(spark, folder)).collect()}
    assert len(every) > 20
    for name in ("gra_cores", "gra_louvain"):
        assert {r.node for r in network.QUERIES[name](spark, folder).collect()} == every
    assert network.QUERIES["gra_exact_paths"](spark, folder).first().diameter >= 2
    picked = [r.node for r in network.QUERIES["sim_greedy_seeds"](spark, folder).collect()]
    assert set(picked) <= every and len(picked) >= 2


def test_exact_paths_over_more_than_three_thousand_nodes(spark):
    m = 3500
    r = graph.exact_paths(spark.createDataFrame([("hub", f"leaf{k}") for k in range(m)], "a string, b string")).first()
    assert r.diameter == 2 and r.mean_distance == pytest.approx((2 * m + 2 * m * (m - 1)) / (m * (m + 1)))


def test_exact_paths_from_seats_equal_those_from_edges(spark, folder):
    rnd = random.Random(5)
    chain = [(f"c{k}", s, f"n{k + s:03d}") for k in range(40) for s in (0, 1)]  # a long way round the nodes of a crowd
    crowd = [("all", s, f"n{rnd.randrange(100, 700):03d}") for s in (0, 1) for _ in range(300)] + [("all", 0, "n040"), ("one side", 0, "alone"), ("self", 0, "twice"), ("self", 1, "twice")]
    seats = spark.createDataFrame(chain + crowd, "company string, side int, node string")
    met = {(p, q) for a, s, p in chain + crowd for b, t, q in chain + crowd if a == b and s < t and p != q}
    adj = {}
    for p, q in met:
        adj.setdefault(p, set()).add(q)
        adj.setdefault(q, set()).add(p)
    found = []
    for s in adj:
        dist, front = {s: 0}, [s]
        while front:
            front = [v for u in front for v in adj[u] if v not in dist and not dist.update({v: dist[u] + 1})]
        found += [k for k in dist.values() if k]
    r = paths.all_pairs(seats).first()
    assert r.diameter == max(found) > 40 and r.mean_distance == pytest.approx(sum(found) / len(found))
    und = spark.createDataFrame(sorted({(min(e), max(e)) for e in met}), "a string, b string")
    assert graph.exact_paths(und).first() == r


def test_exact_paths_refuse_no_size(spark):
    m = 200_100
    hub = spark.range(m).selectExpr("'c' as company", "1 as side", "concat('leaf', id) as node").unionByName(spark.createDataFrame([("c", 0, "hub")], "company string, side int, node string"))
    small = paths._searched
    sizes = []
    paths._searched = lambda spark, arrays, size: sizes.append(size) or spark.range(1)
    try:
        paths.all_pairs(hub)
    finally:
        paths._searched = small
    assert sizes == [m + 1]
