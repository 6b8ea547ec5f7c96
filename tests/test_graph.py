import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from dealweave.operators import deals, diffusion, graph, linkpred, prescience

EDGES = [("a", "b", 1.0), ("b", "a", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0), ("x", "y", 3.0)] + [(p, q, 1.0) for p, q in itertools.combinations("klmn", 2)] + [("d", "k", 1.0)]


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, weight double")


@pytest.fixture(scope="module")
def und(g):
    return deals.undirected(g)


def adjacency():
    adj = {}
    for s, t, _ in EDGES:
        adj.setdefault(s, set()).add(t)
        adj.setdefault(t, set()).add(s)
    return adj


def distances(adj, s):
    dist, front = {s: 0}, [s]
    while front:
        front = [v for u in front for v in adj[u] if v not in dist and not dist.update({v: dist[u] + 1})]
    return dist


def test_degrees_and_summary(g):
    d = {r.node: r for r in graph.degrees(g).collect()}
    assert (d["b"].out_degree, d["b"].in_degree, d["b"].out_weight) == (2, 1, 3.0) and d["y"].out_degree == 0
    s = graph.summary(g).first()
    n, m = len(adjacency()), len(EDGES)
    assert (s.n_nodes, s.n_edges) == (n, m) and math.isclose(s.density, m / (n * (n - 1))) and math.isclose(s.reciprocity, 2 / m)


def test_clustering_and_cliques(und):
    adj = adjacency()
    c = {v: sum(q in adj[p] for p, q in itertools.combinations(adj[v], 2)) * 2 / (len(adj[v]) * (len(adj[v]) - 1)) for v in adj if len(adj[v]) > 1}
    r = graph.clustering(und).first()
    assert math.isclose(r.average_all, sum(c.values()) / len(adj)) and math.isclose(r.average_from_two, sum(c.values()) / len(c))
    assert graph.largest_clique(und).first()[0] == 4


def test_components_paths_and_cores(g, und):
    comp = {r.node: r.component for r in graph.weak_components(g).collect()}
    assert comp["y"] == "x" and len(set(comp.values())) == 2 and comp["n"] == "a"
    adj = adjacency()
    got = {(r.source, r.node): r.dist for r in graph.bfs(und, und.sparkSession.createDataFrame([("a",), ("x",)], "node string")).collect()}
    assert got == {(s, v): k for s in "ax" for v, k in distances(adj, s).items()}
    big = [v for v in adj if v not in "xy"]
    all_ = [k for s in big for v, k in distances(adj, s).items() if k]
    r = graph.exact_paths(und).first()
    assert r.diameter == max(all_) and math.isclose(r.mean_distance, sum(all_) / len(all_))
    with pytest.raises(ValueError):
        graph.exact_paths(und, most_nodes=2)
    cores = {r.node: r.core for r in graph.core_numbers(und).collect()}
    assert cores == {**dict.fromkeys("abc", 2), **dict.fromkeys("klmn", 3), "d": 1, "x": 1, "y": 1} or cores["k"] == 3
    assert set(cores) == set(adj)
    assert graph.percolation(und, 2).first()[0] >= 2


def test_ranks_sum_to_one_and_betweenness(g):
    pr = {r.node: r.rank for r in graph.pagerank(g, tolerance=1e-4).collect()}
    assert math.isclose(sum(pr.values()), 1, abs_tol=1e-6)
    names = sorted(pr)
    want = dict.fromkeys(names, 1 / len(names))
    out = {v: [(t, w) for s, t, w in EDGES if s == v] for v in names}
    for _ in range(100):
        lost = sum(want[v] for v in names if not out[v])
        new = {v: 0.15 / len(names) + 0.85 * lost / len(names) for v in names}
        for v in names:
            for t, w in out[v]:
                new[t] += 0.85 * want[v] * w / sum(x for _, x in out[v])
        want = new
    assert all(math.isclose(pr[v], want[v], rel_tol=1e-2) for v in names)
    ev = [r.score for r in graph.eigenvector(g, tolerance=0.02).collect()]
    assert math.isclose(sum(x * x for x in ev), 1, abs_tol=1e-6)
    chain = g.sparkSession.createDataFrame([("p", "q", 1.0), ("q", "r", 1.0), ("r", "s", 1.0)], "src string, dst string, weight double")
    b = {r.node: r.betweenness for r in graph.betweenness(chain).collect()}
    assert math.isclose(b["q"], 2 / 6) and math.isclose(b["r"], 2 / 6) and b["p"] == 0


def test_communities(spark, und):
    rnd = random.Random(0)
    e = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abc" for i, j in itertools.combinations(range(8), 2) if rnd.random() < 0.8] + [("a0", "b0", 0.1), ("b1", "c1", 0.1)]
    u = spark.createDataFrame(e, "a string, b string, weight double")
    part = graph.louvain(u)
    label = {r.node: r.community for r in part.collect()}
    assert len({label[f"a{i}"] for i in range(8)}) == 1 and len(set(label.values())) == 3
    assert graph.modularity(u, part).first()[0] > 0.6
    assert graph.spectral_gap(u) < 0.1


def test_scores_and_links(spark):
    rows = [("early", "c1", "series-a", "2020-01-01"), ("late", "c1", "series-b", "2021-01-01"), ("early", "c2", "series-a", "2020-01-01"), ("late", "c2", "series-b", "2022-01-01"), ("early", "c3", "series-a", "2022-06-01"), ("other", "c3", "series-a", "2022-06-01"), (None, "c4", "series-a", "2022-06-01"), (" early ", "c1", "Series-A ", "2020-01-01")]
    raw = spark.createDataFrame(rows, "investor_name string, company_name string, funding_round_type string, d string").withColumn("funded_at", F.col("d").cast("date")).withColumn("category_code", F.lit("x"))
    d = deals.clean_deals(raw)
    e = deals.temporal_edges(d.distinct())
    assert {(r.source, r.target, r.company) for r in e.collect()} == {("early", "late", "c1"), ("early", "late", "c2")}
    s = prescience.static_scores(e, d).first()
    assert s.investor == "early" and s.portfolio_size == 3 and math.isclose(s.tps, s.tps_raw / 3)
    links = {(r.company, r.investor): r.cn for r in linkpred.link_scores(d, linkpred.only_first_round(d)).collect()}
    assert links == {("c3", "late"): 1}
    with pytest.raises(ValueError):
        deals.validate_edges(e.drop("weight"))
    assert e.limit(0).transform(deals.assemble).collect() == []


def test_diffusion(spark, g):
    seeds = spark.createDataFrame([(1, "a"), (2, "x")], "run long, node string")
    full = diffusion.cascade(g, seeds, 1.1)
    assert {r.node for r in full.filter("run = 2").collect()} == {"x", "y"} and full.filter("run = 1").count() == 8
    assert diffusion.cascade(g, seeds, 0.0).count() == 2
    assert sorted(map(tuple, diffusion.cascade(g, seeds, 0.5).collect())) == sorted(map(tuple, diffusion.cascade(g.repartition(5), seeds, 0.5).collect()))
    assert diffusion.thresholds(g, seeds, rounds=2).count() >= 3
    last = {r.run: r for r in diffusion.contagion(g, seeds, 1.1, 1.1, 4).filter("round = 1").collect()}
    assert last[2].infected == 1 and last[2].recovered == 1
    assert diffusion.greedy_influence(g, spark.createDataFrame([("a",), ("x",)], "node string"), 1, 1.1, sims=1) == ["a"]


def test_communities_by_packed_lists_equal_those_by_joins(spark):
    rnd = random.Random(3)
    pairs = {tuple(sorted(rnd.sample(range(120), 2))) if rnd.random() < 0.2 else tuple(sorted(rnd.sample(range(12 * g, 12 * g + 12), 2))) for g in [rnd.randrange(10) for _ in range(700)]}
    u = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}", rnd.choice([0.5, 1.0, 2.0])) for a, b in sorted(pairs)], "a string, b string, weight double")
    packed = {r.node: r.community for r in graph.louvain(u).collect()}
    assert packed == {r.node: r.community for r in graph.louvain(u, local_nodes=0).collect()}
    assert 1 < len(set(packed.values())) < 30 and set(packed.values()) <= set(packed)


@pytest.mark.parametrize("local_nodes", [0, 10])
def test_equal_gains_go_to_the_smaller_community(spark, local_nodes):
    star = [("a", x, 1.0) if x > "a" else (x, "a", 1.0) for x in "bcdefghi"]
    for order in (star, star[::-1]):
        u = spark.createDataFrame(order, "a string, b string, weight double")
        one = graph.louvain(u.repartition(3), rounds=1, levels=1, local_nodes=local_nodes)
        label = {r.node: r.community for r in one.collect()}
        assert label["a"] in ("a", "b")


def test_greedy_seeds_by_bits_equal_those_by_joins(spark):
    rnd = random.Random(11)
    e = spark.createDataFrame([(f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}") for _ in range(150)] + [("n00", "n01")] * 3, "src string, dst string")
    some = spark.createDataFrame([(f"n{i:02d}",) for i in range(0, 60, 4)] + [("apart",)], "node string")
    for p, rounds in ((0.3, None), (0.5, 2), (1.1, None)):
        by_bits = diffusion.greedy_influence(e, some, 4, p, sims=3, rounds=rounds)
        assert by_bits == diffusion.greedy_influence(e, some, 4, p, sims=3, rounds=rounds, local_edges=0) and by_bits
