"""Measures of a directed weighted graph (src, dst, weight) and of its undirected simple form (a, b, weight).

Iterative operators write each round to the shared folder, so lineage stays short and lost executors cost no more than a round. Those whose cost
grows faster than the graph are bounded by a documented size and raise beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealweave.operators.components import components
from dealweave.operators.moving import moved_communities
from dealweave.operators.paths import all_pairs
from dealweave.session import written


def nodes(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct()


def degrees(graph: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, out_weight, in_weight, degree), zeros where a node has none. One shuffle: both ends are stacked first."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("ow"), F.lit(0.0).alias("iw")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0.0).alias("ow"), F.col("weight").alias("iw")),
    )
    g = graph.select(F.inline(ends)).groupBy("node")
    out = g.agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("ow").alias("out_weight"), F.sum("iw").alias("in_weight"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def degree_centrality(graph: DataFrame) -> DataFrame:
    """(node, in_centrality, out_centrality, centrality): degree / (n - 1)."""
    d = degrees(graph)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: F.col(c) / F.greatest(F.col("n") - 1, F.lit(1))
    return d.join(F.broadcast(n)).select("node", of("in_degree").alias("in_centrality"), of("out_degree").alias("out_centrality"), of("degree").alias("centrality"))


def summary(graph: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density, reciprocity, mean_degree, max_degree."""
    d = degrees(graph).agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    back = graph.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    mutual = graph.join(back, ["src", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("mutual"))
    e = graph.agg(F.count(F.lit(1)).alias("n_edges"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    return d.join(F.broadcast(e)).join(F.broadcast(mutual)).select(
        "n_nodes", "n_edges", F.when(n > 1, m / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(m > 0, F.col("mutual") / m).otherwise(0.0).alias("reciprocity"), "mean_degree", "max_degree"
    )


def oriented(und: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges low -> high, degrees): each undirected edge from its end of lower degree, so no node has more than about sqrt(2m) successors."""
    deg = und.select(F.col("a").alias("node")).union(und.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    e = und.select("a", "b").join(deg.toDF("a", "ka"), "a").join(deg.toDF("b", "kb"), "b")
    low = F.struct("ka", "a") < F.struct("kb", "b")
    directed = e.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))
    return written(directed, "oriented"), deg


def triangles(und: DataFrame) -> DataFrame:
    """(node, k, triangles) of every node with an edge."""
    e, deg = oriented(written(und.select("a", "b"), "und"))
    wedges = e.alias("x").join(e.alias("y"), "u").filter("x.v < y.v").select("u", F.col("x.v").alias("p"), F.col("y.v").alias("q"))
    closed = wedges.join(e.select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q")), ["p", "q"])
    found = closed.select(F.explode(F.array("u", "p", "q")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    return deg.join(found, "node", "left").select("node", "k", F.coalesce("t", F.lit(0)).alias("triangles"))


def clustering(und: DataFrame) -> DataFrame:
    """One row: average clustering over all nodes (those of fewer than two neighbours count as 0), over the others alone, and transitivity."""
    t = triangles(und)
    c = F.when(F.col("k") > 1, 2 * F.col("triangles") / (F.col("k") * (F.col("k") - 1)))
    return t.agg(
        F.avg(F.coalesce(c, F.lit(0.0))).alias("average_all"), F.avg(c).alias("average_from_two"),
        (F.sum(2 * F.col("triangles")) / F.sum(F.col("k") * (F.col("k") - 1))).alias("transitivity"),
    )


def assortativity(graph: DataFrame) -> DataFrame:
    """One row: the correlation over edges of the source's out-degree and the target's in-degree."""
    d = degrees(graph)
    e = graph.join(d.select(F.col("node").alias("src"), F.col("out_degree").alias("o")), "src").join(d.select(F.col("node").alias("dst"), F.col("in_degree").alias("i")), "dst")
    return e.agg(F.corr("o", "i").alias("assortativity"))


def degree_entropy(graph: DataFrame) -> DataFrame:
    """One row: the entropy in bits of the distribution of degrees."""
    c = degrees(graph).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    return c.select(p.alias("p")).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy_bits"))


def degree_histogram(graph: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, n): nodes by degree in bins of equal width, the last one closed."""
    d = degrees(graph).select("degree")
    ends = d.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-9))
    return d.join(F.broadcast(ends)).groupBy(F.least(F.floor((F.col("degree") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ego(edges: DataFrame, node: str) -> DataFrame:
    """(neighbour, direction, n_deals) of one investor."""
    out = edges.filter(F.col("source") == node).groupBy(F.col("target").alias("neighbour")).agg(F.count(F.lit(1)).alias("n_deals")).withColumn("direction", F.lit("out"))
    back = edges.filter(F.col("target") == node).groupBy(F.col("source").alias("neighbour")).agg(F.count(F.lit(1)).alias("n_deals")).withColumn("direction", F.lit("in"))
    return out.unionByName(back).select("neighbour", "direction", "n_deals")


def top_nodes(graph: DataFrame, n: int) -> DataFrame:
    return degrees(graph).orderBy(F.desc("degree"), "node").limit(n).select("node")


def induced(graph: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges whose ends are both in keep (node)."""
    return graph.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")


def weak_components(graph: DataFrame) -> DataFrame:
    """(node, component), a component named by its smallest node."""
    n = nodes(graph).withColumn("id", F.xxhash64("node"))
    e = graph.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"))
    root = components(e, "a", "b")
    named = n.join(root, n["id"] == root["node"], "left").select(n["node"], F.coalesce(root["root"], n["id"]).alias("root"))
    return named.withColumn("component", F.min("node").over(Window.partitionBy("root"))).select("node", "component")


def bfs(und: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, dist) of all nodes that sources (node) reach over undirected edges; one round a step, frontier against seen, to the end."""
    both = und.select("a", "b").union(und.select("b", "a")).toDF("node", "next")
    both = written(both, "adjacent")
    seen = frontier = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist")), "bfs")
    for step in count(1):
        ahead = frontier.join(both, "node").select("source", F.col("next").alias("node")).distinct()
        frontier = written(ahead.join(seen, ["source", "node"], "left_anti").withColumn("dist", F.lit(step)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if step % 20 == 0:  # long chains: the plan stays short
            seen = written(seen, "bfs")
    return seen


def closeness(und: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, closeness): (r / (n - 1)) * (r / sum of distances), r being the nodes reached."""
    n = und.select("a").union(und.select("b")).distinct().count()
    reach = bfs(und, sources).filter("dist > 0").groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("r"), F.sum("dist").alias("s"))
    return reach.select("node", (F.col("r") / F.lit(max(n - 1, 1)) * F.col("r") / F.col("s")).alias("closeness"))


def approximate_diameter(und: DataFrame, sources: int = 8) -> DataFrame:
    """One row: the greatest distance from the nodes of highest degree."""
    _, deg = oriented(und)
    start = deg.orderBy(F.desc("k"), "node").limit(sources).select("node")
    return bfs(und, start).agg(F.max("dist").alias("approximate_diameter"))


def exact_paths(und: DataFrame, most_nodes: int | None = None) -> DataFrame:
    """One row: diameter and mean distance over the largest component (see paths); raises where it has more than most_nodes nodes, if that is given."""
    edge = F.xxhash64("a", "b")
    ends = F.array(F.struct(edge.alias("company"), F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(edge.alias("company"), F.lit(1).alias("side"), F.col("b").alias("node")))
    return all_pairs(und.filter("a <> b").select(F.inline(ends)), most_nodes)


def pagerank(graph: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): weighted, dangling nodes spread over all; ends once the ranks move by less than tolerance for each node, raises after rounds."""
    d = degrees(graph)
    g = written(graph.join(d.select(F.col("node").alias("src"), "out_weight"), "src").select("src", "dst", (F.col("weight") / F.col("out_weight")).alias("p")), "transitions")
    n = d.count()
    all_nodes = written(d.select("node", (F.col("out_weight") == 0).alias("dangling")), "nodes")
    rank = all_nodes.select("node", "dangling", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        last = rank
        lost = rank.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        into = g.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("in"))
        rank = all_nodes.join(into, "node", "left").join(F.broadcast(lost)).select(
            "node", "dangling", ((1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / n)).alias("rank")
        )
        rank = written(rank, "rank")
        moved = rank.join(last.select("node", F.col("rank").alias("last")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("last")))).first()[0]
        if (moved or 0.0) < n * tolerance:
            return rank.select("node", "rank")
    raise RuntimeError(f"ranks did not settle in {rounds} rounds")


def eigenvector(graph: DataFrame, rounds: int = 500, tolerance: float = 1e-6) -> DataFrame:
    """(node, score): power iteration over incoming weights with a unit shift, L2-normalised; ends once scores move by less than tolerance for each node, raises after rounds."""
    x = written(nodes(graph).withColumn("score", F.lit(1.0)), "scores")
    n = x.count()
    x = x.withColumn("score", F.lit(1.0 / max(n, 1) ** 0.5))
    g = graph.select("src", "dst", "weight")
    for _ in range(rounds):
        into = g.join(x.toDF("src", "s"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("s") * F.col("weight")).alias("in"))
        y = x.join(into, "node", "left").select("node", (F.col("score") + F.coalesce("in", F.lit(0.0))).alias("score"))
        before, norm = x, y.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
        x = y.join(F.broadcast(norm)).select("node", (F.col("score") / F.col("norm")).alias("score"))
        last, x = before, written(x, "scores")
        moved = x.join(last.select("node", F.col("score").alias("last")), "node").agg(F.sum(F.abs(F.col("score") - F.col("last")))).first()[0]
        if (moved or 0.0) < n * tolerance:
            return x
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def core_numbers(und: DataFrame) -> DataFrame:
    """(node, core): each node's core number, the fixed point of taking the greatest h with h neighbours at h or more, from the degrees on."""
    both = und.select("a", "b").union(und.filter("a <> b").select("b", "a")).toDF("node", "next").distinct()
    both = written(both, "adjacent")
    core = written(both.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("core")), "core")
    for _ in count():
        near = both.join(core.toDF("next", "v"), "next").groupBy("node", "v").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("v")))
        h = near.select("node", F.least("v", above).alias("h")).groupBy("node").agg(F.max("h").cast("int").alias("h"))
        core = written(core.join(h, "node").select("node", "h", (F.col("h") < F.col("core")).alias("moved")), "core")
        moved = core.filter("moved").limit(1).count()
        core = core.select("node", F.col("h").alias("core"))
        if not moved:
            break
    return core


def percolation(und: DataFrame, hubs: int = 20) -> DataFrame:
    """One row: components left once the nodes of highest degree are gone; nodes left alone count."""
    _, deg = oriented(und)
    gone = deg.orderBy(F.desc("k"), "node").limit(hubs).select("node")
    rest = und.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
    comp = weak_components(rest.select(F.col("a").alias("src"), F.col("b").alias("dst"))).agg(F.countDistinct("component").alias("c"), F.count(F.lit(1)).alias("n"))
    left = deg.join(gone, "node", "left_anti").agg(F.count(F.lit(1)).alias("all"))
    return comp.join(F.broadcast(left)).select((F.col("c") + F.col("all") - F.col("n")).alias("components"))


def modularity(und: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: Q of a partition (node, community)."""
    p = partition.select("node", "community")
    e = und.join(p.toDF("a", "ca"), "a").join(p.toDF("b", "cb"), "b")
    ends = e.select(F.inline(F.array(F.struct(F.col("ca").alias("c"), F.col("weight").alias("d"), F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("l")), F.struct(F.col("cb").alias("c"), F.col("weight").alias("d"), F.lit(0.0).alias("l")))))
    by = ends.groupBy("c").agg(F.sum("d").alias("d"), F.sum("l").alias("l"))
    m2 = F.sum("d").over(Window.partitionBy())
    return by.select((F.col("l") / (m2 / 2) - resolution * (F.col("d") / m2) * (F.col("d") / m2)).alias("q")).agg(F.sum("q").alias("modularity"))


def louvain(und: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 4, local_nodes: int = 3_000_000) -> DataFrame:
    """(node, community): local moving of all nodes of one parity at a time, then contraction, until no level improves.

    Deterministic: ties go to the smaller community, and only half of the nodes (by hash and round) may move in a round, which keeps neighbours
    from swapping for ever. Labels are a node of the community. Up to local_nodes nodes the labels go to the tasks (see moving); beyond, rounds are joins.
    und is read several times, so it should be a table.
    """
    mapping = None
    e = und.select("a", "b", "weight")
    named = written(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("h", F.xxhash64("node")), "named")
    counted = named.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("different")).first()
    if 0 < counted.n <= local_nodes and counted.n == counted.different:
        t = named.toArrow()
        t = t.take(pc.sort_indices(t.column("node")))
        community = moved_communities(e, t.column("h").to_numpy(), resolution, rounds, levels)
        sent = und.sparkSession.sparkContext.broadcast((t.column("h").to_numpy(), community))

        def label_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, c = sent.value
            order = np.argsort(hashes)
            for b in batches:
                at = order[np.searchsorted(hashes, b.column("h").to_numpy(), sorter=order)]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(hashes[c[at]])], names=["node", "h"])

        return named.mapInArrow(label_of, "node string, h long").join(named.withColumnRenamed("node", "community"), "h").select("node", "community")
    for _ in range(levels):
        both = written(e.filter("a <> b").select("a", "b", "weight").union(e.filter("a <> b").select("b", "a", "weight")), "both")
        k = e.select(F.inline(F.array(F.struct(F.col("a").alias("node"), "weight"), F.struct(F.col("b").alias("node"), "weight")))).groupBy("node").agg(F.sum("weight").alias("k"))
        k = written(k, "strength")
        m2 = k.agg(F.sum("k")).first()[0]
        if not m2:
            break
        label = k.select("node", F.col("node").alias("c"), "k")
        for r in range(rounds):
            tot = label.groupBy("c").agg(F.sum("k").alias("tot"))
            near = both.join(label.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("weight").alias("w"))
            own = label.select("node", "c", F.lit(0.0).alias("w"))
            near = near.unionByName(own).groupBy("node", "c").agg(F.sum("w").alias("w"))
            gain = near.join(tot, "c").join(label.select("node", F.col("c").alias("mine"), "k"), "node")
            without = F.col("tot") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)
            gain = gain.withColumn("g", F.col("w") - resolution * F.col("k") * without / m2)
            best = gain.groupBy("node").agg(F.min_by("c", F.struct(-F.round("g", 9), F.col("c") != F.col("mine"), "c")).alias("best"))
            may = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
            label = label.join(best, "node").select("node", F.when(may, F.col("best")).otherwise(F.col("c")).alias("c"), "k", (may & (F.col("best") != F.col("c"))).alias("moved"))
            label = written(label, "label")
            if r and not label.filter("moved").limit(1).count():
                break
            label = label.select("node", "c", "k")
        step = label.select(F.col("node").alias("inner"), "c")
        mapping = step.toDF("node", "community") if mapping is None else mapping.join(step, mapping["community"] == step["inner"]).select("node", F.col("c").alias("community"))
        mapping = written(mapping, "mapping")
        up = label.select("node", "c")
        merged = e.join(up.toDF("a", "ca"), "a").join(up.toDF("b", "cb"), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight"))
        before = k.count()
        e = written(merged, "level")
        if label.select("c").distinct().count() == before:
            break
    return mapping if mapping is not None else und.select(F.col("a").alias("node"), F.col("a").alias("community")).limit(0)


def betweenness(graph: DataFrame, most_nodes: int = 300, weighted: bool = True) -> DataFrame:
    """(node, betweenness), normalised, of the subgraph that the most_nodes nodes of highest degree induce; weights are distances.

    The subgraph (bounded by most_nodes squared edges) goes to the tasks, each of which runs Brandes from its share of the sources.
    """
    keep = written(top_nodes(graph, most_nodes), "top")
    sub = induced(graph, keep).select("src", "dst", "weight")
    names = sorted(r[0] for r in keep.collect())
    at = {n: i for i, n in enumerate(names)}
    adj: list[list[tuple[int, float]]] = [[] for _ in names]
    for r in sub.collect():
        adj[at[r.src]].append((at[r.dst], float(r.weight) if weighted else 1.0))
    spark = graph.sparkSession
    sent = spark.sparkContext.broadcast((names, adj))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names_, adj_ = sent.value
        total = np.zeros(len(names_))
        for pdf in batches:
            for s in pdf["id"]:
                total += _brandes(int(s), adj_)
        yield pd.DataFrame({"i": np.arange(len(names_)), "b": total})

    n = len(names)
    parts = spark.range(0, n, 1, max(1, min(32, n // 10))).mapInPandas(run, "i int, b double").groupBy("i").agg(F.sum("b").alias("b"))
    scale = 1.0 / max((n - 1) * (n - 2), 1)
    lookup = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, node string")
    return lookup.join(parts, "i", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _brandes(s: int, adj: list[list[tuple[int, float]]]) -> np.ndarray:
    import heapq

    n = len(adj)
    dist, sigma, before, order = [np.inf] * n, [0.0] * n, [[] for _ in range(n)], []
    dist[s], sigma[s], heap, done = 0.0, 1.0, [(0.0, s)], [False] * n
    while heap:
        d, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for w, x in adj[v]:
            if d + x < dist[w] - 1e-12:
                dist[w], sigma[w], before[w] = d + x, sigma[v], [v]
                heapq.heappush(heap, (dist[w], w))
            elif abs(d + x - dist[w]) <= 1e-12 and not done[w]:
                sigma[w] += sigma[v]
                before[w].append(v)
    share, out = [0.0] * n, np.zeros(n)
    for w in reversed(order):
        for v in before[w]:
            share[v] += sigma[v] / sigma[w] * (1 + share[w])
        if w != s:
            out[w] += share[w]
    return out


def largest_clique(und: DataFrame) -> DataFrame:
    """One row: the size of the largest clique. Each node of the oriented graph searches among its successors, at most its core number of them."""
    e, _ = oriented(und)
    succ = e.groupBy("u").agg(F.collect_set("v").alias("vs"))  # bounded by sqrt(2m) through the orientation
    inner = e.select(F.col("u").alias("p"), F.col("v").alias("q"))
    pairs = succ.select("u", F.explode("vs").alias("p")).join(inner, "p").join(e.select("u", F.col("v").alias("q")), ["u", "q"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        adj: dict = {}
        for p, q in zip(pdf["p"], pdf["q"]):
            adj.setdefault(p, set()).add(q)
            adj.setdefault(q, set()).add(p)
        best = 0

        def grow(size: int, cand: set, gone: set) -> None:
            nonlocal best
            best = max(best, size)
            if size + len(cand) <= best:
                return
            pivot = max(cand | gone, key=lambda x: len(adj[x] & cand))
            for v in list(cand - adj[pivot]):
                grow(size + 1, cand & adj[v], gone & adj[v])
                cand.discard(v)
                gone.add(v)

        grow(1, set(adj), set())
        return pd.DataFrame({"size": [best]})

    found = pairs.groupBy("u").applyInPandas(search, "size int").agg(F.max("size").alias("size"))
    any_edge = und.agg(F.when(F.count(F.lit(1)) > 0, 2).otherwise(0).alias("least"))
    return found.join(F.broadcast(any_edge)).select(F.greatest(F.coalesce("size", F.lit(0)), F.col("least")).cast("int").alias("largest_clique"))


def spectral_gap(und: DataFrame, most_nodes: int = 2000) -> float:
    """The second smallest eigenvalue of the normalised Laplacian; raises beyond most_nodes nodes."""
    names = [r[0] for r in und.select("a").union(und.select("b")).distinct().limit(most_nodes + 1).collect()]
    if len(names) > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes")
    at = {n: i for i, n in enumerate(sorted(names))}
    w = np.zeros((len(at), len(at)))
    for r in und.collect():
        w[at[r.a], at[r.b]] = w[at[r.b], at[r.a]] = r.weight
    d = np.where(w.sum(1) > 0, w.sum(1), 1.0) ** -0.5
    values = np.linalg.eigvalsh(np.eye(len(at)) - d[:, None] * w * d[None, :])
    return float(values[1] - values[0]) if len(values) > 1 else 0.0
