"""Diffusion over a graph (src, dst): independent cascades, linear thresholds, contagion with recovery.

Coins are hashes of (run, edge or node, round), so a run is reproducible whatever the partitions are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.session import written


def coin(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first eight hex digits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cascade(graph: DataFrame, seeds: DataFrame, p: float, rounds: int | None = None, draw: Callable[[Column], Column] = lambda run: run) -> DataFrame:
    """(run, node, round): independent cascades from seeds (run, node); each edge is tried once, when its source becomes active. They run out, or end after rounds.

    Runs of which draw makes the same share their coins.
    """
    edges = graph.select("src", "dst").distinct()
    seen = front = written(seeds.select("run", "node", F.lit(0).alias("round")).distinct(), "cascade")
    for r in count(1) if rounds is None else range(1, rounds + 1):
        tried = front.join(edges, front["node"] == edges["src"]).filter(coin(draw(F.col("run")).cast("string"), "src", "dst") < p)
        front = written(tried.select("run", F.col("dst").alias("node")).distinct().join(seen, ["run", "node"], "left_anti").withColumn("round", F.lit(r)), "cascade")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def thresholds(graph: DataFrame, seeds: DataFrame, lo: float = 0.3, hi: float = 0.7, rounds: int | None = None) -> DataFrame:
    """(run, node, round): a node turns active once the share of its in-neighbours that are active reaches its threshold in [lo, hi); until none does, or for rounds."""
    edges = graph.select("src", "dst").distinct()
    need = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("all"))
    seen = written(seeds.select("run", "node", F.lit(0).alias("round")).distinct(), "active")
    for r in count(1) if rounds is None else range(1, rounds + 1):
        on = seen.join(edges, seen["node"] == edges["src"]).groupBy("run", "dst").agg(F.count(F.lit(1)).alias("on")).join(need, "dst")
        reached = on.filter(F.col("on") / F.col("all") >= F.lit(lo) + F.lit(hi - lo) * coin(F.col("run").cast("string"), "dst"))
        new = written(reached.select("run", F.col("dst").alias("node")).join(seen, ["run", "node"], "left_anti").withColumn("round", F.lit(r)), "active")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def contagion(graph: DataFrame, seeds: DataFrame, beta: float, gamma: float, rounds: int = 10) -> DataFrame:
    """(run, round, infected, recovered): nodes ill and recovered after each round; ends early once nobody is ill."""
    edges = written(graph.select("src", "dst").distinct(), "edges")
    state = written(seeds.select("run", "node", F.lit(True).alias("ill")).distinct(), "state")
    after = state.select("run", F.lit(0).alias("round"), "ill")
    for r in range(1, rounds + 1):
        ill = state.filter("ill")
        tried = ill.join(edges, ill["node"] == edges["src"]).filter(coin(F.col("run").cast("string"), "src", "dst", F.lit(str(r))) < beta)
        new = tried.select("run", F.col("dst").alias("node")).distinct().join(state, ["run", "node"], "left_anti").withColumn("ill", F.lit(True))
        heals = coin(F.col("run").cast("string"), "node", F.lit(f"h{r}")) < gamma
        state = written(state.withColumn("ill", F.col("ill") & ~heals).unionByName(new), "state")
        after = after.unionByName(state.select("run", F.lit(r).alias("round"), "ill"))
        if state.filter("ill").isEmpty():
            break
    return after.groupBy("run", "round").agg(F.count_if("ill").alias("infected"), F.count_if(~F.col("ill")).alias("recovered"))


def _live(p: float, *parts: Column | str) -> Column:
    """Whether the coin of the parts is below p, told from the hex digits."""
    most = math.ceil(p * 2**32)
    return F.lit(most > 0) if not 0 < most < 2**32 else F.md5(F.concat_ws("|", *parts)) < F.lit(f"{most:08x}")


def _reached(graph: DataFrame, names: list[str], p: float, sims: int, rounds: int | None) -> DataFrame:
    """(bits, n): how many pairs of simulation and node the same candidates reach, a bit for each of names. A task takes the edges that a simulation's coins let pass."""
    spark = graph.sparkSession
    sim = F.explode(F.array(*[F.lit(i) for i in range(sims)])).alias("sim")
    live = graph.select("src", "dst", sim).filter(_live(p, F.col("sim").cast("string"), "src", "dst")).select("sim", F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d"))
    at = F.xxhash64("node")
    own = spark.createDataFrame([(x,) for x in names], "node string").select(at.alias("s"), at.alias("d"), sim).select("sim", "s", "d")
    starts = np.array([r[0] for r in spark.createDataFrame(list(enumerate(names)), "i int, node string").orderBy("i").select(at).collect()])

    def run(t: pa.Table) -> pa.Table:
        nodes, ends = np.unique(np.concatenate([t.column("s").to_numpy(), t.column("d").to_numpy()]), return_inverse=True)
        src, dst = ends[: t.num_rows], ends[t.num_rows :]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        into, seen = dst[first], np.zeros(len(nodes), np.int64)
        np.bitwise_or.at(seen, np.searchsorted(nodes, starts), np.int64(1) << np.arange(len(starts)))
        front = seen.copy()
        for _ in count(1) if rounds is None else range(rounds):
            new = np.bitwise_or.reduceat(front[src], first) & ~seen[into]
            if not new.any():
                break
            front[:] = 0
            front[into] = new
            seen[into] |= new
        bits, n = np.unique(seen[seen != 0], return_counts=True)
        return pa.table({"bits": bits, "n": n})

    return live.unionByName(own).groupBy("sim").applyInArrow(run, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n"))


def greedy_influence(graph: DataFrame, candidates: DataFrame, k: int, p: float, sims: int = 10, rounds: int | None = None, local_edges: int = 4_000_000) -> list[str]:
    """The k seeds of candidates (node) that greedily add most to the mean spread, fewer once none adds anything; ties go to the smaller.

    All candidates of a simulation share its coins, so what several seeds reach together is the union of what each reaches: one cascade of all
    candidates and simulations is enough, and each step counts what a candidate adds to what is covered. Up to 62 candidates and about local_edges edges
    that a simulation lets pass, a task takes a whole simulation with a bit for each candidate; beyond, rounds are joins.
    """
    spark = graph.sparkSession
    names = sorted(r[0] for r in candidates.select("node").distinct().limit(63).collect())
    if 0 < len(names) < 63 and graph.count() * min(p, 1.0) <= local_edges:
        reached = written(_reached(graph, names, p, sims, rounds), "reached")
        picked: list[int] = []
        while len(picked) < k:
            free = (F.col("bits").bitwiseAND(F.lit(sum(1 << i for i in picked)).cast("long"))) == 0
            added = reached.filter(free).agg(*[F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col("n"))) for i in range(len(names))]).first()
            n, i = max(((n or 0, -i) for i, n in enumerate(added)))
            if not n:
                break
            picked.append(-i)
        return [names[i] for i in picked]
    runs = candidates.select("node").distinct().crossJoin(F.broadcast(spark.range(sims).select(F.col("id").alias("sim"))))  # sims is a small constant
    sim = lambda run: F.element_at(F.split(run, "~"), -1)
    reached = cascade(graph, runs.select(F.concat_ws("~", "node", "sim").alias("run"), "node"), p, rounds, sim)
    reached = written(reached.select(F.regexp_extract("run", "^(.*)~[0-9]+$", 1).alias("candidate"), sim(F.col("run")).alias("sim"), "node"), "reached")
    chosen: list[str] = []
    for _ in range(k):
        left = reached
        if chosen:
            done = F.col("candidate").isin(chosen)
            left = reached.filter(~done).join(reached.filter(done).select("sim", "node").distinct(), ["sim", "node"], "left_anti")
        best = left.groupBy("candidate").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "candidate").first()
        if best is None:
            break
        chosen.append(best.candidate)
    return chosen
