"""Local moving over packed neighbour lists, for graphs whose nodes (not edges) fit into memory.

Nodes are numbers in the order of their names. Neighbour lists are packed once a level into a table of binary rows; a round is one pass over it without a
shuffle, with the labels sent to the tasks (20 bytes a node), and gives the nodes that move. Driver and tasks never hold more of the edges than a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.session import dropped, written

ROW_EDGES, PART_EDGES = 200_000, 1_000_000
_PACKED = "parity int, nodes binary, degrees binary, near binary, weights binary"


def moved_communities(und: DataFrame, hashes: np.ndarray, resolution: float, rounds: int, levels: int) -> np.ndarray:
    """The community of each node of und (a, b, weight), a number; hashes has xxhash64 of the nodes' names in the order of the names, all different."""
    spark, n = und.sparkSession, len(hashes)
    sc, parity = spark.sparkContext, (hashes & 1).astype(np.uint8)
    order = np.argsort(hashes)
    sent = sc.broadcast((hashes[order], order.astype(np.int32)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = sent.value
        for b in batches:
            ends = [pa.array(at[np.searchsorted(known, b.column(c).to_numpy())]) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ends, b.column(2)], names=["a", "b", "weight"])

    e = written(und.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), F.col("weight").cast("double")).mapInArrow(number, "a int, b int, weight double"), "level")
    mapping, alive = np.arange(n, dtype=np.int32), n
    for _ in range(levels):
        ends = e.select(F.inline(F.array(F.struct(F.col("a").alias("node"), "weight"), F.struct(F.col("b").alias("node"), "weight"))))
        s = ends.groupBy("node").agg(F.sum("weight").alias("k")).toArrow()
        k = np.zeros(n)
        k[s.column("node").to_numpy()] = s.column("k").to_numpy()
        m2 = float(k.sum())
        if not m2:
            break
        near = _packed(e, parity)
        label = np.arange(n, dtype=np.int32)
        for r in range(rounds):
            moves = _round(near.filter(F.col("parity") == r % 2), label, k, m2, resolution)
            label[moves.column("node").to_numpy()] = moves.column("c").to_numpy()
            if r and not moves.num_rows:
                break
        dropped(near)
        mapping = label[mapping]
        before, alive = alive, len(np.unique(mapping))
        if alive == before:
            break
        last, e = e, written(_contracted(e, label), "level")
        dropped(last)
    return mapping


def _packed(e: DataFrame, parity: np.ndarray) -> DataFrame:
    """The neighbours of each node but itself, those of many nodes in a row."""
    e = e.filter("a <> b")
    parts = max(12, 2 * e.count() // PART_EDGES)
    sent = e.sparkSession.sparkContext.broadcast(parity)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "weight"))
        for p in (0, 1):
            keep = np.flatnonzero(sent.value[a] == p)
            keep = keep[np.argsort((a[keep].astype(np.int64) << 32) | b[keep])]
            x, y, z = a[keep], b[keep], w[keep]
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            degrees = np.diff(np.append(starts, len(x)))
            cut = np.flatnonzero(np.diff(starts // ROW_EDGES)) + 1 if len(starts) else []
            for some in np.split(np.arange(len(starts)), cut):
                if len(some):
                    lo, hi = starts[some[0]], starts[some[-1]] + degrees[some[-1]]
                    row = [x[starts[some]].tobytes(), degrees[some].astype(np.int32).tobytes(), y[lo:hi].tobytes(), z[lo:hi].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([v], pa.binary()) for v in row)], names=["parity", "nodes", "degrees", "near", "weights"])

    both = e.select("a", "b", "weight").union(e.select("b", "a", "weight"))
    return written(both.repartition(parts, "a").mapInArrow(pack, _PACKED), "near")


def _round(near: DataFrame, label: np.ndarray, k: np.ndarray, m2: float, resolution: float) -> pa.Table:
    """(node, c) of the nodes that move: to the community of the greatest gain, rounded; of equal ones to its own, else to the smallest."""
    sent = near.sparkSession.sparkContext.broadcast((label, k, np.bincount(label, weights=k, minlength=len(label))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label_, k_, total = sent.value
        for b in batches:
            for nodes, degrees, ends, weights in zip(*(b.column(c).to_pylist() for c in ("nodes", "degrees", "near", "weights"))):
                u, w = np.frombuffer(nodes, np.int32), np.frombuffer(weights, np.float64)
                row = np.concatenate([np.repeat(np.arange(len(u)), np.frombuffer(degrees, np.int32)), np.arange(len(u))])
                c = np.concatenate([label_[np.frombuffer(ends, np.int32)], label_[u]])
                w = np.concatenate([w, np.zeros(len(u))])
                order = np.argsort((row << 32) | c, kind="stable")
                row, c, w = row[order], c[order], w[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (c[1:] != c[:-1])]))
                row, c, w = row[first], c[first], np.add.reduceat(w, first)
                mine, strength = label_[u][row], k_[u][row]
                g = np.round(w - resolution * strength * (total[c] - np.where(c == mine, strength, 0.0)) / m2, 9)
                at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                top = np.maximum.reduceat(g, at)[row]
                best = np.minimum.reduceat(np.where(g == top, np.where(c == mine, -1, c), np.iinfo(np.int32).max), at)
                go = best >= 0
                yield pa.RecordBatch.from_arrays([pa.array(u[go]), pa.array(best[go].astype(np.int32))], names=["node", "c"])

    moves = near.select("nodes", "degrees", "near", "weights").mapInArrow(run, "node int, c int").toArrow()
    sent.destroy()
    return moves


def _contracted(e: DataFrame, label: np.ndarray) -> DataFrame:
    sent = e.sparkSession.sparkContext.broadcast(label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (sent.value[b.column(c).to_numpy()] for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), b.column("weight")], names=["a", "b", "weight"])

    return e.mapInArrow(run, "a int, b int, weight double").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
