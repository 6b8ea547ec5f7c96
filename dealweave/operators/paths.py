"""Distances between all pairs of nodes, for graphs whose seats fit into a task.

A graph is given by seats (company, side, node): every node of one side of a company is a neighbour of every node of the other. A round of rounds and
investors has far fewer seats than edges, and any edge is a company with one node on each side. One task numbers the seats of the largest component;
all tasks get them (8 bytes a seat) and take breadth-first search from 256 nodes at once, a bit for each: bits go from nodes to sides of companies and on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, CHUNK, HEAVY, PART = 4, 65_536, 512, 4 << 20


def all_pairs(seats: DataFrame, most_nodes: int | None = None) -> DataFrame:
    """One row (diameter, mean_distance) over the largest component; of equal ones that with the smallest node. Raises beyond most_nodes, if given."""
    spark = seats.sparkSession
    rows = seats.select(F.xxhash64("company").alias("c"), F.col("side").cast("int").alias("s"), F.col("node").cast("string").alias("v")).distinct()
    packed = rows.repartition(1).mapInArrow(_pack, "name string, part int, bytes binary").toArrow().sort_by([("name", "ascending"), ("part", "ascending")])
    joined: dict[str, list[bytes]] = {}
    for name, b in zip(packed.column("name").to_pylist(), packed.column("bytes").to_pylist()):
        joined.setdefault(name, []).append(b)
    arrays = {k: np.frombuffer(b"".join(v), np.int32) for k, v in joined.items()}
    size = len(arrays["node_n"]) if arrays else 0
    if most_nodes is not None and size > most_nodes:
        raise ValueError(f"the largest component has {size} nodes; distances between all are taken up to {most_nodes}")
    if size < 2:
        return spark.createDataFrame([(None, None)], "diameter int, mean_distance double")
    return _searched(spark, arrays, size)


def _searched(spark: SparkSession, arrays: dict[str, np.ndarray], size: int) -> DataFrame:
    sent = spark.sparkContext.broadcast(arrays)
    blocks = -(-size // (64 * WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Graph(sent.value)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([dict(zip(("most", "total", "pairs"), g.search(block)))], pa.schema([("most", pa.int32()), ("total", pa.int64()), ("pairs", pa.int64())]))

    by = spark.range(0, blocks, 1, min(blocks, 400)).mapInArrow(run, "most int, total long, pairs long")
    return by.agg(F.max("most").alias("diameter"), (F.sum("total") / F.sum("pairs")).alias("mean_distance"))


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n, dtype=np.int64) - n


def _encoded(c: pa.ChunkedArray) -> pa.DictionaryArray:
    c = c.combine_chunks()
    return (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c).dictionary_encode()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seats of the largest component as arrays of int32, in parts: sides by size and nodes by number of seats, the largest first."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    got = pa.Table.from_batches(got)
    names, companies = (_encoded(got.column(c)) for c in "vc")
    place = np.empty(len(names.dictionary), np.int32)
    place[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(place), dtype=np.int32)  # numbers in the order of names
    node, company, side = place[names.indices.to_numpy()], companies.indices.to_numpy(), got.column("s").to_numpy().astype(np.int8)
    del got, names, companies
    # Only companies with both sides make neighbours.
    m = int(company.max()) + 1
    both = (np.bincount(company[side == 0], minlength=m) > 0) & (np.bincount(company[side == 1], minlength=m) > 0)
    keep = both[company]
    node, side, company = node[keep], side[keep], company[keep]
    if not len(node):
        return
    label = _labels(node, company, len(place))
    sizes = np.bincount(label[np.unique(node)], minlength=len(place))
    inside = label[node] == np.argmax(sizes)
    node, side = node[inside], side[inside] + 2 * company[inside]

    def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x numbered from the most frequent on, what the numbers stand for, how often)"""
        n = np.bincount(x)
        order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
        back = np.zeros(len(n), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        return back[x], order, n[order]

    v, _, node_n = numbered(node)
    h, stands, side_n = numbered(side)
    order = np.argsort(stands)
    other = order[np.searchsorted(stands[order], stands ^ 1)]
    for name, x in {"node_n": node_n, "node_of": other[h[np.argsort(v, kind="stable")]], "side_n": side_n, "side_of": v[np.argsort(h, kind="stable")], "other": other}.items():
        b = x.astype(np.int32).tobytes()
        for i in range(0, len(b), PART):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // PART], pa.int32()), pa.array([b[i : i + PART]], pa.binary())], names=["name", "part", "bytes"])


def _labels(node: np.ndarray, company: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n, dtype=np.int32)
    by_c, by_v = np.argsort(company, kind="stable"), np.argsort(node, kind="stable")
    node_c, company_v = node[by_c], company[by_v]
    at_c, at_v = (np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) for x in (company[by_c], node[by_v]))
    cs, vs = company[by_c][at_c], node[by_v][at_v]
    low = np.empty(int(company.max()) + 1, np.int32)
    while True:
        low[cs] = np.minimum.reduceat(label[node_c], at_c)
        new = label.copy()
        new[vs] = np.minimum(new[vs], np.minimum.reduceat(low[company_v], at_v))
        while (new != (next_ := new[new])).any():
            new = next_
        if (new == label).all():
            return label
        label = new


class _Graph:
    def __init__(self, a: dict[str, np.ndarray]):
        self.other = a["other"]
        self.node = (_starts(a["node_n"]), a["node_n"], a["node_of"])  # the opposite sides of each node's seats
        self.side = (_starts(a["side_n"]), a["side_n"], a["side_of"])
        self.n, self.bits = len(a["node_n"]), np.zeros((len(a["side_n"]), WORDS), np.uint64)

    def search(self, block: int) -> tuple[int, int, int]:
        """(greatest distance, sum of distances, pairs) from the nodes of a block."""
        first = 64 * WORDS * block
        k = np.arange(min(64 * WORDS, self.n - first))
        seen = np.zeros((self.n, WORDS), np.uint64)
        seen[first + k, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
        full, front = np.bitwise_or.reduce(seen, axis=0), seen.copy()
        reached = first + k
        dist = total = pairs = 0
        left = np.flatnonzero((seen != full).any(axis=1))
        while len(left):
            # From few nodes on: what they reach. Else: what those reach that still miss some.
            if 8 * len(reached) < self.n:
                sides = np.unique(self.other[_listed(self.node, reached)])
                near = np.zeros(self.n, bool)
                near[_listed(self.side, self.other[sides])] = True
                to = left[near[left]]
            else:
                to = left
                fed = np.zeros(len(self.bits), bool)
                fed[_listed(self.node, to)] = True
                sides = np.flatnonzero(fed)
            for at in range(0, len(sides), CHUNK):
                some = sides[at : at + CHUNK]
                self.bits[some] = _ored(front, self.side, some)
            new = np.empty((len(to), WORDS), np.uint64)
            for at in range(0, len(to), CHUNK):
                some = to[at : at + CHUNK]
                new[at : at + CHUNK] = _ored(self.bits, self.node, some) & ~seen[some]
            self.bits[sides] = 0
            front[:] = 0
            front[to] = new
            seen[to] |= new
            n = int(np.bitwise_count(new).sum(dtype=np.int64))
            if not n:
                break
            dist, pairs, total = dist + 1, pairs + n, total + n * (dist + 1)
            reached = to[new.any(axis=1)]
            left = left[(seen[left] != full).any(axis=1)]
        return dist, total, pairs


def _listed(of: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The entries of some rows, one after the other."""
    starts, n, entries = of
    k = n[rows].astype(np.int64)
    return entries[np.repeat(starts[rows] - _starts(k), k) + np.arange(int(k.sum()))]


def _ored(bits: np.ndarray, of: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """For each of some rows, in ascending order and so of descending length, its entries' bits together."""
    starts, n, entries = of
    k, at = n[rows], starts[rows]
    out = np.zeros((len(rows), bits.shape[1]), np.uint64)
    heavy = int(np.searchsorted(-k, -HEAVY, "left"))
    for i in range(heavy):
        out[i] = np.bitwise_or.reduce(bits[entries[at[i] : at[i] + k[i]]], axis=0)
    k, at, rest = k[heavy:], at[heavy:], out[heavy:]
    for j in range(int(k[0]) if len(k) else 0):
        m = int(np.searchsorted(-k, -j, "left"))
        rest[:m] |= bits.take(entries.take(at[:m] + j), axis=0)
    return out
