"""Texts placed whole into containers of a fixed number of tokens.

Each text's tokens are counted with a public tokenizer; only ids and counts travel. Texts are dealt at random into groups of about
group_tokens tokens, so that a group's work and its one container that may stay half empty are bounded whatever the data's size. Within a group
the containers are as many as the tokens need; texts go, in descending order, each to the container of lowest cost among those with
room, the cost being linear in the tokens plus quadratic in each text's own length (what attention within a text costs). So containers
come out full and about equally expensive. What fits nowhere opens a further container.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The splitting pattern of the vocabulary files; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SLICE = 100_000


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(rows: DataFrame, *, row_id: str, text: str, ranks: str = RANKS) -> DataFrame:
    """(row_id, n_tokens) of each text that isn't NULL; the empty text has 0. The vocabulary file must be at the same path on every worker."""
    t = rows.select(F.col(row_id).alias("_id"), F.col(text).alias("_x")).filter("_x is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = None
        for b in batches:
            e = e or encoder(ranks)
            n = [_count(e, x) for x in b.column("_x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n, pa.int64())], names=["_id", "n_tokens"])

    return t.mapInArrow(run, f"_id {t.schema['_id'].dataType.simpleString()}, n_tokens long").withColumnRenamed("_id", row_id)


def _count(e, text: str) -> int:
    """The tokens of a text; a very long one is read in slices that end where the pattern must split, so the count is that of the whole."""
    if len(text) <= 2 * _SLICE:
        return len(e.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(at + _SLICE, len(text))
        # A letter followed by one blank and a letter is always split before the blank.
        while end < len(text) - 1 and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1].isalpha()):
            end += 1
        end = len(text) if end >= len(text) - 1 else end
        total += len(e.encode_ordinary(text[at:end]))
        at = end
    return total


def assign(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """The container of each size (all at most capacity), dealt in descending order to the cheapest container with room."""
    order = np.argsort(-sizes, kind="stable")
    n = max(1, -(-int(sizes.sum()) // capacity))
    room = [capacity] * n
    open_, out = [(0.0, k) for k in range(n)], np.zeros(len(sizes), np.int64)
    waiting: dict[int, list[tuple[float, int]]] = {}  # by room left: containers too full for the sizes so far
    last = capacity
    for i in order:
        size = int(sizes[i])
        for r in range(size, last):  # sizes fall: what waited with this much room can serve again
            for x in waiting.pop(r, ()):
                heapq.heappush(open_, x)
        last = size
        while open_ and room[open_[0][1]] < size:
            cost, k = heapq.heappop(open_)
            waiting.setdefault(room[k], []).append((cost, k))
        if open_:
            cost, k = heapq.heappop(open_)
        else:
            cost, k = 0.0, len(room)
            room.append(capacity)
        room[k] -= size
        out[i] = k
        heapq.heappush(open_, (cost + linear * size + quadratic * size * size, k))
    return out


def pack(
    rows: DataFrame,
    *,
    row_id: str,
    n_tokens: str,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    group_tokens: int = 16_000_000,
    group_parts: int = 200_000,
) -> DataFrame:
    """(row_id, piece, container, place, first_token, n_tokens): where each text goes; container is unique over the whole result.

    A text of more than capacity tokens is cut into full containers of its own and a rest; piece counts its parts from 0 and first_token is
    where the part begins in it. place counts the parts in a container from 0, the largest first. NULL counts give no row, texts of 0
    tokens take a place without room. Repeated rows are placed each by itself. Equal sizes go in the order of row_id. An empty table gives no rows.
    """
    t = rows.select(F.col(row_id).alias("_id"), F.col(n_tokens).cast("long").alias("_n")).filter("_n is not null and _n >= 0")
    # A group is bounded in tokens to place and in parts, so neither empty texts nor texts of whole containers gather in one.
    total, parts = t.agg(F.sum(F.col("_n") % capacity), F.sum(F.floor(F.col("_n") / capacity) + 1)).first()
    groups = max(1, -(-(total or 0) // group_tokens), -(-(parts or 0) // group_parts))
    kind = t.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, piece int, container long, place int, first_token long, n_tokens int"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_n", "_id"], ascending=[False, True], kind="stable", ignore_index=True)
        n = pdf["_n"].to_numpy()
        whole = np.where(n > capacity, n // capacity, 0)
        rest = n - whole * capacity
        in_rest = (rest > 0) | (whole == 0)
        box = assign(rest[in_rest], capacity, linear, quadratic)
        used = int(box.max()) + 1 if len(box) else 0
        full = np.repeat(np.arange(len(n)), whole)
        nth = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
        row = np.concatenate([np.flatnonzero(in_rest), full])
        out = pd.DataFrame(
            {
                "_id": pdf["_id"].to_numpy()[row],
                "piece": np.concatenate([whole[in_rest], nth]).astype(np.int32),
                "container": np.concatenate([box, used + np.arange(len(full))]),
                "n_tokens": np.concatenate([rest[in_rest], np.full(len(full), capacity)]).astype(np.int32),
            }
        )
        out["first_token"] = out["piece"].astype(np.int64) * capacity
        out = out.sort_values(["container", "n_tokens"], ascending=[True, False], kind="stable")
        out["place"] = out.groupby("container").cumcount().astype(np.int32)
        out["container"] += int(pdf["_g"].iloc[0]) << 32 if len(pdf) else 0
        return out[["_id", "piece", "container", "place", "first_token", "n_tokens"]]

    dealt = t.withColumn("_g", F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(groups)).cast("int"))
    return dealt.groupBy("_g").applyInPandas(fill, schema).withColumnRenamed("_id", row_id)
