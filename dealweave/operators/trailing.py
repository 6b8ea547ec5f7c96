"""Totals and averages over trailing days by block decomposition.

The days of an entity are cut into blocks as long as the longest window. A block's row meets its predecessor's days, and inside
these two blocks every window of w days is one suffix sum plus one prefix sum of sub-blocks of w days, so no window is summed
day by day and no entity is ever sorted or held whole: work is split by (entity, block).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_sums(x: np.ndarray, w: int) -> np.ndarray:
    """For each row and column i of x, the sum over the w columns that end at i (fewer at the left edge)."""
    n, m = x.shape
    pad = -m % w
    b = np.concatenate([x, np.zeros((n, pad))], axis=1).reshape(n, -1, w)
    prefix = b.cumsum(axis=2).reshape(n, -1)[:, :m]
    suffix = b[:, :, ::-1].cumsum(axis=2)[:, :, ::-1].reshape(n, -1)[:, :m]
    out = prefix.copy()
    i = np.arange(m)
    crosses = (i % w != w - 1) & (i >= w)
    out[:, crosses] += suffix[:, i[crosses] - w + 1]
    return out


def trailing_totals(
    rows: DataFrame,
    *,
    entity: Sequence[str],
    day: str,
    value: str | None = None,
    windows: Sequence[int] = (7, 30),
    until: str = "active",
) -> DataFrame:
    """For each entity and day: total_w, n_w and mean_w over the w days that end on it, for each w of windows.

    Days without rows are included. until="active" gives every day, also after the last row, whose longest window holds a row;
    "last" the same up to the entity's last day with a row; "span" every day from the first to the last. n_w counts rows whose
    value is not NULL (all rows if value is None, when total_w equals n_w); mean_w is NULL where n_w is 0. A NULL in an entity column or
    in day drops the row; repeated rows count as often as they occur; an empty table gives no rows. Sums are doubles, exact for whole
    numbers under 2**53. Result columns: the entity columns, day, total_w, n_w, mean_w; other input columns are ignored.
    """
    span = max(windows)
    keys = [f"_e{i}" for i in range(len(entity))]
    measure = F.lit(1.0) if value is None else F.col(value).cast("double")
    daily = (
        rows.select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.unix_date(F.col(day).cast("date")).alias("_d"), measure.alias("_v"))
        .na.drop(subset=[*keys, "_d"])
        .groupBy(*keys, "_d")
        .agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_v"), F.count("_v").alias("_n"))
    )
    at = F.floor(F.col("_d") / F.lit(span)).cast("int")
    placed = daily.select(*keys, "_v", "_n", "_d", F.explode(F.array(at, at + 1)).alias("_b"))
    blocks = placed.groupBy(*keys, "_b").agg(
        F.sort_array(F.collect_list(F.struct((F.col("_d") - (F.col("_b") - 1) * span).cast("int").alias("o"), "_v", "_n"))).alias("_days")
    )
    if until == "active":
        blocks = blocks.withColumns({"_lo": F.lit(None).cast("int"), "_hi": F.lit(None).cast("int")})
    else:
        ends = daily.groupBy(*keys).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
        if until == "span":
            every = ends.select(*keys, F.explode(F.sequence(F.floor(F.col("_lo") / span).cast("int"), F.floor(F.col("_hi") / span).cast("int"))).alias("_b"), "_lo", "_hi")
            blocks = every.join(blocks, [*keys, "_b"], "left")
        else:
            blocks = blocks.join(ends, keys)
    kinds = [daily.schema[k].dataType for k in keys]
    schema = ", ".join(
        [f"{k} {t.simpleString()}" for k, t in zip(keys, kinds)] + ["_d int"] + [f"total_{w} double, n_{w} long, mean_{w} double" for w in windows]
    )
    everything = until == "span"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield _block_batch(batch.slice(at, 4096), keys, span, windows, everything)

    out = blocks.select(*keys, "_b", "_lo", "_hi", F.coalesce("_days", F.array().cast(blocks.schema["_days"].dataType)).alias("_days")).mapInArrow(kernel, schema)
    return out.select(
        *[F.col(k).alias(c) for c, k in zip(entity, keys)], F.date_from_unix_date("_d").alias("day"), *[f"{m}_{w}" for w in windows for m in ("total", "n", "mean")]
    )


def _block_batch(batch: pa.RecordBatch, keys: list[str], span: int, windows: Sequence[int], everything: bool) -> pa.RecordBatch:
    n = batch.num_rows
    days = batch.column("_days")
    lengths = np.diff(days.offsets.to_numpy())
    row = np.repeat(np.arange(n), lengths)
    flat = days.flatten()
    at = flat.field("o").to_numpy(zero_copy_only=False)
    v, c = np.zeros((n, 2 * span)), np.zeros((n, 2 * span))
    v[row, at] = flat.field("_v").to_numpy(zero_copy_only=False)
    c[row, at] = flat.field("_n").to_numpy(zero_copy_only=False)
    has = np.zeros((n, 2 * span))
    has[row, at] = 1
    first = batch.column("_b").to_numpy(zero_copy_only=False).astype(np.int64)[:, None] * span + np.arange(span)
    keep = np.ones((n, span), bool) if everything else block_sums(has, span)[:, span:] > 0
    if batch.column("_lo").null_count == 0 and n:
        lo, hi = (batch.column(x).to_numpy(zero_copy_only=False)[:, None] for x in ("_lo", "_hi"))
        keep &= (first >= lo) & (first <= hi)
    r, o = np.nonzero(keep)
    cols: dict[str, pa.Array] = {k: batch.column(k).take(pa.array(r)) for k in keys}
    cols["_d"] = pa.array(first[r, o].astype(np.int32))
    for w in windows:
        total, count = (block_sums(x, w)[:, span:][r, o] for x in (v, c))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = total / count
        cols[f"total_{w}"] = pa.array(total)
        cols[f"n_{w}"] = pa.array(np.rint(count).astype(np.int64))
        cols[f"mean_{w}"] = pa.array(mean, mask=count == 0)
    return pa.RecordBatch.from_pydict(cols)
