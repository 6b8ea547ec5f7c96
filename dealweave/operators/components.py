"""Connected components over a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.session import written


def components(links: DataFrame, a: str, b: str, most: int = 50) -> DataFrame:
    """(node, root): for each node of a link the smallest node of its component. a and b are whole numbers.

    Each round links every node to the smallest node it knows of, then each node's neighbours to that (a large and a small star in turn),
    so chains shrink by half a round. Links are kept distinct and one way, so a hot node's links are only ever aggregated, never collected.
    """
    e = written(
        links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v").distinct(), "links"
    )
    seen = None
    for _ in range(most):
        # Large star: each node's larger neighbours go to the smallest node among it and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        e = written(
            met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(),
            "links",
        )
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
