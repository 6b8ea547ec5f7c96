"""Prescience scores: who is early where the central investors come later. Static, and as known at each of many dates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealweave.operators.deals import assemble
from dealweave.operators.graph import degrees
from dealweave.session import written

PERCENTILE = 0.8


def top_tier(graph: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """(node, in_weight, in_rank): nodes whose weighted in-degree reaches the percentile over all nodes; in_rank is relative to the largest."""
    return _top_tier(degrees(graph), percentile)


def _top_tier(degrees_: DataFrame, percentile: float) -> DataFrame:
    d = degrees_.select("node", "in_weight")
    cut = d.agg(F.percentile("in_weight", F.lit(percentile)).alias("cut"), F.max("in_weight").alias("most"))
    return d.join(F.broadcast(cut)).filter("in_weight >= cut").select("node", "in_weight", (F.col("in_weight") / F.col("most")).alias("in_rank"))


def static_scores(edges: DataFrame, deals: DataFrame, percentile: float = PERCENTILE, known: DataFrame | None = None) -> DataFrame:
    """(investor, tps_raw, top_tier_targets, companies_hit, portfolio_size, tps, out_degree) over all dates; known: the degrees of the edges' graph, where a table has them."""
    known = degrees(assemble(edges)) if known is None else known
    top = _top_tier(known, percentile)
    portfolio = deals.groupBy(F.col("investor_name").alias("investor")).agg(F.countDistinct("company_name").alias("portfolio_size"))
    hit = edges.join(top.select(F.col("node").alias("target"), "in_rank"), "target")
    raw = hit.groupBy(F.col("source").alias("investor")).agg(
        F.sum(F.col("weight") * F.col("in_rank")).alias("tps_raw"), F.countDistinct("target").alias("top_tier_targets"), F.countDistinct("company").alias("companies_hit")
    )
    out = known.select(F.col("node").alias("investor"), F.col("out_weight").alias("out_degree"))
    s = raw.join(portfolio, "investor", "left").join(out, "investor", "left").withColumn("portfolio_size", F.coalesce("portfolio_size", F.lit(1)))
    return s.select("investor", "tps_raw", "top_tier_targets", "companies_hit", "portfolio_size", (F.col("tps_raw") / F.col("portfolio_size")).alias("tps"), F.coalesce("out_degree", F.lit(0.0)).alias("out_degree"))


def expanding_scores(edges: DataFrame, dates: DataFrame, percentile: float = PERCENTILE, edge_time: str = "source_date", min_portfolio: int = 1) -> DataFrame:
    """(eval_date, investor, tps, in_top_tier): the scores from the edges dated up to each eval_date of dates.

    dates is a short list (quarters), so a node's weights over all dates are one array, and only a node's own row is as long as the dates: pairs are
    kept by the dates on which they change, in whole millionths, so sums don't depend on their order. What the driver gets is a few numbers a date.
    """
    days = [r[0] for r in dates.select("eval_date").filter("eval_date is not null").distinct().orderBy("eval_date").collect()]
    kind = dates.schema["eval_date"].dataType
    if not days:
        return edges.sparkSession.createDataFrame([], T.StructType([T.StructField("eval_date", kind), T.StructField("investor", T.StringType()), T.StructField("tps", T.DoubleType()), T.StructField("in_top_tier", T.BooleanType())]))

    def first_seen(lo: int, hi: int) -> Column:
        """The number, from 0, of the first date up to which an edge counts, len(days) where none does."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(edge_time) <= F.lit(days[mid]), first_seen(lo, mid)).otherwise(first_seen(mid + 1, hi))

    seen = edges.filter(F.col(edge_time).isNotNull()).select("source", "target", "company", "weight", first_seen(0, len(days)).alias("i")).filter(F.col("i") < len(days))
    # Distinct companies of an investor's outgoing edges, by the first date that saw each.
    grown = seen.groupBy("source", "company").agg(F.min("i").alias("i")).groupBy("source", "i").agg(F.count(F.lit(1)).alias("n"))
    grown = written(grown, "portfolios", "zstd")
    # A pair's weight holds from its step to its next one. All of a target's pairs lie in one partition, so the steps after this need no shuffle.
    steps = seen.select("source", "target", "weight", "i").repartition("target").groupBy("target", "source", "i").agg(F.sum("weight").alias("w"))
    pair = Window.partitionBy("target", "source").orderBy("i")
    state = steps.select("target", "source", "i", F.sum("w").over(pair).alias("raw"), F.lead("i", 1, len(days)).over(pair).alias("until"))
    units = state.select("target", "source", "i", F.round(F.round("raw", 6) * 1e6).cast("long").alias("u"))
    added = units.select("target", "i", (F.col("u") - F.lag("u", 1, 0).over(pair)).alias("d")).groupBy("target", "i").agg(F.sum("d").alias("d"))
    ends = added.withColumnRenamed("target", "node").unionByName(grown.select(F.col("source").alias("node"), "i", F.lit(0).cast("long").alias("d")))
    weights = F.array(*[F.sum(F.when(F.col("i") <= j, F.col("d"))) for j in range(len(days))])  # NULL before the node's first edge
    node = written(ends.groupBy("node").agg(weights.alias("iw")), "nodes", "zstd")

    known = node.agg(*[F.count(F.col("iw")[j]).alias(f"n{j}") for j in range(len(days))], *[F.max(F.col("iw")[j]).alias(f"m{j}") for j in range(len(days))]).first()
    at = {j: percentile * (known[f"n{j}"] - 1) for j in range(len(days)) if known[f"n{j}"]}
    by = F.array(*[F.struct(F.lit(math.floor(at.get(j, 0))).cast("long").alias("lo"), F.lit(math.ceil(at.get(j, 0))).cast("long").alias("hi")) for j in range(len(days))])[F.col("j")]
    values = node.select(F.posexplode("iw").alias("j", "v")).filter("v is not null").groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("upto", F.sum("n").over(Window.partitionBy("j").orderBy("v")))
    near = values.filter((F.col("upto") > by["lo"]) & (F.col("upto") - F.col("n") <= by["hi"])).groupBy("j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cuts = {r.j: _between(r.lo / 1e6, r.hi / 1e6, at[r.j]) for r in near.collect()}

    def listed(of: list) -> Column:
        return F.array(*[F.lit(x).cast("double") for x in of])

    cut, most = listed([cuts.get(j) for j in range(len(days))]), listed([None if known[f"m{j}"] is None else known[f"m{j}"] / 1e6 for j in range(len(days))])
    held = "array<int>" if max([0, *(known[f"m{j}"] or 0 for j in range(len(days)))]) < 1 << 31 else "array<long>"  # the narrowest that holds all weights
    tier = node.select("node", F.transform("iw", lambda v, j: F.when(v / F.lit(1e6) >= cut[j], v)).cast(held).alias("iw"))  # NULL where it isn't of the top tier
    hit = state.join(tier.filter(F.exists("iw", lambda v: v.isNotNull())).withColumnRenamed("node", "target"), "target")
    hit = hit.select("source", "i", "raw", F.slice("iw", F.col("i") + 1, F.col("until") - F.col("i")).alias("iw"), F.lit(None).cast("long").alias("n")).filter(F.exists("iw", lambda v: v.isNotNull()))
    # Weights travel as one array a pair, and portfolios beside them; dates are told apart where an investor's rows have met.
    sizes = grown.select("source", "i", F.lit(None).cast("double").alias("raw"), F.array(F.lit(0)).cast(held).alias("iw"), "n")
    met = hit.unionByName(sizes).repartition("source").select("source", "i", "raw", "n", F.posexplode("iw").alias("k", "v")).filter("v is not null").withColumn("j", F.col("i") + F.col("k"))
    s = met.groupBy("source", "j").agg(F.sum(F.col("raw") * (F.col("v") / F.lit(1e6) / most[F.col("j")])).alias("tps_raw"), F.sum("n").alias("n"))
    s = s.withColumn("size", F.sum("n").over(Window.partitionBy("source").orderBy("j"))).filter((F.col("tps_raw").isNotNull()) & (F.col("size") >= min_portfolio))
    s = s.join(tier.withColumnRenamed("node", "source"), "source", "left")
    day = F.array(*[F.lit(x) for x in days])[F.col("j")]
    return s.select(day.cast(kind).alias("eval_date"), F.col("source").alias("investor"), (F.col("tps_raw") / F.col("size")).alias("tps"), F.coalesce(F.col("iw")[F.col("j")].isNotNull(), F.lit(False)).alias("in_top_tier"))


def _between(lo: float, hi: float, at: float) -> float:
    """The value at a fractional place between two neighbours, as percentile has it."""
    return lo if lo == hi or at == math.floor(at) else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi


def temporal_split(edges: DataFrame, cutoff: str) -> DataFrame:
    return edges.withColumn("part", F.when(F.col("source_date") <= F.lit(cutoff).cast("date"), "train").otherwise("test"))


def evaluate(scores: DataFrame, test_edges: DataFrame, tier: DataFrame, n: int = 50) -> DataFrame:
    """One row: precision (investors of the top n that hit, of n), recall (hit edges of all edges to the tier) and F1."""
    best = scores.orderBy(F.desc("tps"), "investor").limit(n).select(F.col("investor").alias("source"))
    to_tier = test_edges.join(tier.select(F.col("node").alias("target")), "target", "left_semi")
    marked = to_tier.join(best.withColumn("hit", F.lit(1)), "source", "left")
    a = marked.agg(F.countDistinct(F.when(F.col("hit") == 1, F.col("source"))).alias("s"), F.count("hit").alias("h"), F.count(F.lit(1)).alias("all"))
    p, r = F.col("s") / F.lit(n), F.when(F.col("all") > 0, F.col("h") / F.col("all")).otherwise(0.0)
    return a.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
