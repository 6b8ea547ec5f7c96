"""Link prediction between companies and investors, over shared neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 0.01


def only_first_round(deals: DataFrame, first: str = "series-a", later: str = "series-b") -> DataFrame:
    """(company_name) of companies with the first round and without the later one."""
    of = lambda r: deals.filter(F.col("funding_round_type") == r).select("company_name").distinct()
    return of(first).join(of(later), "company_name", "left_anti")


def link_scores(deals: DataFrame, companies: DataFrame, scores: DataFrame | None = None, floor: float = FLOOR) -> DataFrame:
    """(company, investor, cn, aa, tps_aa) for each investor that has a common neighbour with a company and isn't in it.

    The common neighbours of a company and an investor are the company's investors w that hold another company together with the
    investor; each counts once, by 1 / ln(degree), times its prescience score in tps_aa. Found by joining along company - w - other
    company - investor, so no pair without a common neighbour is made.
    """
    b = deals.select("company_name", "investor_name").distinct()
    deg = b.groupBy("investor_name").agg(F.count(F.lit(1)).alias("deg"))
    target = b.join(companies, "company_name", "left_semi")
    via = b.alias("x").join(b.alias("y"), F.col("x.company_name") == F.col("y.company_name")).filter("x.investor_name <> y.investor_name")
    mates = via.select(F.col("x.investor_name").alias("w"), F.col("y.investor_name").alias("investor")).distinct()
    met = target.select(F.col("company_name").alias("company"), F.col("investor_name").alias("w")).join(mates, "w")
    met = met.join(target.select(F.col("company_name").alias("company"), F.col("investor_name").alias("investor")), ["company", "investor"], "left_anti")
    met = met.join(deg.select(F.col("investor_name").alias("w"), "deg"), "w")
    if scores is None:
        met = met.withColumn("tps", F.lit(floor))
    else:
        met = met.join(scores.select(F.col("investor").alias("w"), "tps"), "w", "left")
    inverse = F.when(F.col("deg") > 1, 1.0 / F.log("deg"))
    s = met.groupBy("company", "investor").agg(
        F.count(F.lit(1)).alias("cn"), F.round(F.coalesce(F.sum(inverse), F.lit(0.0)), 4).alias("aa"),
        F.round(F.coalesce(F.sum(F.coalesce("tps", F.lit(floor)) * inverse), F.lit(0.0)), 4).alias("tps_aa"),
    )
    return s


def ranked(scores: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy("company").orderBy(F.desc(by), "investor")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def precision_at(scores: DataFrame, truth: DataFrame, by: str = "tps_aa", ks: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """(k, precision): of the k best pairs over all, the share that is in truth (company, investor)."""
    w = Window.orderBy(F.desc(by), "company", "investor")
    top = scores.orderBy(F.desc(by), "company", "investor").limit(max(ks)).withColumn("rank", F.row_number().over(w))
    hit = top.join(truth.select("company", "investor").distinct().withColumn("hit", F.lit(1)), ["company", "investor"], "left")
    each = hit.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank", "hit").filter("rank <= k")
    return each.groupBy("k").agg((F.count("hit") / F.first("k")).alias("precision"))


def missing_links(und: DataFrame, k: int = 3) -> DataFrame:
    """(a, b, aa): the k pairs without an edge of highest Adamic-Adar score over an undirected graph."""
    both = und.select("a", "b").union(und.select("b", "a")).toDF("w", "x")
    deg = both.groupBy("w").agg(F.count(F.lit(1)).alias("deg"))
    pairs = both.alias("p").join(both.alias("q"), F.col("p.w") == F.col("q.w")).filter("p.x < q.x").select(F.col("p.w").alias("w"), F.col("p.x").alias("a"), F.col("q.x").alias("b"))
    s = pairs.join(deg, "w").groupBy("a", "b").agg(F.sum(1.0 / F.log("deg")).alias("aa")).join(und.select("a", "b"), ["a", "b"], "left_anti")
    return s.select("a", "b", F.round("aa", 6).alias("aa")).orderBy(F.desc("aa"), "a", "b").limit(k)
