"""Deals -> rounds -> temporal edges -> graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DECAY = 0.3
EARLIER_LATER = ("series-a", "series-b")


def clean_deals(deals: DataFrame, round_types: tuple[str, ...] = EARLIER_LATER, sectors: tuple[str, ...] | None = None) -> DataFrame:
    """Deals of the given round types with a date, a company and an investor, names trimmed; NULL or other sectors drop where sectors is given."""
    d = deals.withColumns({c: F.trim(c) for c in ("investor_name", "company_name")}).withColumn("funding_round_type", F.lower(F.trim("funding_round_type")))
    d = d.filter(F.col("funding_round_type").isin(*round_types)).na.drop(subset=["investor_name", "company_name", "funded_at"])
    return d if sectors is None else d.filter(F.lower(F.trim("category_code")).isin(*sectors))


def round_table(deals: DataFrame) -> DataFrame:
    """(company_name, funding_round_type, round_date, investors): one row a round, its first date and sorted distinct investors."""
    return deals.groupBy("company_name", "funding_round_type").agg(F.min("funded_at").alias("round_date"), F.sort_array(F.collect_set("investor_name")).alias("investors"))


def temporal_edges(deals: DataFrame, decay: float = DECAY) -> DataFrame:
    """One row for each investor of an earlier round and another investor of a later round of one company, with a weight that decays by the gap.

    Rounds of one day go in the order of their type. Deals are shuffled once, by company; joined on (round, investor) rows there, so no round is held whole.
    """
    there = deals.filter(F.col("company_name").isNotNull() & F.col("funding_round_type").isNotNull())
    seats = there.select("company_name", "funding_round_type", "investor_name", "funded_at").repartition("company_name").groupBy("company_name", "funding_round_type", "investor_name").agg(F.min("funded_at").alias("first"))
    s = seats.withColumn("round_date", F.min("first").over(Window.partitionBy("company_name", "funding_round_type"))).drop("first")
    a, b = s.alias("a"), s.alias("b")
    order = lambda x: F.struct(F.col(f"{x}.round_date"), F.col(f"{x}.funding_round_type"))
    met = a.join(b, (F.col("a.company_name") == F.col("b.company_name")) & (order("a") < order("b")) & (F.col("a.investor_name") != F.col("b.investor_name")))
    years = F.datediff("b.round_date", "a.round_date") / F.lit(365.25).cast("double")
    return met.select(
        F.col("a.investor_name").alias("source"), F.col("b.investor_name").alias("target"), F.col("a.company_name").alias("company"), F.exp(-decay * years).alias("weight"),
        F.round(years, 3).alias("round_gap_years"), F.col("a.funding_round_type").alias("source_round"), F.col("b.funding_round_type").alias("target_round"),
        F.col("a.round_date").alias("source_date"), F.col("b.round_date").alias("target_date"),
    )


def seats(deals: DataFrame) -> DataFrame:
    """(company, side, node) of deals of the two round types: temporal_edges without direction, weight and time join the investors of one side with those of the other."""
    d = deals.filter(F.col("funding_round_type").isin(*EARLIER_LATER))
    return d.select(F.col("company_name").alias("company"), (F.col("funding_round_type") == EARLIER_LATER[1]).cast("int").alias("side"), F.col("investor_name").alias("node")).distinct()


def validate_edges(edges: DataFrame) -> DataFrame:
    """Edges with both ends, a date and a positive weight, without loops; missing columns raise."""
    missing = {"source", "target", "company", "weight", "source_date"} - set(edges.columns)
    if missing:
        raise ValueError(f"edges lack {sorted(missing)}")
    return edges.withColumn("source_date", F.col("source_date").try_cast("date")).na.drop(subset=["source", "target", "source_date"]).filter("source <> target and weight > 0")


def assemble(edges: DataFrame, digits: int = 4) -> DataFrame:
    """(src, dst, weight, num_companies): parallel edges summed; num_companies counts edges."""
    return edges.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.round(F.sum("weight"), digits).alias("weight"), F.count(F.lit(1)).alias("num_companies"))


def undirected(graph: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: both directions summed."""
    return graph.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def first_entries(deals: DataFrame, sector: str = "category_code") -> DataFrame:
    """(investor_name, sector, first_entry_date)."""
    return deals.filter(F.col(sector).isNotNull()).groupBy("investor_name", F.col(sector).alias("sector")).agg(F.min("funded_at").alias("first_entry_date"))
