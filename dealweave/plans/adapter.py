"""The engine's canonical tables, derived from the star schema, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.operators import deals as ops
from dealweave.session import table

CUTOFF = "1998-12-31"
ETF_OF_TYPE = {"STANDARD": "IGV", "ECONOMY": "XLF", "PROMO": "FDN", "LARGE": "SOXX", "MEDIUM": "XBI", "SMALL": "ICLN"}
MEASURES = ("mkt", "smb", "hml", "rmw", "cma")


def deals(spark: SparkSession, d: str) -> DataFrame:
    """Investor = customer, company = part, lines 1 and 2 of an order = its Series A and B."""
    line = table(spark, d, "lineitem").filter(F.col("l_linenumber").isin(1, 2)).select("l_orderkey", "l_partkey", "l_linenumber")
    order = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, d, "part").select("p_partkey", "p_type")
    cust = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    # The last join leaves the rows by part, so repeated ones meet there without a shuffle of their own.
    j = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    one = j.select("l_partkey", "o_custkey", "l_linenumber", F.col("o_orderdate").cast("date").alias("funded_at"), "p_type", "n_name").distinct()
    return one.select(
        F.concat(F.lit("I"), "o_custkey").alias("investor_name"), F.concat(F.lit("C"), "l_partkey").alias("company_name"), F.when(F.col("l_linenumber") == 1, "series-a").otherwise("series-b").alias("funding_round_type"),
        "funded_at", F.col("p_type").alias("category_code"), F.col("n_name").alias("country_code"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    return ops.temporal_edges(deals(spark, d))


def graph(spark: SparkSession, d: str) -> DataFrame:
    return ops.assemble(edges(spark, d))


def quarters(spark: SparkSession) -> DataFrame:
    return spark.sql("select explode(sequence(date'1995-03-31', date'2001-09-30', interval 3 months)) as q").select(F.last_day("q").alias("eval_date"))


def returns(spark: SparkSession, d: str) -> DataFrame:
    """(series, date, ret): the monthly change of each priority's total price, at month ends."""
    from pyspark.sql import Window

    m = table(spark, d, "orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("date"), F.col("o_orderpriority").alias("series")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("series").orderBy("date")
    return m.select("series", "date", (F.col("v") / F.lag("v").over(w) - 1).alias("ret"))


def factors(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("date"))
    share = lambda s: F.avg((F.col("o_orderstatus") == s).cast("double"))
    return o.agg((F.count(F.lit(1)) / 1000).alias("mkt"), (F.avg("o_totalprice") / 1e6).alias("smb"), share("F").alias("hml"), share("O").alias("rmw"), (F.stddev_pop("o_totalprice") / 1e6).alias("cma"), F.lit(0.001).alias("rf"))


def live_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type in ('signup', 'purchase')")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("announced_at"), F.concat(F.lit("I"), "user_id").alias("investor_name"), F.concat(F.lit("C"), F.get_json_object("props", "$.k")).alias("company_name"),
        F.when(F.col("event_type") == "signup", "series-a").otherwise("series-b").alias("round_type"), F.concat(F.lit("S"), F.pmod("user_id", F.lit(6))).alias("sector"),
    )


def prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("ticker"), F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("close"))


DEALS = """deals as (
    select distinct 'I' || o_custkey as investor_name, 'C' || l_partkey as company_name, case l_linenumber when 1 then 'series-a' else 'series-b' end as funding_round_type,
        o_orderdate::date as funded_at, p_type as category_code, n_name as country_code
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where l_linenumber in (1, 2))"""
EDGES = """rnd as (select company_name, funding_round_type, min(funded_at) as round_date from deals group by 1, 2),
seat as (select distinct company_name, funding_round_type, investor_name, round_date from deals join rnd using (company_name, funding_round_type)),
edges as (
    select a.investor_name as source, b.investor_name as target, a.company_name as company, exp(-0.3 * ((b.round_date - a.round_date) / 365.25::double)) as weight,
        (b.round_date - a.round_date) / 365.25::double as gap, a.funding_round_type as source_round, b.funding_round_type as target_round, a.round_date as source_date, b.round_date as target_date
    from seat a join seat b on a.company_name = b.company_name and (a.round_date, a.funding_round_type) < (b.round_date, b.funding_round_type) and a.investor_name <> b.investor_name)"""
GRAPH = "graph as (select source as src, target as dst, round(sum(weight), 4) as weight, count(*) as num_companies from edges group by 1, 2)"
NODES = """deg as (select node, sum(o) as out_degree, sum(i) as in_degree, sum(ow) as out_weight, sum(iw) as in_weight, sum(o) + sum(i) as degree
    from (select src as node, 1 as o, 0 as i, weight as ow, 0 as iw from graph union all select dst, 0, 1, 0, weight from graph) group by 1)"""
UND = "und as (select least(src, dst) as a, greatest(src, dst) as b, sum(weight) as weight from graph where src <> dst group by 1, 2)"
QUARTERS = "quarters as (select last_day(q::date) as eval_date from range(timestamp '1995-03-01', timestamp '2001-10-01', interval 3 month) r(q))"


def sql(*parts: str) -> str:
    """A query over the named tables above: the last part selects, maybe from further tables that it names first."""
    more = "" if parts[-1].startswith("select") else ","
    return "with " + ",\n".join(parts[:-1]) + f"{more}\n" + parts[-1]


BASE = (DEALS, EDGES, GRAPH)
