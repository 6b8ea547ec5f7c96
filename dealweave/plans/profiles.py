"""Queries over profiles, portfolios, track records, receipts and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealweave.functions import text
from dealweave.operators import deals as deal_ops
from dealweave.operators import graph, linkpred, prescience, profiles, signals, stats
from dealweave.operators.ranking import placed
from dealweave.plans import adapter as a
from dealweave.plans.adapter import BASE, DEALS, NODES, sql
from dealweave.plans.network import EARLY, LINKS, STATIC, TIER, tps_static
from dealweave.plans.signals import BASELINE
from dealweave.session import dropped, table, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PROTOCOL = "v1"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deals, graph, scores), written."""
    deals = written(a.deals(spark, d), "deals")
    edges = written(deal_ops.temporal_edges(deals).select("source", "target", "company", "weight"), "edges")
    g = written(deal_ops.assemble(edges), "graph")
    scores = written(prescience.static_scores(edges, deals, known=written(graph.degrees(g), "degrees")), "scores")
    dropped(edges)
    return deals, g, scores


HOME = "home as (select investor_name as node, min(country_code) as community_id from deals group by 1)"


def _home(deals: DataFrame) -> DataFrame:
    return deals.groupBy(F.col("investor_name").alias("node")).agg(F.min("country_code").alias("community_id"))


@query(sql(*BASE, NODES, TIER, STATIC, HOME, """c as (select community_id, count(*) as members from home group by 1),
p as (select node, degree, in_degree, out_degree, coalesce(tps, 0) as tps, community_id, members from deg left join (select investor, tps from scores) on investor = node left join home using (node) left join c using (community_id))""",
"select node, degree, in_degree, out_degree, round(tps, 6) as tps, community_id, members, rank() over (order by round(tps, 9) desc) as place, round((select count(*) from p q where round(q.tps, 9) < round(p.tps, 9)) * 100.0::double / (select count(*) from p), 6) as percentile from p"))
def biz_investor_profiles(spark: SparkSession, d: str) -> DataFrame:
    deals, g, scores = _base(spark, d)
    home = _home(deals)
    p = graph.degrees(g).select("node", "degree", "in_degree", "out_degree").join(scores.select(F.col("investor").alias("node"), "tps"), "node", "left").join(home, "node", "left")
    p = p.join(home.groupBy("community_id").agg(F.count(F.lit(1)).alias("members")), "community_id", "left").withColumns({"tps": F.coalesce("tps", F.lit(0.0)), "r": F.round(F.coalesce("tps", F.lit(0.0)), 9)})
    p = placed(p, [F.desc("r"), F.col("node")], row="row", total="n")
    same = Window.partitionBy("r")
    p = p.withColumns({"place": F.min("row").over(same), "same": F.count(F.lit(1)).over(same)})
    return p.select("node", "degree", "in_degree", "out_degree", F.round("tps", 6).alias("tps"), "community_id", "members", F.col("place").cast("long").alias("place"), F.round((F.col("n") - F.col("place") + 1 - F.col("same")) * 100.0 / F.col("n"), 6).alias("percentile"))


@query("""select investor_id, eval_date, panel_id, round(tps, 6) as tps, in_top_tier from tps_panel where investor_id = (select investor_id from tps_panel where investor_id is not null group by 1 order by count(*) desc, investor_id limit 1)""")
def biz_tps_series(spark: SparkSession, d: str) -> DataFrame:
    """The scores over time of the investor with the most of them."""
    p = table(spark, d, "tps_panel").filter("investor_id is not null")
    most = p.groupBy("investor_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "investor_id").limit(1).select("investor_id")
    return p.join(most, "investor_id", "left_semi").select("investor_id", "eval_date", "panel_id", F.round("tps", 6).alias("tps"), "in_top_tier").orderBy("eval_date", "panel_id")


@query("""select investor_id, company_id, event_id, round_type, amount_usd from (select *, row_number() over (partition by investor_id, company_id order by ingested_at desc, event_id desc) as r from funding_events
where investor_id is not null and company_id is not null) where r = 1""")
def biz_portfolios(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "funding_events").filter("investor_id is not null and company_id is not null")
    last = f.groupBy("investor_id", "company_id").agg(F.max(F.struct("ingested_at", "event_id", "round_type", "amount_usd")).alias("x"))
    return last.select("investor_id", "company_id", "x.event_id", "x.round_type", "x.amount_usd")


def _exits_sql(key: str, held: str) -> str:
    return f"""with h as (select distinct {key}, company_id from ({held})), c as (select distinct id, status from objects),
j as (select {key}, company_id, status from h left join c on id = company_id)
select {key}, count(distinct company_id) as n_companies, count(*) filter (where status = 'acquired') as n_acq, count(*) filter (where status = 'ipo') as n_ipo,
    round(count(*) filter (where status in ('acquired', 'ipo')) * 100.0::double / greatest(count(distinct company_id), 1), 6) as exit_rate from j group by 1"""


@query(_exits_sql("investor_id", "select investor_id, company_id from funding_events where investor_id is not null and company_id is not null"))
def biz_investor_exits(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "funding_events").filter("investor_id is not null and company_id is not null")
    return _r(profiles.exits(f, table(spark, d, "objects"), "investor_id"), "exit_rate")


@query(_exits_sql("sector", "select sector, company_id from funding_events where sector is not null and company_id is not null"))
def biz_sector_exits(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "funding_events").filter("sector is not null and company_id is not null")
    return _r(profiles.exits(f, table(spark, d, "objects"), "sector"), "exit_rate")


@query(sql(*BASE, NODES, TIER, STATIC, """n as (select category_code, investor_name, count(*) as n_deals from deals group by 1, 2),
r as (select *, row_number() over (partition by category_code order by n_deals desc, investor_name) as place from n)""",
"select category_code, investor_name, n_deals, place, round(coalesce(tps, 0), 6) as tps from r left join scores on investor = investor_name where place <= 10"))
def biz_sector_top_investors(spark: SparkSession, d: str) -> DataFrame:
    deals, _, scores = _base(spark, d)
    n = deals.groupBy("category_code", "investor_name").agg(F.count(F.lit(1)).alias("n_deals"))
    top = profiles.top_of(n, ["category_code"], "investor_name", "n_deals", 10).withColumnRenamed("_r", "place")
    return top.join(scores.select(F.col("investor").alias("investor_name"), "tps"), "investor_name", "left").select("category_code", "investor_name", "n_deals", "place", F.round(F.coalesce("tps", F.lit(0.0)), 6).alias("tps"))


@query("""select sector, date_trunc('quarter', score_date)::date as quarter, round(avg(sms_score), 6) as sms_score, count(*) as n_days, round(avg(deviation_sigma), 6) as deviation
from sms_scores_live group by 1, 2""")
def biz_quarterly_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sms_scores_live").groupBy("sector", F.trunc("score_date", "quarter").alias("quarter"))
    return _r(s.agg(F.avg("sms_score").alias("sms_score"), F.count(F.lit(1)).alias("n_days"), F.avg("deviation_sigma").alias("deviation")), "sms_score", "deviation")


@query("""select sector, eval_date, run_no, round(sms_score, 6) as sms_score from sms_scores where sector = 'IGV' and eval_date not between '2016-10-01' and '2017-12-31' order by eval_date, run_no""")
def biz_sector_history(spark: SparkSession, d: str) -> DataFrame:
    """One sector's scores in order, a crisis window left out."""
    s = table(spark, d, "sms_scores").filter("sector = 'IGV'").filter(~F.col("eval_date").between(F.lit("2016-10-01").cast("date"), F.lit("2017-12-31").cast("date")))
    return s.select("sector", "eval_date", "run_no", F.round("sms_score", 6).alias("sms_score")).orderBy("eval_date", "run_no")


@query(sql(*BASE, NODES, TIER, STATIC, HOME, """m as (select node, community_id, coalesce(out_weight, 0) as ow, coalesce(in_weight, 0) as iw, coalesce(tps, 0) as tps from home left join deg using (node) left join scores on investor = node),
s as (select community_id, count(*) as size, avg(ow) as mo, avg(iw) as mi, avg(tps) as mt from m group by 1 having count(*) >= 5),
ti as (select community_id, string_agg(node, ', ' order by r) as top_investors from (select *, row_number() over (partition by community_id order by round(ow, 9) desc, node) as r from m) where r <= 5 group by 1),
ms as (select investor_name as node, lower(category_code) as v, count(*) as n from deals where category_code is not null group by 1, 2),
mc as (select investor_name as node, country_code as v, count(*) as n from deals where country_code is not null group by 1, 2),
s3 as (select * from (select *, row_number() over (partition by node order by n desc, v) as r from ms) where r <= 3), c3 as (select * from (select *, row_number() over (partition by node order by n desc, v) as r from mc) where r <= 3),
ts as (select community_id, string_agg(v, ', ' order by r) as top_sectors from (select community_id, v, row_number() over (partition by community_id order by sum(n) desc, v) as r from s3 join home using (node) group by 1, 2) where r <= 3 group by 1),
tc as (select community_id, string_agg(v, ', ' order by r) as top_countries from (select community_id, v, row_number() over (partition by community_id order by sum(n) desc, v) as r from c3 join home using (node) group by 1, 2) where r <= 3 group by 1),
pa as (select community_id, avg(a) as pct from (select investor_name as node, avg((funding_round_type = 'series-a')::int) as a from deals group by 1) join home using (node) group by 1)""",
"select community_id, size, top_investors, round(mo, 3) as mean_out_degree, round(mi, 3) as mean_in_degree, round(mt, 4) as mean_tps, coalesce(top_sectors, '') as top_sectors, coalesce(top_countries, '') as top_countries, round(coalesce(pct, 0.5), 3) as pct_series_a from s join ti using (community_id) left join ts using (community_id) left join tc using (community_id) left join pa using (community_id)"))
def biz_community_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of the investors of each home country, as of any partition."""
    deals, g, scores = _base(spark, d)
    deg = graph.degrees(g).withColumn("out_weight", F.round("out_weight", 9))
    return profiles.community_profiles(_home(deals), deg, scores, deals)


@query()
def gra_community_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of the communities that local moving finds."""
    deals, g, scores = _base(spark, d)
    degrees, und = written(graph.degrees(g), "degrees"), written(deal_ops.undirected(g), "und")
    dropped(g)
    part = written(graph.louvain(und).withColumnRenamed("community", "community_id"), "partition")
    return profiles.community_profiles(part, degrees, scores, deals)


PORTFOLIO = "mine as (select distinct investor_id as investor from silence_events where is_silent and investor_id is not null)"
_PANEL = "pn as (select investor_id as investor, eval_date, max(tps) as tps from tps_panel where investor_id is not null and tps is not null group by 1, 2), sc as (select investor, arg_max(tps, eval_date) as tps from pn group by 1)"


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel, scores, names): the panel by investor and date, each investor's last score, and the investors that were ever silent."""
    p = table(spark, d, "tps_panel").filter("investor_id is not null and tps is not null").groupBy(F.col("investor_id").alias("investor"), "eval_date").agg(F.max("tps").alias("tps"))
    p = written(p, "panel")
    names = table(spark, d, "silence_events").filter("is_silent and investor_id is not null").select(F.col("investor_id").alias("investor")).distinct()
    return p, p.groupBy("investor").agg(F.max_by("tps", "eval_date").alias("tps")), names


@query(f"""with {PORTFOLIO}, {_PANEL}, u as (select avg(tps) as mean, median(tps) as median, quantile_cont(tps, 0.9) as p90 from sc), s as (select tps from sc semi join mine using (investor))
select count(*) as n_matched, round(avg(tps), 6) as portfolio_mean, round(median(tps), 6) as portfolio_median, round(max(tps), 6) as portfolio_max, round(min(tps), 6) as portfolio_min, round(stddev_samp(tps), 6) as portfolio_std,
    count(*) filter (where tps > mean) as n_above_universe, count(*) filter (where tps >= p90) as n_top_decile, count(*) filter (where tps < median) as n_below_median, round(avg(tps) - any_value(mean), 6) as alpha_vs_universe from s, u""")
def biz_portfolio_summary(spark: SparkSession, d: str) -> DataFrame:
    _, scores, names = _panel(spark, d)
    u = scores.agg(F.avg("tps").alias("mean"), F.median("tps").alias("median"), F.percentile("tps", F.lit(0.9)).alias("p90"))
    s = scores.join(names, "investor", "left_semi").join(F.broadcast(u))
    t = F.col("tps")
    out = s.agg(
        F.count(F.lit(1)).alias("n_matched"), F.avg(t).alias("portfolio_mean"), F.median(t).alias("portfolio_median"), F.max(t).alias("portfolio_max"), F.min(t).alias("portfolio_min"), F.stddev_samp(t).alias("portfolio_std"),
        F.count_if(t > F.col("mean")).alias("n_above_universe"), F.count_if(t >= F.col("p90")).alias("n_top_decile"), F.count_if(t < F.col("median")).alias("n_below_median"), (F.avg(t) - F.first("mean")).alias("alpha_vs_universe"),
    )
    return _r(out, "portfolio_mean", "portfolio_median", "portfolio_max", "portfolio_min", "portfolio_std", "alpha_vs_universe")


@query(f"""with {PORTFOLIO}, {_PANEL}, lst as (select *, row_number() over (partition by investor order by eval_date desc) as r from pn semi join mine using (investor)),
l4 as (select investor, count(*) as n, arg_max(tps, r) as was, arg_min(tps, r) as now from lst where r <= 4 group by 1)
select investor, 'LOW_TPS' as flag, 'MEDIUM' as severity from sc semi join mine using (investor) where tps < 0.5 * (select median(tps) from sc)
union all select investor, 'DECLINING_TPS', 'HIGH' from l4 where n = 4 and now < was * 0.7""")
def biz_risk_flags(spark: SparkSession, d: str) -> DataFrame:
    p, scores, names = _panel(spark, d)
    return profiles.risk_flags(scores, p, names)


@query(f"""with {PORTFOLIO} select sector, count(*) as deals, count(distinct company_id) as unique_companies, count(distinct investor_id) as unique_gps from funding_events
where investor_id in (select investor from mine) and sector is not null group by 1""")
def biz_sector_exposure(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "funding_events").filter("sector is not null").join(_panel(spark, d)[2].withColumnRenamed("investor", "investor_id"), "investor_id", "left_semi")
    return f.groupBy("sector").agg(F.count(F.lit(1)).alias("deals"), F.countDistinct("company_id").alias("unique_companies"), F.countDistinct("investor_id").alias("unique_gps"))


@query()
def txt_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Investors as silence_events has them typed, each with the known investor that it matches best."""
    known = table(spark, d, "objects").filter("id like 'f:%' or id like 'p:%'")
    return _r(profiles.best_match(table(spark, d, "silence_events"), known, name="investor_name", known="name"), "score")


@query("""with j as (select s_suppkey as k, lower(trim(s_name)) as a, lower(trim(c_name)) as b from supplier join customer on c_custkey = s_suppkey),
ga as (select k, substr(a, i::int, 1 + 1) as g, count(*) as n from j, range(1, 200) t(i) where i < length(a) group by 1, 2), gb as (select k, substr(b, i::int, 1 + 1) as g, count(*) as n from j, range(1, 200) t(i) where i < length(b) group by 1, 2),
c as (select ga.k, sum(least(ga.n, gb.n)) as common from ga join gb on ga.k = gb.k and ga.g = gb.g group by 1)
select k, round(case when a = b then 1.0 when length(a) < 2 or length(b) < 2 then 0.0 else 2.0 * coalesce(common, 0) / (length(a) + length(b) - 2) end::double, 6) as dice from j left join c using (k)""")
def txt_dice(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    j = s.join(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "k")
    return j.select("k", F.round(text.bigram_dice(F.col("s_name"), F.col("c_name")), 6).alias("dice"))


@query("""select id, name, entity_type from (select distinct id, name, entity_type from objects where contains(lower(name), 'tundra') or contains('tundra', lower(substring(name, 1, 6)))) order by name, id limit 5""")
def biz_entity_search(spark: SparkSession, d: str) -> DataFrame:
    """The five first entities whose names hold what is asked, or whose first letters it holds."""
    asked, name = F.lit("tundra"), F.lower("name")
    o = table(spark, d, "objects").filter(F.contains(name, asked) | F.contains(asked, F.lower(F.substring("name", 1, 6))))
    return o.select("id", "name", "entity_type").distinct().orderBy("name", "id").limit(5)


@query("""select category_code, count(*) as n, any_value(etf_primary) as etf, any_value(sector_name) as sector_name from (select distinct id, lower(trim(category_code)) as category_code from objects where id like 'c:%')
left join sector_bridge on crunchbase_category = category_code group by 1""")
def txt_sector_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Companies by category with the sector that the bridge gives it."""
    o = table(spark, d, "objects").filter("id like 'c:%'").select("id", F.lower(F.trim("category_code")).alias("category_code")).distinct()
    o = o.groupBy("category_code").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "sector_bridge").select(F.col("crunchbase_category").alias("category_code"), F.col("etf_primary").alias("etf"), "sector_name")
    return o.join(b, "category_code", "left").select("category_code", "n", "etf", "sector_name")


_ALPHA = """q as (select sector, eval_date, round(avg(sms_score), 6) as value, sum(n_expected)::bigint as n_top_tier, arg_min(coalesce(top_silenced_investors, ''), score_id) as names, round(avg(sms_score_norm), 6) as mean_tps from sms_scores group by 1, 2),
al as (select *, lead(value, 2) over w - value as alpha_k6, lead(value, 4) over w - value as alpha_k12, lead(value, 8) over w - value as alpha_k24 from q window w as (partition by sector order by eval_date)),
hi as (select *, case when coalesce(alpha_k12 > 0, false) then 'POSITIVE_ALPHA' else 'NEGATIVE_ALPHA' end as direction from al where value >= 0.25 and n_top_tier >= 3)"""
_OUT = """ou as (select sector, eval_date, h as horizon_days, round(x, 6) as excess, case when direction = 'NEGATIVE_ALPHA' then x < 0 else x > 0 end as direction_correct
    from (select sector, eval_date, direction, unnest([30, 90, 180]) as h, unnest([alpha_k6, alpha_k12, alpha_k24]) as x from hi) where x is not null)"""


def _seeded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "sms_scores").groupBy("sector", "eval_date").agg(
        F.round(F.avg("sms_score"), 6).alias("value"), F.sum("n_expected").alias("n_top_tier"), F.min_by(F.coalesce("top_silenced_investors", F.lit("")), "score_id").alias("names"), F.round(F.avg("sms_score_norm"), 6).alias("mean_tps")
    )
    w = Window.partitionBy("sector").orderBy("eval_date")
    s = s.withColumns({f"alpha_k{k}": F.lead("value", n).over(w) - F.col("value") for k, n in ((6, 2), (12, 4), (24, 8))})
    return profiles.seed_signals(s, PROTOCOL, threshold=0.25, least_tier=3, horizons={30: "alpha_k6", 90: "alpha_k12", 180: "alpha_k24"})


@query(f"with {_ALPHA}, {_OUT} select * from ou")
def mkt_seeded_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(spark, d)[1]


@query(f"""with {_ALPHA} select sector, eval_date, direction, value, round((value - mean_tps) / 0.1, 2) as deviation_sigma, eval_date || 'T00:00:00+00:00' as issued_at from hi""")
def mkt_seeded_signals(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(spark, d)[0].drop("input_sha256", "output_sha256", "receipt_sha256")


@query()
def hsh_signal_receipts(spark: SparkSession, d: str) -> DataFrame:
    """The receipts of all seeded signals, and whether each is what its parts give."""
    s = _seeded(spark, d)[0]
    again = F.sha2(F.concat(F.lit(PROTOCOL), "input_sha256", "output_sha256", "issued_at"), 256)
    return s.select("sector", "eval_date", "receipt_sha256", (again == F.col("receipt_sha256")).alias("verified"))


@query(f"""with {_ALPHA}, {_OUT} select horizon_days, count(*) as n, case when count(*) >= 3 then round(avg(direction_correct::int), 6) end as hit_rate, case when count(*) >= 3 then round(avg(excess), 6) end as mean_excess from ou group by 1""")
def mkt_track_record(spark: SparkSession, d: str) -> DataFrame:
    return _r(profiles.track_record(_seeded(spark, d)[1]), "hit_rate", "mean_excess")


_MERGED = """ep as (select sector, last_day((date_trunc('quarter', score_date) + interval 2 month)::date) as quarter, avg(sms_score) as live, count(*) as n from sms_scores_live group by 1, 2),
sm as (select sector, last_day((date_trunc('quarter', eval_date) + interval 2 month)::date) as quarter, avg(sms_score) as sms_score, sum(n_silent)::bigint as n_silent from sms_scores group by 1, 2),
mg as (select sector, quarter, live, n, sms_score, n_silent from ep left join sm using (sector, quarter))"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    ep = table(spark, d, "sms_scores_live").groupBy("sector", signals.quarter_end(F.col("score_date")).alias("quarter")).agg(F.avg("sms_score").alias("live"), F.count(F.lit(1)).alias("n"))
    sm = table(spark, d, "sms_scores").groupBy("sector", signals.quarter_end(F.col("eval_date")).alias("quarter")).agg(F.avg("sms_score").alias("sms_score"), F.sum("n_silent").alias("n_silent"))
    return ep.join(sm, ["sector", "quarter"], "left")


@query(f"with {_MERGED} select sector, quarter, round(live, 6) as live, n, round(sms_score, 6) as sms_score, n_silent from mg")
def sms_panel_merge(spark: SparkSession, d: str) -> DataFrame:
    return _r(_merged(spark, d), "live", "sms_score").select("sector", "quarter", "live", "n", "sms_score", "n_silent")


@query(f"""with {_MERGED}, f as (select *, lead(live, 1) over w - live as alpha_k3, lead(live, 2) over w - live as alpha_k6, lead(live, 4) over w - live as alpha_k12 from mg window w as (partition by sector order by quarter)),
u as (select sms_score, unnest(['alpha_k3', 'alpha_k6', 'alpha_k12']) as alpha_col, unnest([alpha_k3, alpha_k6, alpha_k12]) as alpha from f where sms_score is not null)
select alpha_col, round(corr(sms_score, alpha), 4) as pearson_r, count(*) as n_obs from u where alpha is not null group by 1 having count(*) >= 5""")
def sms_horizon_correlation(spark: SparkSession, d: str) -> DataFrame:
    """The correlation of the score with what follows over each horizon."""
    w = Window.partitionBy("sector").orderBy("quarter")
    f = _merged(spark, d).withColumns({f"alpha_k{3 * k}": F.lead("live", k).over(w) - F.col("live") for k in (1, 2, 4)})
    u = f.unpivot(["sms_score"], ["alpha_k3", "alpha_k6", "alpha_k12"], "alpha_col", "alpha")
    return stats.correlation(u, "alpha_col", "sms_score", "alpha").select("alpha_col", F.round("r", 4).alias("pearson_r"), F.col("n").alias("n_obs"))


@query(f"""with {BASELINE}, n as (select sector, count(*) as n_live from funding_events where sector is not null group by 1), t as (select greatest(count(*), 1) as total from funding_events where sector is not null),
b as (select bl.sector, mean, sigma, coalesce(n_live, 0) as n_live, total, greatest(0.0::double, round(mean - coalesce(n_live, 0) / total + 0.05::double, 4)) as sms_score, greatest(1, floor(total * mean))::bigint as n_expected from bl left join n using (sector), t)
select sector, sms_score, n_expected, greatest(0, n_expected - n_live)::bigint as n_silent, round(mean, 4) as baseline_mean, round(sigma, 4) as baseline_sigma, round((sms_score - mean) / sigma, 2) as deviation_sigma from b""")
def sms_volume_scores(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "funding_events").filter("sector is not null")
    return profiles.volume_scores(f, signals.baseline(table(spark, d, "sms_scores")))


@query(f"""with {BASELINE}, ev as (select sector, investor_id as investor, company_id as company, series_a_date, coalesce(series_b_occurred, false) as came, is_silent from (select distinct * from silence_events) where investor_id in (select investor_id from tps_panel where in_top_tier) and sector is not null),
w as (select sector, count(*) as n_expected, sum(is_silent::int)::bigint as n_silent from ev where series_a_date >= timestamptz '2019-01-01 00:00:00+00' - interval 900 day group by 1 having count(*) >= 3)
select sector, round(n_silent / n_expected, 4) as sms_score, n_expected, n_silent, round(coalesce(mean, 0.25), 4) as baseline_mean, round(coalesce(sigma, 0.1), 4) as baseline_sigma,
    round((n_silent / n_expected - coalesce(mean, 0.25)) / greatest(coalesce(sigma, 0.1), 1e-6), 4) as deviation_sigma from w left join bl using (sector)""")
def sms_seat_scores(spark: SparkSession, d: str) -> DataFrame:
    """Live scores over the silence events of investors that were ever top-tier, against the baseline of their sector."""
    tier = table(spark, d, "tps_panel").filter("in_top_tier").select("investor_id").distinct()
    seats = table(spark, d, "silence_events").distinct().filter("sector is not null").join(tier, "investor_id", "left_semi")
    return signals.live_scores(seats, signals.baseline(table(spark, d, "sms_scores")), "2019-01-01", window_days=900)


@query("""select score_id, sha256('{"eval_date": "' || eval_date || '", "n_silent": ' || n_silent || ', "sector": "' || sector || '"}') as sealed from sms_scores""")
def hsh_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Scores sealed by the hash of their canonical JSON."""
    s = table(spark, d, "sms_scores")
    j = profiles.canonical_json({"sector": profiles.json_text(F.col("sector")), "n_silent": F.col("n_silent").cast("string"), "eval_date": profiles.json_text(F.col("eval_date").cast("string"))})
    return s.select("score_id", F.sha2(j, 256).alias("sealed"))


@query("""select 'funding_events' as name, count(*) as n, max(ingested_at)::timestamptz::varchar is not null as dated, median(amount_usd)::double as median from funding_events
union all select 'silence_events', count(*), max(detected_at)::varchar is not null, null from silence_events union all select 'objects', count(*), false, median(funding_total_usd) from objects
union all select 'sms_scores', count(*), max(eval_date)::varchar is not null, median(sms_score) from sms_scores""")
def biz_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Counts, whether dated, and a median of the main tables, a row each."""
    out = None
    for name, day, value in (("funding_events", "ingested_at", "amount_usd"), ("silence_events", "detected_at", None), ("objects", None, "funding_total_usd"), ("sms_scores", "eval_date", "sms_score")):
        one = table(spark, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), (F.max(day).isNotNull() if day else F.lit(False)).alias("dated"), (F.median(value) if value else F.lit(None).cast("double")).alias("median"))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql(*BASE, NODES, """r1 as (select node, row_number() over (order by out_degree desc, node) as r from deg), r2 as (select node, row_number() over (order by in_degree desc, node) as r from deg), r3 as (select node, row_number() over (order by degree desc, node) as r from deg),
u as (select node from r1 where r <= 20 union select node from r2 where r <= 20 union select node from r3 where r <= 20)""",
"select node, out_degree, in_degree, degree, coalesce(a.r, 9999) as rank_out_degree, coalesce(b.r, 9999) as rank_in_degree, coalesce(c.r, 9999) as rank_degree from u join deg using (node) left join (from r1 where r <= 20) a using (node) left join (from r2 where r <= 20) b using (node) left join (from r3 where r <= 20) c using (node)"))
def gra_union_of_tops(spark: SparkSession, d: str) -> DataFrame:
    deg = written(graph.degrees(written(a.graph(spark, d), "graph")), "degrees")
    return profiles.union_of_tops(deg, "node", ["out_degree", "in_degree", "degree"], 20)


@query("""select sector, market, score_date, round(sms_score, 6) as sms_score from (select *, row_number() over (partition by sector, market order by score_date) - 1 as n from sms_scores_live) where n % 2 = 0""")
def sms_thinned(spark: SparkSession, d: str) -> DataFrame:
    return profiles.thinned(table(spark, d, "sms_scores_live"), ["sector", "market"], ["score_date"]).select("sector", "market", "score_date", F.round("sms_score", 6).alias("sms_score"))


@query("""with s as (select sector, avg(sms_score) as score, sum(n_silent)::double as silent, sum(n_expected)::double as expected from sms_scores group by 1)
select sector, round(score / max(score) over () * 100, 6) as score, round(silent / max(silent) over () * 100, 6) as silent, round(expected / max(expected) over () * 100, 6) as expected from s""")
def biz_radar(spark: SparkSession, d: str) -> DataFrame:
    """Each sector's measures in percent of the greatest."""
    s = table(spark, d, "sms_scores").groupBy("sector").agg(F.avg("sms_score").alias("score"), F.sum("n_silent").cast("double").alias("silent"), F.sum("n_expected").cast("double").alias("expected"))
    most = s.agg(*[F.max(c).alias(f"m_{c}") for c in ("score", "silent", "expected")])
    return s.join(F.broadcast(most)).select("sector", *[F.round(F.col(c) / F.col(f"m_{c}") * 100, 6).alias(c) for c in ("score", "silent", "expected")])


@query(sql(DEALS, """pk as (select p_type as sector, max(o_orderdate::date) as peak from part join lineitem on l_partkey = p_partkey join orders on l_orderkey = o_orderkey group by 1),
fe as (select investor_name, category_code as sector, min(funded_at) as first_entry from deals group by 1, 2)""", "select investor_name, round(avg(peak - first_entry), 6) as mean_lead_days, count(*) as n_sectors from fe join pk using (sector) group by 1"))
def drv_prescience_index(spark: SparkSession, d: str) -> DataFrame:
    """Mean days from an investor's first entry into a sector to the sector's last order."""
    order = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    peak = line.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("sector")).agg(F.max("day").alias("peak"))
    fe = deal_ops.first_entries(a.deals(spark, d))
    return _r(fe.join(peak, "sector").groupBy("investor_name").agg(F.avg(F.datediff("peak", "first_entry_date")).alias("mean_lead_days"), F.count(F.lit(1)).alias("n_sectors")), "mean_lead_days")


@query("""select * from (select feed_id, kind, sector, eval_date, severity from (
    select substring(sha256('SMS|' || score_id), 1, 12) as feed_id, 'SMS' as kind, sector, eval_date, case when sms_score >= 0.5 then 'HIGH' when sms_score >= 0.3 then 'MEDIUM' else 'LOW' end as severity from sms_scores
    union all select substring(sha256('TPS|' || panel_id), 1, 12), 'TPS', investor_id, eval_date, case when tps >= 1.0 then 'HIGH' when tps >= 0.5 then 'MEDIUM' else 'LOW' end from tps_panel where tps is not null)
    order by eval_date desc, feed_id limit 200)""")
def biz_newest_feed(spark: SparkSession, d: str) -> DataFrame:
    """The two hundred newest entries of both signals."""
    one = lambda t, kind, i, who, v, hi, lo: t.select(F.substring(F.sha2(F.concat_ws("|", F.lit(kind), i), 256), 1, 12).alias("feed_id"), F.lit(kind).alias("kind"), F.col(who).alias("sector"), "eval_date", text.severity(F.col(v), hi, lo).alias("severity"))
    both = one(table(spark, d, "sms_scores"), "SMS", "score_id", "sector", "sms_score", 0.5, 0.3).unionByName(one(table(spark, d, "tps_panel").filter("tps is not null"), "TPS", "panel_id", "investor_id", "tps", 1.0, 0.5))
    return both.orderBy(F.desc("eval_date"), "feed_id").limit(200)


@query(f"with {_PANEL} select round(quantile_cont(tps, 0.75), 6) as p75, round(quantile_cont(tps, 0.9), 6) as p90, round(quantile_cont(tps, 0.95), 6) as p95, count(*) as n, round(avg(tps), 6) as mean from sc")
def biz_score_percentiles(spark: SparkSession, d: str) -> DataFrame:
    s = _panel(spark, d)[1]
    out = s.agg(*[F.percentile("tps", F.lit(q / 100)).alias(f"p{q}") for q in (75, 90, 95)], F.count(F.lit(1)).alias("n"), F.avg("tps").alias("mean"))
    return _r(out, "p75", "p90", "p95", "mean")


@query(f"with {_PANEL}, t as (select investor from sc order by tps desc, investor limit 5) select investor, eval_date, round(tps, 6) as tps from pn semi join t using (investor)")
def biz_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """The scores over time of the five investors of the highest last score."""
    p, scores, _ = _panel(spark, d)
    top = scores.orderBy(F.desc("tps"), "investor").limit(5).select("investor")
    return _r(p.join(top, "investor", "left_semi"), "tps").select("investor", "eval_date", "tps")


@query(f"""with {_PANEL} select 'tps' as part, investor as name, null::date as day, round(tps, 6) as value from (select * from sc order by tps desc, investor limit 10)
union all select 'sms', sector, eval_date, round(sms_score, 6) from (select * from sms_scores order by eval_date desc, score_id desc limit 6)""")
def biz_memo(spark: SparkSession, d: str) -> DataFrame:
    """The ten best scores and the six last silence scores."""
    best = _panel(spark, d)[1].orderBy(F.desc("tps"), "investor").limit(10).select(F.lit("tps").alias("part"), F.col("investor").alias("name"), F.lit(None).cast("date").alias("day"), F.round("tps", 6).alias("value"))
    last = table(spark, d, "sms_scores").orderBy(F.desc("eval_date"), F.desc("score_id")).limit(6).select(F.lit("sms").alias("part"), F.col("sector").alias("name"), F.col("eval_date").alias("day"), F.round("sms_score", 6).alias("value"))
    return best.unionByName(last)


@query("""select event_id, try_cast(nullif(regexp_replace(source_url, '[^0-9]', '', 'g'), '') as bigint) as digits, upper(left(coalesce(investor_name, ''), 12)) as short, strftime(ingested_at at time zone 'UTC', '%Y-%m') as month from funding_events""")
def txt_digits_and_months(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "funding_events")
    return f.select("event_id", F.regexp_replace("source_url", "[^0-9]", "").try_cast("bigint").alias("digits"), F.upper(F.substring(F.coalesce("investor_name", F.lit("")), 1, 12)).alias("short"), F.date_format("ingested_at", "yyyy-MM").alias("month"))


@query(sql(DEALS, EARLY, LINKS, """pf as (select investor_name as w, 1.0::double / count(distinct company_name) as tps from early where investor_name < 'I5' group by 1),
s as (select company, investor, count(*) as cn, round(coalesce(sum(case when deg > 1 then 1 / ln(deg) end), 0), 4) as aa, round(coalesce(sum(case when deg > 1 then coalesce(tps, 0.01) / ln(deg) end), 0), 4) as tps_aa from fresh join dg using (w) left join pf using (w) group by 1, 2)""",
"select company, investor, cn, aa, tps_aa from s"))
def lnk_scores_with_tps(spark: SparkSession, d: str) -> DataFrame:
    """Link scores whose neighbours carry a score of their own, those without one the floor."""
    early = written(a.deals(spark, d).filter(f"funded_at <= date'{a.CUTOFF}'"), "early")
    tps = early.filter("investor_name < 'I5'").groupBy(F.col("investor_name").alias("investor")).agg((1.0 / F.countDistinct("company_name")).alias("tps"))
    return linkpred.link_scores(early, linkpred.only_first_round(early), tps)


@query(sql(DEALS, EARLY, LINKS, """pf as (select investor_name as w, 1.0::double / count(distinct company_name) as tps from early where investor_name < 'I5' group by 1),
s as (select company, investor, count(*) as cn, round(coalesce(sum(case when deg > 1 then 1 / ln(deg) end), 0), 4) as aa, round(coalesce(sum(case when deg > 1 then coalesce(tps, 0.01) / ln(deg) end), 0), 4) as tps_aa from fresh join dg using (w) left join pf using (w) group by 1, 2)""",
"select method, round(avg(cn), 6) as mean_cn, round(avg(aa), 6) as mean_aa, round(avg(tps_aa), 6) as mean_tps_aa from (from (select 'cn' as method, * from s order by cn desc, company, investor limit 15) union all from (select 'aa', * from s order by aa desc, company, investor limit 15) union all from (select 'tps_aa', * from s order by tps_aa desc, company, investor limit 15)) group by 1"))
def lnk_methods(spark: SparkSession, d: str) -> DataFrame:
    """The means of the fifteen best pairs by each of the three scores."""
    s = written(lnk_scores_with_tps(spark, d), "links")
    out = None
    for m in ("cn", "aa", "tps_aa"):
        one = s.orderBy(F.desc(m), "company", "investor").limit(15).agg(F.lit(m).alias("method"), *[F.avg(c).alias(f"mean_{c}") for c in ("cn", "aa", "tps_aa")])
        out = one if out is None else out.unionByName(one)
    return _r(out, "mean_cn", "mean_aa", "mean_tps_aa")


@query(sql(*BASE, NODES, TIER, STATIC, "select 'top_tps' as kind, investor as node from (select * from scores order by round(tps, 9) desc, investor limit 5) union all select 'top_degree', node from (select * from deg order by degree desc, node limit 5)"))
def sim_seed_choices(spark: SparkSession, d: str) -> DataFrame:
    _, g, scores = _base(spark, d)
    tps = scores.orderBy(F.desc(F.round("tps", 9)), "investor").limit(5).select(F.lit("top_tps").alias("kind"), F.col("investor").alias("node"))
    return tps.unionByName(graph.top_nodes(g, 5).select(F.lit("top_degree").alias("kind"), "node"))
