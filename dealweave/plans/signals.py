"""Queries over signals, statistics, profiles and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealweave.functions import text
from dealweave.operators import deals as deal_ops
from dealweave.operators import prescience, signals, stats
from dealweave.operators.ranking import placed
from dealweave.plans import adapter as a
from dealweave.plans.adapter import DEALS, EDGES, QUARTERS, sql
from dealweave.plans.network import EXPANDING
from dealweave.session import collected, dropped, table, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = "2024-01-25"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _panel(deals: DataFrame, spark: SparkSession) -> DataFrame:
    edges = written(deal_ops.temporal_edges(deals).select("source", "target", "company", "weight", "source_date"), "edges", "zstd")
    panel = written(prescience.expanding_scores(edges, a.quarters(spark)), "panel", "zstd")
    dropped(edges)
    collected(spark)  # the scores' own plan is gone by now
    return panel


ENTRIES = "entries as (select investor_name, category_code as sector, min(funded_at) as first_entry_date from deals group by 1, 2)"


@query(sql(DEALS, ENTRIES, "select * from entries"))
def ssi_first_entries(spark: SparkSession, d: str) -> DataFrame:
    return deal_ops.first_entries(a.deals(spark, d))


SWARM = """near as (select q.eval_date, sector, e.investor_name, first_entry_date, coalesce(tps, 0) as pit, coalesce(in_top_tier, false) as tier,
        row_number() over (partition by q.eval_date, sector order by first_entry_date, e.investor_name) as rank
    from entries e join (select distinct eval_date from panel) q on first_entry_date <= q.eval_date and first_entry_date > (q.eval_date - interval 6 month)::date
    left join panel p on p.eval_date = q.eval_date and p.investor = e.investor_name),
swarm as (select eval_date, sector, round(sum(pit / rank), 6) as ssi, count(*)::double as ssi_dumb, count(*) as n_entrants, round(avg(pit), 6) as mean_tps_pit, round(max(pit), 6) as max_tps_pit,
        count(*) filter (where tier) as n_top_tier, (max(first_entry_date) - min(first_entry_date))::double as ipd_spread_days, string_agg(investor_name, '|' order by first_entry_date, investor_name) as swarm_investors
    from near group by 1, 2 having count(*) >= 5)"""


@query(sql(DEALS, EDGES, QUARTERS, EXPANDING, ENTRIES, SWARM, "select * from swarm"))
def ssi_swarm(spark: SparkSession, d: str) -> DataFrame:
    deals = written(a.deals(spark, d), "deals", "zstd")
    return _r(signals.swarm(_panel(deals, spark), deal_ops.first_entries(deals)), "ssi")


@query(sql(DEALS, EDGES, QUARTERS, EXPANDING, ENTRIES, SWARM.replace("row_number() over (partition by q.eval_date, sector order by first_entry_date, e.investor_name)", "rank() over (partition by q.eval_date, sector order by first_entry_date) + (count(*) over (partition by q.eval_date, sector, first_entry_date) - 1) / 2.0::double"), "select * from swarm"))
def ssi_swarm_average_ties(spark: SparkSession, d: str) -> DataFrame:
    deals = written(a.deals(spark, d), "deals", "zstd")
    return _r(signals.swarm(_panel(deals, spark), deal_ops.first_entries(deals), tie="average"), "ssi")


@query()
def ssi_event_panel(spark: SparkSession, d: str) -> DataFrame:
    alphas = stats.rolling_alpha(a.returns(spark, d), a.factors(spark, d), a.MEASURES)
    of = {"1-URGENT": "STANDARD", "2-HIGH": "ECONOMY", "3-MEDIUM": "PROMO", "4-NOT SPECIFIED": "LARGE", "5-LOW": "MEDIUM"}
    named = alphas.withColumn("sector", F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("series")])
    return signals.event_panel(written(ssi_swarm(spark, d), "swarm"), written(named, "alphas"))


SEATS = """a_seat as (select distinct company_name, investor_name, category_code as sector, funded_at as series_a_date from deals where funding_round_type = 'series-a'),
b_first as (select company_name, min(funded_at) as series_b_date from deals where funding_round_type = 'series-b' group by 1),
tq as (select distinct eval_date as q, investor from panel where in_top_tier),
seats as (select s.company_name, s.investor_name, sector, series_a_date, last_day((date_trunc('quarter', series_a_date) + interval 2 month)::date) as series_a_qtr, series_b_date,
        not exists (select 1 from deals x where x.funding_round_type = 'series-b' and x.company_name = s.company_name and x.investor_name = s.investor_name) as is_silent
    from a_seat s join b_first using (company_name) join tq on tq.investor = s.investor_name and tq.q = (select max(q) from (select distinct q from tq) where q <= series_a_date))"""
SCORES = """by_ as (select sector, series_a_qtr as eval_date, count(*) as n_expected, count(*) filter (where is_silent) as n_silent from seats group by 1, 2),
nm as (select sector, series_a_qtr as eval_date, investor_name, count(*) as n, row_number() over (partition by sector, series_a_qtr order by count(*) desc, investor_name) as r from seats where is_silent group by 1, 2, 3),
tp as (select sector, eval_date, string_agg(investor_name, '|' order by r) as top_silenced_investors from nm where r <= 5 group by 1, 2),
sms as (select sector, eval_date, n_expected, n_silent, top_silenced_investors, n_silent / (n_expected + 1e-9) as sms_score from by_ left join tp using (sector, eval_date))"""


@query(sql(DEALS, EDGES, QUARTERS, EXPANDING, SEATS, "select * from seats"))
def sms_silences(spark: SparkSession, d: str) -> DataFrame:
    deals = written(a.deals(spark, d), "deals", "zstd")
    return signals.silences(deals, _panel(deals, spark))


@query(sql(DEALS, EDGES, QUARTERS, EXPANDING, SEATS, SCORES, "select sector, eval_date, n_expected, n_silent, top_silenced_investors, round(sms_score, 6) as sms_score, round(n_silent * sms_score, 6) as sms_intensity, round(sms_score / max(sms_score) over (), 6) as sms_score_norm from sms"))
def sms_scores_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    return _r(signals.silence_scores(written(sms_silences(spark, d), "seats")), "sms_score", "sms_intensity", "sms_score_norm")


BASELINE = "bl as (select sector, avg(sms_score) as mean, greatest(stddev_pop(sms_score), 0.001) as sigma from sms_scores group by 1)"


@query(sql(BASELINE, "select sector, round(mean, 6) as mean, round(sigma, 6) as sigma from bl"))
def sms_baseline(spark: SparkSession, d: str) -> DataFrame:
    return _r(signals.baseline(table(spark, d, "sms_scores")), "mean", "sigma")


LIVE = f"""ev as (select event_id, ts as t, 'I' || user_id as investor, 'C' || json_extract_string(props, '$.k') as company, event_type = 'signup' as is_a, 'S' || (user_id % 6) as sector from events where event_type in ('signup', 'purchase')),
seats as (select event_id, investor, company, sector, t, company in (select company from ev where not is_a) as came,
        not exists (select 1 from ev b where not b.is_a and b.company = ev.company and lower(b.investor) = lower(ev.investor)) as is_silent
    from ev where is_a and (company in (select company from ev where not is_a) or timestamp '{AS_OF}' >= t + interval 5 day)),
live as (select sector, count(*) as n_expected, count(*) filter (where is_silent) as n_silent from seats where t >= timestamp '{AS_OF}' - interval 10 day group by 1 having count(*) >= 3)"""


def _live(spark: SparkSession, d: str) -> DataFrame:
    e = a.live_events(spark, d)
    return signals.live_silences(e, e.select("investor_name"), AS_OF, overdue_days=5)


@query(sql(LIVE, "select investor as investor_name, company as company_name, sector, t as series_a_date, came as series_b_occurred, is_silent from seats"))
def sms_live_silences(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).drop("series_b_expected_by").withColumn("series_a_date", F.col("series_a_date").cast("timestamp_ntz"))


@query(sql(LIVE, "select sector, round(n_silent / n_expected, 4) as sms_score, n_expected, n_silent, 0.25::double as baseline_mean, 0.1::double as baseline_sigma, round((n_silent / n_expected - 0.25) / 0.1, 4) as deviation_sigma from live"))
def sms_live_scores(spark: SparkSession, d: str) -> DataFrame:
    return signals.live_scores(_live(spark, d), signals.baseline(table(spark, d, "sms_scores")), AS_OF, window_days=10)


@query()
def sms_alerts(spark: SparkSession, d: str) -> DataFrame:
    seats = written(_live(spark, d), "seats")
    return signals.alerts(signals.live_scores(seats, signals.baseline(table(spark, d, "sms_scores")), AS_OF, window_days=10), seats)


PRICES = "px as (select event_type as ticker, ts::date as day, avg(value) as close from events group by 1, 2)"


@query(
    sql(PRICES, """sg as (select row_number() over (order by event_type) as signal_id, event_type as ticker, date '2024-01-05' as issued_on from (select distinct event_type from events where event_type <> 'view')),
o as (select signal_id, own, h as horizon_days, x.ticker as t, arg_min(close, day) as en, arg_max(close, day) as ex from (select signal_id, ticker as own, issued_on, h from sg, (values (5), (10), (20)) v(h)) s
    join px x on x.ticker in (own, 'view') and x.day between issued_on and issued_on + h group by 1, 2, 3, 4)
select p.signal_id, p.horizon_days, round(p.ex / p.en - 1, 6) as ret, round(q.ex / q.en - 1, 6) as benchmark_ret, round((p.ex / p.en) - (q.ex / q.en), 6) as excess
from o p join o q on p.signal_id = q.signal_id and p.horizon_days = q.horizon_days and p.t <> 'view' and q.t = 'view'""")
)
def mkt_outcomes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").filter("event_type <> 'view'").select(F.col("event_type").alias("ticker")).distinct()
    s = s.select(F.row_number().over(Window.orderBy("ticker")).cast("long").alias("signal_id"), "ticker", F.lit("2024-01-05").cast("date").alias("issued_on"))
    return _r(signals.outcomes(s, a.prices(spark, d), "view", (5, 10, 20)), "ret", "benchmark_ret", "excess")


@query(sql(PRICES, """dd as (select ticker, day, close / max(close) over (partition by ticker order by day) - 1 as dd, count(*) over (partition by ticker) as n from px)
select ticker, min(day) as day from dd where n >= 5 and dd < -0.02 group by 1"""))
def mkt_first_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return signals.first_drawdown(a.prices(spark, d))


@query("""with m as (select investor_id, eval_date, max(tps) as tps from tps_panel where tps is not null group by 1, 2),
l as (select *, tps - lag(tps) over (partition by investor_id order by eval_date) as momentum, row_number() over (partition by investor_id order by eval_date desc) as r from m where investor_id is not null)
select investor_id, eval_date, round(tps, 6) as tps, round(momentum, 6) as momentum from l where r = 1""")
def drv_tps_momentum(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "tps_panel").filter("tps is not null and investor_id is not null").groupBy("investor_id", "eval_date").agg(F.max("tps").alias("tps"))
    return _r(signals.momentum(p, "investor_id", "eval_date", "tps"), "tps", "momentum")


@query("""with m as (select sector, eval_date, avg(sms_score) as s from sms_scores group by 1, 2),
l as (select *, s - lag(s) over (partition by sector order by eval_date) as m, row_number() over (partition by sector order by eval_date desc) as r from m)
select sector, eval_date, round(s, 6) as sms_score, round(m, 6) as momentum from l where r = 1""")
def drv_sms_momentum(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "sms_scores").groupBy("sector", "eval_date").agg(F.avg("sms_score").alias("sms_score"))
    return _r(signals.momentum(p, "sector", "eval_date", "sms_score"), "sms_score", "momentum")


@query(sql(DEALS, """n as (select category_code, investor_name, count(*) as n from deals group by 1, 2), s as (select category_code, n / sum(n) over (partition by category_code) as s, sum(n) over (partition by category_code) as total from n)
select category_code, round(sum(s * s), 9) as hhi, max(total)::bigint as total from s group by 1 having max(total) >= 3"""))
def drv_concentration(spark: SparkSession, d: str) -> DataFrame:
    return _r(signals.concentration(a.deals(spark, d), "category_code", "investor_name"), "hhi", digits=9)


@query(sql(DEALS, """q as (select category_code, date_trunc('quarter', funded_at)::date as q, count(*) as n from deals group by 1, 2),
l as (select *, n - lag(n) over (partition by category_code order by q) as velocity, row_number() over (partition by category_code order by q desc) as r from q)
select category_code, q as quarter, n as n_deals, velocity from l where r = 1"""))
def drv_sector_velocity(spark: SparkSession, d: str) -> DataFrame:
    q = a.deals(spark, d).groupBy("category_code", F.trunc("funded_at", "quarter").alias("quarter")).agg(F.count(F.lit(1)).alias("n_deals"))
    return signals.momentum(q, "category_code", "quarter", "n_deals").withColumnRenamed("momentum", "velocity")


RETURNS = """m as (select last_day(o_orderdate::date) as date, o_orderpriority as series, sum(o_totalprice) as v from orders group by 1, 2),
ret as (select series, date, v / lag(v) over (partition by series order by date) - 1 as ret from m)"""
FACTORS = """fac as (select last_day(o_orderdate::date) as date, count(*) / 1000.0::double as mkt, avg(o_totalprice) / 1e6 as smb, avg((o_orderstatus = 'F')::int) as hml from orders group by 1)"""


@query(sql(RETURNS, "select series, date, round(ret, 9) as ret from ret"))
def sta_returns(spark: SparkSession, d: str) -> DataFrame:
    return _r(a.returns(spark, d), "ret", digits=9)


@query(sql(RETURNS, FACTORS, "select series, round(regr_slope(ret, mkt), 6) as slope, round(regr_intercept(ret, mkt), 6) as intercept, round(regr_r2(ret, mkt), 6) as r2, count(ret) as n from ret join fac using (date) group by 1"))
def sta_simple_regression(spark: SparkSession, d: str) -> DataFrame:
    j = a.returns(spark, d).join(a.factors(spark, d), "date")
    return _r(j.groupBy("series").agg(F.regr_slope("ret", "mkt").alias("slope"), F.regr_intercept("ret", "mkt").alias("intercept"), F.regr_r2("ret", "mkt").alias("r2"), F.count("ret").alias("n")), "slope", "intercept", "r2")


@query(sql(RETURNS, FACTORS, "select series, round(corr(ret, smb), 6) as r, count(*) as n from ret join fac using (date) where ret is not null group by 1"))
def sta_correlation(spark: SparkSession, d: str) -> DataFrame:
    j = a.returns(spark, d).join(a.factors(spark, d), "date")
    return _r(stats.correlation(j, "series", "ret", "smb"), "r").select("series", "r", "n")


@query(sql(RETURNS, "select series, date, round(ret - avg(ret) over (partition by series) - avg(ret) over (partition by date) + avg(ret) over (), 9) as ret from ret where ret is not null"))
def sta_demeaned(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.demean(a.returns(spark, d).filter("ret is not null"), ["ret"], "series", "date"), "ret", digits=9)


@query()
def sta_rolling_alpha(spark: SparkSession, d: str) -> DataFrame:
    return stats.rolling_alpha(a.returns(spark, d), a.factors(spark, d), a.MEASURES)


@query()
def sta_panel_regression(spark: SparkSession, d: str) -> DataFrame:
    j = written(a.returns(spark, d).join(a.factors(spark, d), "date").filter("ret is not null"), "panel")
    fit, se = stats.ols(j, "ret", ["mkt", "smb"]), stats.clustered_errors(j, "ret", ["mkt", "smb"], "series", "date")
    f, p = stats.incremental_f(j, "ret", ["mkt"], ["mkt", "smb"])
    rows = [(n, float(b), float(s), float(x)) for n, b, s, x in zip(("intercept", "mkt", "smb"), fit["beta"], se, fit["p"])] + [("F", float(f), None, float(p))]
    return spark.createDataFrame(rows, "term string, value double, clustered_se double, p double")


@query()
def sta_placebo(spark: SparkSession, d: str) -> DataFrame:
    j = a.returns(spark, d).join(a.factors(spark, d), "date")
    return stats.placebo(j, "ret", "mkt", draws=1000)


@query()
def sta_wild_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    j = a.returns(spark, d).join(a.factors(spark, d), "date")
    return stats.wild_bootstrap(j, "ret", "mkt", "series", draws=999)


# Profiles.


@query(sql(DEALS, EDGES, """s as (select source as investor, target as other, company from edges), x as (select investor, other, company from s union all select other, investor, company from s)
select investor, other, count(*) as n_links, count(distinct company) as n_companies from x group by 1, 2"""))
def biz_co_investors(spark: SparkSession, d: str) -> DataFrame:
    e = a.edges(spark, d)
    both = e.select(F.inline(F.array(F.struct(F.col("source").alias("investor"), F.col("target").alias("other"), "company"), F.struct(F.col("target").alias("investor"), F.col("source").alias("other"), "company"))))
    return both.groupBy("investor", "other").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("company").alias("n_companies"))


@query("""select investor_id, sector, count(*) as n_deals, count(distinct company_id) as n_companies, sum(amount_usd) as amount from funding_events where investor_id is not null group by 1, 2""")
def biz_sector_posture(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "funding_events").filter("investor_id is not null")
    return f.groupBy("investor_id", "sector").agg(F.count(F.lit(1)).alias("n_deals"), F.countDistinct("company_id").alias("n_companies"), F.sum("amount_usd").alias("amount"))


@query(sql(DEALS, "select category_code, count(*) as n_deals, count(distinct company_name) as n_companies, count(distinct investor_name) as n_investors, min(funded_at) as first_deal, max(funded_at) as last_deal from deals group by 1"))
def biz_sector_overview(spark: SparkSession, d: str) -> DataFrame:
    return a.deals(spark, d).groupBy("category_code").agg(
        F.count(F.lit(1)).alias("n_deals"), F.countDistinct("company_name").alias("n_companies"), F.countDistinct("investor_name").alias("n_investors"), F.min("funded_at").alias("first_deal"), F.max("funded_at").alias("last_deal")
    )


@query(sql(DEALS, "select category_code, year(q) || 'Q' || quarter(q) as quarter, n_deals, n_companies from (select category_code, date_trunc('quarter', funded_at) as q, count(*) as n_deals, count(distinct company_name) as n_companies from deals group by 1, 2)"))
def biz_quarterly_flow(spark: SparkSession, d: str) -> DataFrame:
    return a.deals(spark, d).groupBy("category_code", text.quarter_label(F.col("funded_at")).alias("quarter")).agg(F.count(F.lit(1)).alias("n_deals"), F.countDistinct("company_name").alias("n_companies"))


@query(sql(DEALS, "select category_code, count(*) filter (where funding_round_type = 'series-a') as series_a, count(*) filter (where funding_round_type = 'series-b') as series_b, round(avg((funding_round_type = 'series-a')::int), 6) as share_a from deals group by 1"))
def biz_stage_distribution(spark: SparkSession, d: str) -> DataFrame:
    is_a = F.col("funding_round_type") == "series-a"
    return _r(a.deals(spark, d).groupBy("category_code").agg(F.count_if(is_a).alias("series_a"), F.count_if(~is_a).alias("series_b"), F.avg(is_a.cast("double")).alias("share_a")), "share_a")


@query("""with p as (select investor_id, max(tps) as tps from tps_panel where tps is not null and investor_id is not null group by 1), n as (select count(*) as n from p)
select investor_id, round(tps, 6) as tps, rank() over (order by tps desc) as place, round((rank() over (order by tps) - 1) / n::double * 100, 6) as percentile, ntile(4) over (order by tps desc, investor_id) as quarter from p, n""")
def biz_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "tps_panel").filter("tps is not null and investor_id is not null").groupBy("investor_id").agg(F.max("tps").alias("tps"))
    p = placed(p, [F.desc("tps"), F.col("investor_id")], row="row", total="n")
    least, n = F.min("row").over(Window.partitionBy("tps")), F.col("n")
    same = F.count(F.lit(1)).over(Window.partitionBy("tps"))
    p = p.withColumns({"place": least, "below": n - least + 1 - same})
    # The first n % 4 quarters have one more.
    small, more = F.floor(n / 4), n % 4
    edge = more * (small + 1)
    quarter = F.when(F.col("row") <= edge, F.floor((F.col("row") - 1) / (small + 1)) + 1).otherwise(more + F.floor((F.col("row") - edge - 1) / F.greatest(small, F.lit(1))) + 1)
    return p.select("investor_id", F.round("tps", 6).alias("tps"), F.col("place").cast("long").alias("place"), F.round(F.col("below") / n * 100, 6).alias("percentile"), quarter.cast("long").alias("quarter"))


@query("""select sector, round(median(sms_score), 6) as median, round(quantile_cont(sms_score, 0.9), 6) as p90, round(stddev_samp(sms_score), 6) as sd, count(*) filter (where sms_score > 0.5) as n_high,
    arg_max(eval_date, struct_pack(a := sms_score, b := eval_date)) as peak from sms_scores group by 1""")
def biz_score_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sms_scores").groupBy("sector").agg(
        F.median("sms_score").alias("median"), F.percentile("sms_score", F.lit(0.9)).alias("p90"), F.stddev_samp("sms_score").alias("sd"), F.count_if(F.col("sms_score") > 0.5).alias("n_high"), F.max_by("eval_date", F.struct("sms_score", "eval_date")).alias("peak")
    )
    return _r(s, "median", "p90", "sd")


@query("""select score_id, 'SMS' as kind, sector, eval_date, case when sms_score >= 0.5 then 'HIGH' when sms_score >= 0.3 then 'MEDIUM' else 'LOW' end as severity,
    substring(sha256(score_id || '|' || sector || '|' || eval_date), 1, 12) as feed_id from sms_scores""")
def biz_feed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sms_scores")
    return s.select("score_id", F.lit("SMS").alias("kind"), "sector", "eval_date", text.severity(F.col("sms_score")).alias("severity"), F.substring(F.sha2(F.concat_ws("|", "score_id", "sector", "eval_date"), 256), 1, 12).alias("feed_id"))


@query("""with l as (select *, row_number() over (partition by sector, market order by score_date desc) as r from sms_scores_live) select sector, market, score_date, sms_score, n_expected from l where r = 1""")
def biz_latest_scores(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("sector", "market").orderBy(F.desc("score_date"))
    return table(spark, d, "sms_scores_live").withColumn("r", F.row_number().over(w)).filter("r = 1").select("sector", "market", "score_date", "sms_score", "n_expected")


@query("""with z as (select community_id, size, (mean_tps - avg(mean_tps) over ()) / nullif(stddev_samp(mean_tps) over (), 0) as zt, (mean_in_degree - avg(mean_in_degree) over ()) / nullif(stddev_samp(mean_in_degree) over (), 0) as zi from community_summary)
select community_id, round(coalesce(zt, 0), 6) as z_tps, round(coalesce(zi, 0), 6) as z_in, round(0.6 * coalesce(zt, 0) + 0.4 * coalesce(zi, 0), 6) as composite from z""")
def biz_composite(spark: SparkSession, d: str) -> DataFrame:
    z = lambda c: F.coalesce((F.col(c) - F.col(f"avg_{c}")) / F.nullif(F.col(f"sd_{c}"), F.lit(0.0)), F.lit(0.0))
    t = table(spark, d, "community_summary")
    of = t.agg(*[f(c).alias(f"{n}_{c}") for c in ("mean_tps", "mean_in_degree") for n, f in (("avg", F.avg), ("sd", F.stddev_samp))])
    s = t.join(F.broadcast(of)).select("community_id", z("mean_tps").alias("z_tps"), z("mean_in_degree").alias("z_in"))
    return _r(s.withColumn("composite", 0.6 * F.col("z_tps") + 0.4 * F.col("z_in")), "z_tps", "z_in", "composite")


@query("""pivot (select sector, year(eval_date) as y, sms_score from sms_scores) on y in (2015, 2016, 2017, 2018) using round(max(sms_score), 6) group by sector""")
def biz_heatmap(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sms_scores").withColumn("y", F.year("eval_date"))
    return s.groupBy("sector").pivot("y", [2015, 2016, 2017, 2018]).agg(F.round(F.max("sms_score"), 6))


@query("""select upper(country) as country, count(*) as n, count(distinct company_id) as companies, count(distinct investor_id) as investors, sum(amount_usd) as amount from funding_events where upper(country) in ('AE', 'ARE', 'SA', 'SAU', 'EG', 'EGY', 'TR', 'TUR') group by 1""")
def biz_regional(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "funding_events").withColumn("country", F.upper("country")).filter(F.col("country").isin("AE", "ARE", "SA", "SAU", "EG", "EGY", "TR", "TUR"))
    return f.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("company_id").alias("companies"), F.countDistinct("investor_id").alias("investors"), F.sum("amount_usd").alias("amount"))


# Text.


@query("""select distinct category_code, case lower(trim(category_code)) when 'software' then 'IGV' when 'enterprise' then 'IGV' when 'security' then 'IGV' when 'semiconductor' then 'SOXX' when 'hardware' then 'SOXX'
    when 'biotech' then 'XBI' when 'medical' then 'XBI' when 'cleantech' then 'SOXX' else 'IGV' end as etf from objects""")
def txt_category_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "objects").select("category_code").distinct().select("category_code", text.category_to_etf(F.col("category_code")).alias("etf"))


@query("""select doc_id, case when contains(t, 'software') or contains(t, 'saas') or contains(t, 'cloud') or contains(t, 'enterprise') then 'IGV' when contains(t, 'chip') or contains(t, 'semiconductor') or contains(t, 'hardware') then 'SOXX'
    when contains(t, 'biotech') or contains(t, 'pharma') or contains(t, 'genomics') or contains(t, 'health') then 'XBI' when contains(t, 'fintech') or contains(t, 'payments') or contains(t, 'banking') or contains(t, 'insurtech') then 'XLF'
    when contains(t, 'ecommerce') or contains(t, 'marketplace') or contains(t, 'social') then 'FDN' when contains(t, 'cleantech') or contains(t, 'solar') or contains(t, 'renewable') then 'QCLN'
    when contains(t, 'ai') or contains(t, 'llm') or contains(t, 'deep learning') then 'ARKW' when contains(t, 'security') or contains(t, 'cybersecurity') then 'HACK' else 'IGV' end as sector,
    case when contains(t, 'series d') then 'series d' when contains(t, 'series c') then 'series-c' when contains(t, 'series b') then 'series-b' when contains(t, 'series a') then 'series-a' when contains(t, 'seed') then 'seed' when contains(t, 'angel') then 'angel' else 'venture' end as round
    from (select doc_id, lower(text) as t from documents where text is not null)""")
def txt_sector_and_round(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", text.sector_of_text(F.col("text")).alias("sector"), text.round_of_text(F.col("text")).alias("round"))


@query(r"""select doc_id, trunc(case when b <> '' then b::double * 1e9 when m <> '' then m::double * 1e6 when p <> '' then replace(p, ',', '')::double end)::bigint as amount from (select doc_id,
    regexp_extract(text, '(?i)\$(\d+(?:\.\d+)?)\s*(?:billion|bn)', 1) as b, regexp_extract(text, '(?i)\$(\d+(?:\.\d+)?)\s*(?:million|mn|m)\b', 1) as m, regexp_extract(text, '\$(\d+(?:,\d{3})*(?:\.\d+)?)', 1) as p from documents where text is not null)""")
def txt_amount(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.amount_of_text(F.col("text")).alias("amount"))


@query("""select event_id, sha256('v1|' || event_id || '|' || user_id || '|' || event_type) as receipt from events""")
def hsh_receipts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.chain(F.lit("v1|"), F.col("event_id"), F.lit("|"), F.col("user_id"), F.lit("|"), F.col("event_type")).alias("receipt"))


@query()
def hsh_audit(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "tps_panel").filter("tps is not null")
    return text.audit_hashes(p.select("eval_date", "investor", "tps"))
