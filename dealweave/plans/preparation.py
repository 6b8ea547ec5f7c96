"""Queries for the general data-preparation operators (problems 1, 4, 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.operators.as_known import as_known
from dealweave.operators.instants import to_instants
from dealweave.operators.packed_lists import unpack_lists
from dealweave.operators.trailing import trailing_totals
from dealweave.session import table


def p1_as_known(spark: SparkSession, d: str) -> DataFrame:
    """Each silence event with the investor's tier and score as known at its Series A date."""
    return as_known(
        table(spark, d, "silence_events"),
        table(spark, d, "tps_panel"),
        event_id="silence_id",
        event_time="series_a_date",
        entity="investor_id",
        version_id="panel_id",
        valid_from="eval_date",
        visible_at="published_at",
        attributes=("in_top_tier", "tps"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_as_known(spark, d).filter("panel_id is not null").select("silence_id", "panel_id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    runs, communities = table(spark, d, "sms_scores"), table(spark, d, "community_summary")
    at = lambda df, t, i, f: df.select(F.struct(F.lit(t).alias("t"), F.col(i).cast("long").alias("i"), F.lit(f).alias("f")).alias("at"), F.col(f).alias("x"))
    investors = table(spark, d, "objects").filter("id like 'f:%' or id like 'p:%'")
    people = at(runs, "sms_scores", "score_id", "top_silenced_investors").unionByName(at(communities, "community_summary", "community_id", "top_investors"))
    sectors = at(communities, "community_summary", "community_id", "top_sectors")
    found = unpack_lists(people, investors, row_id="at", text="x", value="name").unionByName(
        unpack_lists(sectors, table(spark, d, "sector_bridge"), row_id="at", text="x", value="crunchbase_category")
    )
    return found.select(F.col("at.t").alias("src_table"), F.col("at.i").alias("row_id"), F.col("at.f").alias("field_name"), "pos", "val").distinct()


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    """Each announcement with the UTC instant that its text denotes and the format it was read by."""
    return to_instants(table(spark, d, "funding_events"), table(spark, d, "feed_sources"), row_id="event_id", text="announced_at", source="source")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_instants(spark, d).filter("epoch_us is not null").select("event_id", "epoch_us").distinct()


def p7_silent_days(spark: SparkSession, d: str) -> DataFrame:
    """For each investor and day: silent events of the trailing 7 and 30 days."""
    silent = table(spark, d, "silence_events").filter("is_silent and investor_id is not null and series_a_date is not null")
    once = silent.groupBy("silence_id", "investor_id").agg(F.min(F.col("series_a_date").cast("date")).alias("on_day"))
    return trailing_totals(once, entity=["investor_id"], day="on_day")


def p7_score_days(spark: SparkSession, d: str) -> DataFrame:
    """For each sector, market and day: totals and means of the score, in millionths, over the trailing 7 and 30 days."""
    scores = table(spark, d, "sms_scores_live").withColumn("millionths", F.round(F.col("sms_score") * 1e6))
    return trailing_totals(scores, entity=["sector", "market"], day="score_date", value="millionths", until="last")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    text = F.date_format("day", "yyyy-MM-dd").alias("on_day")
    silent = p7_silent_days(spark, d).filter("n_30 >= 4").select(F.col("investor_id").alias("entity"), text)
    above = "n_7 > 0 and total_7 * n_30 - total_30 * n_7 > 150000D * n_7 * n_30"
    scores = p7_score_days(spark, d).filter(above).select(F.concat_ws("/", "sector", "market").alias("entity"), text)
    return silent.unionByName(scores)


QUERIES = {f.__name__: f for f in (p1_found, p1_as_known, p4_found, p6_found, p6_instants, p7_found, p7_silent_days, p7_score_days)}

_KNOWN = """
    select e.silence_id, v.panel_id, v.in_top_tier, v.tps
    from silence_events e left join lateral (
        select panel_id, in_top_tier, tps from tps_panel v
        where v.investor_id = e.investor_id and v.eval_date::timestamp <= e.series_a_date::timestamptz at time zone 'UTC' and v.published_at <= e.series_a_date
        order by eval_date desc, published_at desc, panel_id limit 1) v on true"""

ORACLE = {
    "p1_as_known": _KNOWN,
    "p1_found": f"select distinct silence_id, panel_id from ({_KNOWN}) where panel_id is not null",
    "p7_found": """
        with s as (select investor_id as entity, min((series_a_date at time zone 'UTC')::date) as d from silence_events
                   where is_silent and investor_id is not null and series_a_date is not null group by silence_id, investor_id),
        n as (select entity, d, count(*) as n from s group by all),
        days as (select distinct entity, (d + i::int)::date as d from n, range(30) r(i)),
        a as (select days.entity, days.d from days join n on n.entity = days.entity and n.d between days.d - 29 and days.d
              group by all having sum(n.n) >= 4),
        m as (select sector || '/' || market as entity, score_date as d, round(sms_score * 1e6)::bigint as v from sms_scores_live),
        ends as (select entity, max(d) as last from m group by 1),
        md as (select distinct m.entity, (d + i::int)::date as d from m join ends using (entity), range(30) r(i) where d + i::int <= last),
        b as (select md.entity, md.d,
                sum(v) as s30, count(v) as n30, sum(v) filter (where m.d >= md.d - 6) as s7, count(v) filter (where m.d >= md.d - 6) as n7
              from md join m on m.entity = md.entity and m.d between md.d - 29 and md.d group by all)
        select entity, strftime(d, '%Y-%m-%d') as on_day from a
        union all
        select entity, strftime(d, '%Y-%m-%d') from b where n7 > 0 and s7 * n30 - s30 * n7 > 150000 * n7 * n30""",
    "p7_silent_days": """
        with s as (select investor_id, min((series_a_date at time zone 'UTC')::date) as d from silence_events
                   where is_silent and investor_id is not null and series_a_date is not null group by silence_id, investor_id),
        n as (select investor_id, d, count(*) as n from s group by all),
        days as (select distinct investor_id, (d + i::int)::date as day from n, range(30) r(i)),
        t as (select days.investor_id, day, coalesce(sum(n) filter (where n.d >= day - 6), 0)::double as t7, sum(n)::double as t30
              from days join n on n.investor_id = days.investor_id and n.d between day - 29 and day group by all)
        select investor_id, day, t7 as total_7, t7::bigint as n_7, case when t7 > 0 then 1.0::double end as mean_7, t30 as total_30, t30::bigint as n_30, 1.0::double as mean_30 from t""",
    "p7_score_days": """
        with m as (select sector, market, score_date as d, round(sms_score * 1e6)::double as v from sms_scores_live),
        ends as (select sector, market, max(d) as last from m group by all),
        days as (select distinct m.sector, m.market, (d + i::int)::date as day from m join ends using (sector, market), range(30) r(i) where d + i::int <= last),
        t as (select days.sector, days.market, day, coalesce(sum(v) filter (where m.d >= day - 6), 0) as t7, count(v) filter (where m.d >= day - 6) as n7, coalesce(sum(v), 0) as t30, count(v) as n30
              from days join m on m.sector = days.sector and m.market = days.market and m.d between day - 29 and day group by all)
        select sector, market, day, t7 as total_7, n7 as n_7, case when n7 > 0 then t7 / n7 end as mean_7, t30 as total_30, n30 as n_30, case when n30 > 0 then t30 / n30 end as mean_30 from t""",
}
