"""Swarm and silence signals, their panels, live scores and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BASELINE = (0.25, 0.1)


def quarter_end(c: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(c, "quarter"), 2))


def swarm(panel: DataFrame, entries: DataFrame, months: int = 6, least: int = 5, tie: str = "row") -> DataFrame:
    """(eval_date, sector, ssi, ssi_dumb, n_entrants, mean_tps_pit, max_tps_pit, n_top_tier, ipd_spread_days, swarm_investors).

    Entrants of (eval_date - months, eval_date], weighted by the inverse of their rank by first entry; ties go by name (tie="row") or share
    their mean rank (tie="average"). Scores are those of the same eval_date, 0 where there is none.
    """
    dates = panel.select("eval_date").distinct()
    # The dates are a short list, so entries meet them in place and are not shuffled for it.
    since = (F.col("first_entry_date") > F.add_months("eval_date", -months)) & (F.col("first_entry_date") <= F.col("eval_date"))
    near = entries.join(F.broadcast(dates), since)
    at = near.join(panel.select("eval_date", F.col("investor").alias("investor_name"), "tps", "in_top_tier"), ["eval_date", "investor_name"], "left")
    cell = Window.partitionBy("eval_date", "sector")
    if tie == "row":
        rank = F.row_number().over(cell.orderBy("first_entry_date", "investor_name"))
    else:
        same = F.count(F.lit(1)).over(Window.partitionBy("eval_date", "sector", "first_entry_date"))
        rank = F.rank().over(cell.orderBy("first_entry_date")) + (same - 1) / 2
    at = at.withColumns({"rank": rank, "pit": F.coalesce("tps", F.lit(0.0))})
    s = at.groupBy("eval_date", "sector").agg(
        F.sum(F.col("pit") / F.col("rank")).alias("ssi"), F.count(F.lit(1)).cast("double").alias("ssi_dumb"), F.count(F.lit(1)).alias("n_entrants"),
        F.round(F.avg("pit"), 6).alias("mean_tps_pit"), F.round(F.max("pit"), 6).alias("max_tps_pit"), F.count_if(F.coalesce("in_top_tier", F.lit(False))).alias("n_top_tier"),
        F.datediff(F.max("first_entry_date"), F.min("first_entry_date")).cast("double").alias("ipd_spread_days"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_entry_date", "investor_name"))), lambda x: x["investor_name"]), "|").alias("swarm_investors"),
    )
    return s.filter(F.col("n_entrants") >= least)


def event_panel(signal: DataFrame, alphas: DataFrame, horizons: tuple[int, ...] = (6, 12, 18, 24, 36)) -> DataFrame:
    """signal with alpha_k (of date - k months), retmom_alpha_k (three rows back), log_deal_volume and ssi_norm (min-max within the sector)."""
    p = signal
    for k in horizons:
        p = p.join(alphas.select(F.add_months("date", -k).alias("eval_date"), "sector", F.col("alpha").alias(f"alpha_k{k}")), ["eval_date", "sector"], "left")
    w = Window.partitionBy("sector").orderBy("eval_date")
    all_ = Window.partitionBy("sector")
    p = p.withColumns({f"retmom_alpha_k{k}": F.lag(f"alpha_k{k}", 3).over(w) for k in horizons})
    lo, hi = F.min("ssi").over(all_), F.max("ssi").over(all_)
    return p.withColumns({"log_deal_volume": F.log1p("n_entrants"), "ssi_norm": (F.col("ssi") - lo) / (hi - lo + 1e-10)})


def silences(deals: DataFrame, panel: DataFrame, sector: str = "category_code") -> DataFrame:
    """(company_name, investor_name, sector, series_a_date, series_a_qtr, series_b_date, is_silent).

    Investors of a Series A that were top-tier in the latest quarter up to its date, in companies that had a Series B; silent where they weren't in it.
    """
    a = deals.filter("funding_round_type = 'series-a'").select("company_name", "investor_name", F.col(sector).alias("sector"), F.col("funded_at").alias("series_a_date")).distinct()
    b = deals.filter("funding_round_type = 'series-b'")
    later = b.groupBy("company_name").agg(F.min("funded_at").alias("series_b_date"))
    there = b.select("company_name", "investor_name").distinct().withColumn("there", F.lit(True))
    tier = panel.filter("in_top_tier").select(quarter_end(F.col("eval_date")).alias("q"), F.col("investor").alias("investor_name")).distinct()
    quarters = tier.select("q").distinct()
    latest = a.select("series_a_date").distinct().join(F.broadcast(quarters), F.col("q") <= F.col("series_a_date")).groupBy("series_a_date").agg(F.max("q").alias("q"))
    seat = a.join(later, "company_name").join(latest, "series_a_date").join(tier, ["q", "investor_name"], "left_semi")
    seat = seat.join(there, ["company_name", "investor_name"], "left")
    return seat.select("company_name", "investor_name", "sector", "series_a_date", quarter_end(F.col("series_a_date")).alias("series_a_qtr"), "series_b_date", F.col("there").isNull().alias("is_silent"))


def silence_scores(events: DataFrame, top: int = 5) -> DataFrame:
    """(sector, eval_date, n_expected, n_silent, top_silenced_investors, sms_score, sms_intensity, sms_score_norm) by sector and quarter."""
    by = events.groupBy("sector", "series_a_qtr").agg(F.count(F.lit(1)).alias("n_expected"), F.sum(F.col("is_silent").cast("int")).alias("n_silent"))
    quiet = events.filter("is_silent").groupBy("sector", "series_a_qtr", "investor_name").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("sector", "series_a_qtr").orderBy(F.desc("n"), "investor_name")
    names = quiet.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).groupBy("sector", "series_a_qtr").agg(F.sort_array(F.collect_list(F.struct("r", "investor_name"))).alias("x"))
    s = by.join(names.select("sector", "series_a_qtr", F.array_join(F.transform("x", lambda y: y["investor_name"]), "|").alias("top_silenced_investors")), ["sector", "series_a_qtr"], "left")
    s = s.withColumn("sms_score", F.col("n_silent") / (F.col("n_expected") + F.lit(1e-9)))
    most = F.max("sms_score").over(Window.partitionBy())
    return s.select("sector", F.col("series_a_qtr").alias("eval_date"), "n_expected", "n_silent", "top_silenced_investors", "sms_score",
                    (F.col("n_silent") * F.col("sms_score")).alias("sms_intensity"), F.when(most > 0, F.col("sms_score") / most).otherwise(0.0).alias("sms_score_norm"))


def baseline(scores: DataFrame) -> DataFrame:
    """(sector, mean, sigma): population figures, sigma at least 0.001."""
    return scores.groupBy("sector").agg(F.avg("sms_score").alias("mean"), F.greatest(F.stddev_pop("sms_score"), F.lit(0.001)).alias("sigma"))


def live_silences(events: DataFrame, tier: DataFrame, as_of: str, overdue_days: int = 540) -> DataFrame:
    """Silent and expected seats of Series A events (company_name, investor_name, sector, round_type, announced_at) as of a time.

    A seat of a top-tier investor (tier: investor_name) counts once the company's Series B came, or is overdue; it is silent where the investor
    isn't in the Series B (names compared without case) or none came.
    """
    kind = F.lower(F.trim("round_type"))
    a = events.filter((kind == "series-a") & F.col("company_name").isNotNull() & F.col("announced_at").isNotNull()).join(tier.select("investor_name").distinct(), "investor_name", "left_semi")
    b = events.filter((kind == "series-b") & F.col("company_name").isNotNull())
    came = b.select(F.lower("company_name").alias("k")).distinct().withColumn("came", F.lit(True))
    there = b.filter("investor_name is not null").select(F.lower("company_name").alias("k"), F.lower("investor_name").alias("i")).distinct().withColumn("there", F.lit(True))
    s = a.withColumns({"k": F.lower("company_name"), "i": F.lower("investor_name"), "due": F.col("announced_at") + F.make_dt_interval(F.lit(overdue_days))})
    s = s.join(came, "k", "left").join(there, ["k", "i"], "left").withColumn("came", F.coalesce("came", F.lit(False)))
    s = s.filter(F.col("came") | (F.lit(as_of).cast("timestamp") >= F.col("due")))
    return s.select("investor_name", "company_name", F.coalesce("sector", F.lit("IGV")).alias("sector"), F.col("announced_at").alias("series_a_date"), F.col("due").alias("series_b_expected_by"),
                    F.col("came").alias("series_b_occurred"), F.col("there").isNull().alias("is_silent"))


def live_scores(seats: DataFrame, base: DataFrame, as_of: str, window_days: int = 90, least: int = 3) -> DataFrame:
    """(sector, sms_score, n_expected, n_silent, baseline_mean, baseline_sigma, deviation_sigma) over the window that ends at as_of."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(window_days))
    s = seats.filter(F.col("series_a_date") >= since).groupBy("sector").agg(F.count(F.lit(1)).alias("n_expected"), F.sum(F.col("is_silent").cast("int")).alias("n_silent"))
    s = s.filter(F.col("n_expected") >= least).join(base, "sector", "left")
    mean, sigma = F.coalesce("mean", F.lit(DEFAULT_BASELINE[0])), F.coalesce("sigma", F.lit(DEFAULT_BASELINE[1]))
    score = F.col("n_silent") / F.col("n_expected")
    return s.select("sector", F.round(score, 4).alias("sms_score"), "n_expected", "n_silent", F.round(mean, 4).alias("baseline_mean"), F.round(sigma, 4).alias("baseline_sigma"),
                    F.round((score - mean) / F.greatest(sigma, F.lit(1e-6)), 4).alias("deviation_sigma"))


def alerts(scores: DataFrame, seats: DataFrame, threshold: float = 2.0, names: int = 5) -> DataFrame:
    """Scores above the threshold with their first silent investors (by date, then name) and sealed hashes of input and output."""
    first = seats.filter("is_silent").groupBy("sector", "investor_name").agg(F.min("series_a_date").alias("t"))
    w = Window.partitionBy("sector").orderBy("t", "investor_name")
    some = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= names).groupBy("sector").agg(F.sort_array(F.collect_list(F.struct("r", "investor_name"))).alias("x"))
    s = scores.filter(F.col("deviation_sigma") > threshold).join(some, "sector", "left")
    who = F.coalesce(F.array_join(F.transform("x", lambda y: y["investor_name"]), "|"), F.lit(""))
    given = F.concat_ws("|", "sector", "sms_score", "baseline_mean", "baseline_sigma", "deviation_sigma", "n_expected", "n_silent")
    s = s.withColumns({"contributing_investors": who, "input_sha256": F.sha2(given, 256)}).withColumn("output_sha256", F.sha2(F.concat(F.lit("NEGATIVE_ALPHA|"), "contributing_investors"), 256))
    return s.select("sector", "sms_score", "deviation_sigma", "n_silent", "contributing_investors", "input_sha256", "output_sha256")


def outcomes(signals: DataFrame, prices: DataFrame, benchmark: str, horizons: tuple[int, ...] = (30, 60, 90), as_of: str | None = None) -> DataFrame:
    """(signal_id, horizon_days, ret, benchmark_ret, excess) of signals (signal_id, ticker, issued_on) over prices (ticker, day, close).

    The entry is the first price from issued_on on, the exit the last up to issued_on + horizon; without both, or before the horizon is over, no row.
    """
    s = signals.select("signal_id", "ticker", "issued_on", F.explode(F.array(*map(F.lit, horizons))).alias("horizon_days")).withColumn("ends", F.date_add("issued_on", F.col("horizon_days")))
    if as_of is not None:
        s = s.filter(F.col("ends") <= F.lit(as_of).cast("date"))
    both = s.select("*", F.explode(F.array_distinct(F.array(F.col("ticker"), F.lit(benchmark)))).alias("of"))
    # As of each day asked for: the last price up to it and the first one from it on. Days are asked once for a ticker, however many signals it has.
    p = prices.select(F.col("ticker").alias("of"), "day", F.struct("day", "close").alias("px"))
    asked = both.select("of", F.explode(F.array("issued_on", "ends")).alias("day")).distinct()
    all_ = p.unionByName(asked.withColumn("px", F.lit(None).cast(p.schema["px"].dataType)))
    up, down = Window.partitionBy("of").orderBy("day"), Window.partitionBy("of").orderBy(F.desc("day"))
    at = all_.withColumns({"last": F.last("px", True).over(up), "next": F.last("px", True).over(down)}).filter("px is null").drop("px")
    # Where a price stands on the day itself, range frames hold it on both sides.
    met = both.join(at.select("of", F.col("day").alias("issued_on"), F.col("next").alias("entry")), ["of", "issued_on"])
    met = met.join(at.select("of", F.col("day").alias("ends"), F.col("last").alias("exit")), ["of", "ends"])
    r = met.filter("entry.day <= ends and exit.day >= issued_on").withColumn("ret", F.col("exit.close") / F.col("entry.close") - 1)
    own, bench = r.filter("of = ticker").select("signal_id", "horizon_days", "ret"), r.filter(F.col("of") == benchmark).select("signal_id", "horizon_days", F.col("ret").alias("benchmark_ret"))
    return own.join(bench, ["signal_id", "horizon_days"]).withColumn("excess", F.col("ret") - F.col("benchmark_ret"))


def first_drawdown(prices: DataFrame, limit: float = -0.02, least: int = 5) -> DataFrame:
    """(ticker, day): the first day a ticker (of at least so many prices) is below its running maximum by more than the limit."""
    w = Window.partitionBy("ticker").orderBy("day")
    p = prices.withColumns({"top": F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    return p.filter((F.col("n") >= least) & (F.col("close") / F.col("top") - 1 < limit)).groupBy("ticker").agg(F.min("day").alias("day"))


def momentum(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """(key, day, value, momentum): each key's latest row with its change from the row before."""
    w = Window.partitionBy(key).orderBy(day)
    m = rows.withColumns({"momentum": F.col(value) - F.lag(value).over(w), "_r": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(day)))})
    return m.filter("_r = 1").select(key, day, value, "momentum")


def concentration(deals: DataFrame, key: str, of: str, least: int = 3) -> DataFrame:
    """(key, hhi, total): the sum of squared shares of `of` within key, for keys of at least so many rows."""
    n = deals.groupBy(key, of).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    return n.withColumn("total", F.sum("n").over(w)).groupBy(key).agg(F.sum((F.col("n") / F.col("total")) * (F.col("n") / F.col("total"))).alias("hhi"), F.first("total").alias("total")).filter(F.col("total") >= least)
