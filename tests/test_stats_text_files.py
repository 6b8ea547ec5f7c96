import datetime as dt
import difflib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dealweave.functions import text
from dealweave.operators import signals, stats
from dealweave.sources import files
from dealweave.streaming import live


def test_distributions_against_tables():
    assert math.isclose(stats.t_two_sided(2.228, 10), 0.05, abs_tol=2e-4) and math.isclose(stats.t_two_sided(1.96, 1e6), 0.05, abs_tol=1e-4)
    assert math.isclose(stats.f_tail(3.493, 2, 20), 0.05, abs_tol=2e-4) and stats.t_two_sided(0, 5) == 1.0
    # Published pairs of (r, n, p).
    for r, n, p in ((0.0227, 35, 0.8969), (-0.0355, 73, 0.7655), (0.0448, 37, 0.7923), (-0.0596, 76, 0.6091), (0.0473, 67, 0.7036)):
        assert abs(stats.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2) - p) < 5e-4


def test_regressions(spark):
    rng = np.random.default_rng(0)
    n = 240
    x = rng.normal(size=(n, 2))
    g, t = np.arange(n) % 6, np.arange(n) // 6
    y = 0.5 + x @ [2.0, -1.0] + rng.normal(size=n) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1], "g": g, "t": t}))
    fit = stats.ols(df, "y", ["a", "b"])
    assert np.allclose(fit["beta"], np.linalg.lstsq(np.c_[np.ones(n), x], y, rcond=None)[0]) and fit["r2"] > 0.99 and (fit["p"] < 1e-6).all()
    f, p = stats.incremental_f(df, "y", ["a"], ["a", "b"])
    assert f > 100 and p < 1e-6
    se = stats.clustered_errors(df, "y", ["a", "b"], "g", "t")
    assert se.shape == (3,) and (se > 0).all() and (se < 0.1).all()
    d = stats.demean(df, ["y"], "g", "t").toPandas()
    assert abs(d.groupby("g")["y"].mean()).max() < 1e-9 and abs(d.groupby("t")["y"].mean()).max() < 1e-9
    assert stats.placebo(df, "y", "a", draws=50).first().p < 0.05
    assert stats.wild_bootstrap(df, "y", "a", "g", draws=49).first().slope > 1.5


def test_rolling_alpha_matches_direct_solves(spark):
    rng = np.random.default_rng(1)
    n, names = 40, ["m", "s"]
    dates = [dt.date(2000 + (k // 12), k % 12 + 1, 28) for k in range(n)]
    f = rng.normal(size=(n, 2))
    ret = 0.01 + f @ [1.0, 0.5] + rng.normal(size=n) * 0.01
    gap = [None if k == 5 else float(v) for k, v in enumerate(ret)]
    r = spark.createDataFrame([("s1", d, v) for d, v in zip(dates, gap)], "series string, date date, ret double")
    fac = spark.createDataFrame([(d, float(a), float(b), 0.0) for d, (a, b) in zip(dates, f)], "date date, m double, s double, rf double")
    got = {x.date: x.alpha for x in stats.rolling_alpha(r, fac, names, window=24).collect()}
    assert got[dates[24]] is None and got[dates[10]] is None
    want = np.linalg.lstsq(np.c_[np.ones(24), f[10:34]], ret[10:34], rcond=None)[0][0]
    assert math.isclose(got[dates[34]], want, abs_tol=1e-9)


def test_text(spark):
    rows = [("Acme Labs raises $5.5 million Series A", 5_500_000, "Acme Labs", "series-a"), ("Bolt secures $1.2bn", 1_200_000_000, "Bolt", "venture"), ("No money pre-seed", None, "No money pre-seed", "seed"), ("X gets $750,000", 750_000, "X", "venture"), (None, None, None, "venture")]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select(text.amount_of_text(F.col("t")), text.company_of_headline(F.col("t")), text.round_of_text(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]
    pairs = [("night", "nacht", 0.25), ("same", "SAME", 1.0), ("a", "b", 0.0), ("aaaa", "aa", 0.5)]
    df = spark.createDataFrame(pairs, "a string, b string, w double")
    for r in df.select("a", "b", "w", text.bigram_dice(F.col("a"), F.col("b")).alias("d"), text.matching_ratio("a", "b").alias("m")).collect():
        assert math.isclose(r.d, r.w) and math.isclose(r.m, difflib.SequenceMatcher(None, r.a, r.b).ratio())
    p = text.portfolio_names(spark.createDataFrame([(1, "Alpha; \"Beta\",alpha\nab\nGamma")], "i int, t string"), "t", "i")
    assert [r.name for r in p.orderBy("pos").collect()] == ["Alpha", "Beta", "Gamma"]
    assert text.seal({"b": 1, "a": 2}) == text.seal({"a": 2, "b": 1}) and text.stable_uuid("x") == text.stable_uuid("x")
    cats = spark.createDataFrame([("software",), (" Mobile health ",), ("zzz",), (None,)], "c string")
    assert [r[0] for r in cats.select(text.category_to_etf(F.col("c"))).collect()] == ["IGV", "XBI", "IGV", "IGV"]
    q = text.quarter_ends(spark.sql("select date'2020-02-01' a, date'2020-08-01' b"), "a", "b")
    assert [str(r[0]) for r in q.collect()] == ["2020-03-31", "2020-06-30", "2020-09-30"]


def test_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("This file\n\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n200001, 1.00,-2.00,3,4,5,0.1\n200002  1 2 3 4 5 0.2\n200003,1,2\n2000,1,2,3,4,5,6\n")
    f = files.read_factors(spark, str(tmp_path / "f.txt")).orderBy("date").collect()
    assert [(str(r.date), r.mkt, r.rf) for r in f] == [("2000-01-31", 0.01, 0.001), ("2000-02-29", 0.01, 0.002)]
    (tmp_path / "a.csv").write_text("id,n\nx,1\ny,oops\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv"), "id string, n int").count() == 2
    c = files.Catalog(spark, {"a": "id string, n int", "b": "z int"}, [str(tmp_path / "none"), str(tmp_path)])
    assert c.table("a", id="x").first().n == 1 and c.table("b").count() == 0 and c.table("a", order=["n"], limit=1, id=["x", "z"]).count() == 1
    with pytest.raises(KeyError):
        c.table("nope")
    feed = tmp_path / "feed"
    feed.mkdir()
    items = "".join(f"<item><title>T{i} funding</title><link>l{i}</link><description>d</description><pubDate>x</pubDate></item>" for i in range(4))
    (feed / "one.xml").write_text(f"<rss><channel>{items}<item><title>weather</title></item></channel></rss>")
    got = files.read_feed(spark, str(feed), keywords=["funding"], per_source=3).collect()
    assert len(got) == 3 and got[0].source == "one.xml"
    old = spark.createDataFrame([("a", None, 1), ("b", "k", 2)], "x string, y string, v int")
    new = spark.createDataFrame([("a", None, 5), ("a", None, 4), ("c", "k", 3)], "x string, y string, v int")
    assert sorted(map(tuple, files.upsert(old, new, ["x", "y"]).collect())) == [("a", None, 5), ("b", "k", 2), ("c", "k", 3)]
    path = str(tmp_path / "t.parquet")
    files.upsert_path(spark, path, old, ["x", "y"])
    files.upsert_path(spark, path, new, ["x", "y"])
    assert sorted(map(tuple, files.read_upserted(spark, path).collect())) == [("a", None, 5), ("b", "k", 2), ("c", "k", 3)]
    files.upsert_path(spark, path, new.limit(0), ["x", "y"])
    with pytest.raises(Exception):
        files.upsert_path(spark, path, new.withColumn("v", F.raise_error(F.lit("broken")).cast("int")), ["x", "y"])
    assert files.read_upserted(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_upserted(spark, path + "-none")
    files.write_bundle({"a": old, "b": new.limit(0)}, str(tmp_path / "o.json"))
    assert len(pd.read_json(tmp_path / "o.json", typ="series")["a"]) == 2
    assert files.file_hashes(spark, str(tmp_path / "f.txt")).first().length > 0
    assert files.random_graph(spark, 20, 1.0).count() == 380


def test_live_silences_and_scores(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("I1", "C1", "S", " Series-A ", t(1)), ("I2", "C1", "S", "series-a", t(1)), ("i1", "c1", None, "series-b", t(5)), ("I1", "C2", "S", "series-a", t(2)), ("I1", "C3", "S", "series-a", t(20)), (None, "C1", "S", "series-a", t(1)), ("I1", None, "S", "series-a", t(1))]
    e = spark.createDataFrame(rows, "investor_name string, company_name string, sector string, round_type string, announced_at timestamp")
    s = signals.live_silences(e, spark.createDataFrame([("I1",), ("I2",)], "investor_name string"), "2024-01-21", overdue_days=10)
    got = {(r.investor_name, r.company_name): (r.series_b_occurred, r.is_silent) for r in s.collect()}
    assert got == {("I1", "C1"): (True, False), ("I2", "C1"): (True, True), ("I1", "C2"): (False, True)}
    base = spark.createDataFrame([("S", 0.1, 0.05)], "sector string, mean double, sigma double")
    sc = signals.live_scores(s, base, "2024-01-21")
    assert sc.first().deviation_sigma == round((2 / 3 - 0.1) / 0.05, 4)
    assert signals.alerts(sc, s).first().contributing_investors == "I2|I1" or signals.alerts(sc, s).first().contributing_investors == "I1|I2"


def test_streams_agree_with_their_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(base, "C1", "I1", "series-a"), (base, "C1", "I2", "series-a"), (base + dt.timedelta(days=2), "C1", "I2", "series-b"), (base + dt.timedelta(days=1), "C2", "I1", "series-a"), (base + dt.timedelta(days=30), "C9", "I9", "series-b")]
    src = tmp_path / "src"
    spark.createDataFrame(rows, "ts timestamp, company string, investor string, kind string").coalesce(1).write.parquet(str(src))
    stream = live.read_events(spark, str(src), "ts timestamp, company string, investor string, kind string")
    seats = stream.withColumns({"sector": F.lit("S"), "is_silent": F.col("kind") == "series-a"})
    q = live.sliding_scores(seats, "10 days", "5 days").writeStream.format("memory").queryName("scores").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    got = {(r.window_end, r.n_expected) for r in spark.table("scores").collect()}
    want = {(r["window"]["end"], r["n"]) for r in spark.read.parquet(str(src)).groupBy(F.window("ts", "10 days", "5 days")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and got <= want
    live.run_once(live.deduplicated(stream, ["company", "investor", "kind"]), str(tmp_path / "sink.parquet"), str(tmp_path / "c2"), ["company", "investor", "kind"])
    assert files.read_upserted(spark, str(tmp_path / "sink.parquet")).count() == 5


def test_pending_silences(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    src = tmp_path / "src"
    schema = "ts timestamp, company string, investor string, kind string"
    first = [(base, "C1", "I1", "series-a"), (base, "C1", "I2", "series-a"), (base + dt.timedelta(days=2), "C1", "I2", "series-b"), (base + dt.timedelta(days=1), "C2", "I1", "series-a")]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(str(src))
    spark.createDataFrame([(base + dt.timedelta(days=30), "C9", "I9", "series-b")], schema).coalesce(1).write.mode("append").parquet(str(src))
    s = live.pending_silences(live.read_events(spark, str(src), schema, per_trigger=1), overdue_days=5)
    q = s.writeStream.format("memory").queryName("pending").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {(r.company, r.investor): r.is_silent for r in spark.table("pending").collect()}
    assert got == {("C1", "I1"): True, ("C1", "I2"): False, ("C2", "I1"): True}
