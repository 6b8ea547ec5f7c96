import datetime as dt
import os
import time

from dealweave.operators import prescience
from dealweave.session import dropped, written


def test_nodes_of_equal_weight_are_of_one_tier(spark):
    day = dt.date(2020, 1, 1)
    rows = [(f"s{k}", "many", f"c{k}", 0.1, day) for k in range(10)] + [(f"t{k}", "few", f"d{k}", 0.5, day) for k in range(2)] + [("u", "one", "e", 1.0, day)]
    edges = spark.createDataFrame(rows, "source string, target string, company string, weight double, source_date date")
    dates = spark.createDataFrame([(dt.date(2019, 12, 31),), (day,), (dt.date(2020, 3, 31),)], "eval_date date")
    got = {(r.eval_date, r.investor): round(r.tps, 9) for r in prescience.expanding_scores(edges, dates, percentile=1.0).collect()}
    assert got == {(d, s): w for d in (day, dt.date(2020, 3, 31)) for s, _, _, w, _ in rows}


def test_dropped_tables_leave_no_files(spark):
    t = written(spark.range(10), "some")
    folder = os.path.dirname(t.inputFiles()[0].removeprefix("file://"))
    assert os.path.exists(folder)
    dropped(t)
    assert not os.path.exists(folder)


def test_scores_take_the_degrees_of_a_table(spark):
    from dealweave.operators.deals import assemble
    from dealweave.operators.graph import degrees

    edges = spark.createDataFrame([("a", "b", "c", 1.0), ("a", "d", "c", 0.5), ("b", "d", "e", 0.5)], "source string, target string, company string, weight double")
    deals = spark.createDataFrame([("a", "c"), ("b", "c"), ("d", "c"), ("b", "e"), ("d", "e")], "investor_name string, company_name string")
    known = written(degrees(assemble(edges)), "degrees")
    assert sorted(prescience.static_scores(edges, deals, known=known).collect()) == sorted(prescience.static_scores(edges, deals).collect()) != []


def test_edges_shuffle_their_deals_once_and_leave_out_what_has_no_company_or_round(spark):
    from pyspark.sql import functions as F

    from dealweave.operators.deals import temporal_edges

    d = [dt.date(2020, 1, k) for k in range(1, 9)]
    rows = [("a", "c", "series-a", d[3]), ("a", "c", "series-a", d[1]), ("b", "c", "series-a", d[5]), ("a", "c", "series-b", d[6]), ("e", "c", "series-b", d[7]), ("x", None, "series-a", d[0]), ("y", None, "series-b", d[1]), ("x", "c", None, d[0]), ("u", "n", "series-a", None), ("v", "n", "series-b", d[2]), ("v", "o", "series-a", d[2]), ("w", "o", "series-b", d[2])]
    deals = written(spark.createDataFrame(rows, "investor_name string, company_name string, funding_round_type string, funded_at date"), "deals")
    edges = temporal_edges(deals)
    got = sorted((r.source, r.target, r.company, r.source_date, r.target_date) for r in edges.collect())
    by_join = [("a", "e", "c", d[1], d[6]), ("b", "a", "c", d[1], d[6]), ("b", "e", "c", d[1], d[6]), ("u", "v", "n", None, d[2]), ("v", "w", "o", d[2], d[2])]
    assert [x[:3] for x in got] == [x[:3] for x in by_join] and [x for x in got if x[0] != "u"] == [x for x in by_join if x[0] != "u"]
    edges = temporal_edges(deals).select("source", "target", F.col("weight"))
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # one for each side of the join, and these are equal


def test_weights_beyond_an_int_keep_their_value(spark):
    day = dt.date(2020, 1, 1)
    edges = spark.createDataFrame([("s", "big", "c", 3000.0, day), ("t", "small", "d", 1.0, day)], "source string, target string, company string, weight double, source_date date")
    got = {r.investor: r.tps for r in prescience.expanding_scores(edges, spark.createDataFrame([(day,)], "eval_date date"), percentile=0.0).collect()}
    assert got["s"] == 3000.0 and abs(got["t"] - 1 / 3000) < 1e-12


def test_shuffle_files_of_an_ended_query_go_when_a_large_table_is_written(spark, monkeypatch):
    from dealweave import session

    monkeypatch.setattr(session, "COLLECT_BYTES", -1)
    status = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    session.collected(spark)
    time.sleep(1)
    before = status()
    for _ in range(5):
        written(spark.range(1000).repartition(3, "id"), "some")
    time.sleep(1)
    assert status() <= before
