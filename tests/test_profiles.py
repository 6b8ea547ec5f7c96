import datetime as dt
import difflib
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from dealweave.operators import profiles
from dealweave.operators.ranking import placed
from dealweave.operators.signals import outcomes


def test_best_match_is_that_of_the_standard_library(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("bdgkmnrt") + rnd.choice("aeio") for _ in range(rnd.randint(1, 4))).title()
    known = sorted({f"{word()} {word()} {rnd.choice(['Partners', 'Capital', 'Fund'])}" for _ in range(120)} | {"Aa", "B", "Lantern", "lantern"})
    names = [None, "", "a", "B", "aa", "LANTERN", "x" * 3000]
    for k in known[:80]:
        i = rnd.randrange(len(k))
        names += [k.upper(), k[:i] + k[i + 1 :], k[:i] + "zz" + k[i:], k[: len(k) * 2 // 3], k[::-1]]
    df = spark.createDataFrame([(n,) for n in names + names[:5]], "typed string")
    u = spark.createDataFrame([(k, "x") for k in [*known, None, known[0]]], "name string, typed string")
    lower = {}
    for k in known:
        lower[k.lower()] = max(k, lower.get(k.lower(), ""))
    for cutoff in (0.78, 0.9):
        want = {}
        for n in {x for x in names if x is not None}:
            if n.lower() in lower:
                want[n] = (lower[n.lower()], 1.0)
            elif best := difflib.get_close_matches(n.lower(), list(lower), n=1, cutoff=cutoff):
                want[n] = (lower[best[0]], difflib.SequenceMatcher(None, n.lower(), best[0]).ratio())
        got = {r.name: (r.known, r.score) for r in profiles.best_match(df, u, name="typed", known="name", cutoff=cutoff).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert profiles.best_match(df.limit(0), u, name="typed", known="name").collect() == [] == profiles.best_match(df, u.limit(0), name="typed", known="name").collect()


def test_nothing_after_the_cutoff_passes(spark):
    d = lambda *x: spark.createDataFrame([(dt.date(*y) if y else None,) for y in x], "day date")
    assert profiles.only_until(d((2020, 1, 1), None), "day", "2020-01-01").count() == 2
    with pytest.raises(Exception, match="after 2020-01-01"):
        profiles.only_until(d((2020, 1, 1), (2020, 1, 2)), "day", "2020-01-01").collect()
    with pytest.raises(ValueError, match="every row"):
        profiles.only_until(d((2021, 1, 1)), "day", "2020-01-01")
    assert profiles.only_until(d(), "day", "2020-01-01").collect() == []


def test_canonical_json(spark):
    rows = [('a "quoted" \\ name', 3, None), ("é\n", -1, "x"), (None, None, "")]
    df = spark.createDataFrame(rows, "name string, n int, b string")
    got = [r[0] for r in df.select(profiles.canonical_json({"name": profiles.json_text(F.col("name")), "n": F.col("n").cast("string"), "b": profiles.json_text(F.col("b"))})).collect()]
    assert got == [json.dumps({"name": a, "n": n, "b": b}, sort_keys=True, ensure_ascii=False) for a, n, b in rows]


def test_track_record_and_receipts(spark):
    o = spark.createDataFrame([(30, True, 0.1), (30, False, -0.1), (30, True, 0.3), (90, True, 1.0)], "horizon_days int, direction_correct boolean, excess double")
    assert sorted(map(tuple, profiles.track_record(o).collect())) == [(30, 3, pytest.approx(2 / 3), pytest.approx(0.1)), (90, 1, None, None)]
    p = spark.createDataFrame([("A", dt.date(2020, 3, 31), 0.5, 4, "x|y", 0.25, 0.1, -0.2, None), ("B", dt.date(2020, 3, 31), 0.1, 4, "", 0.0, 1.0, 1.0, 1.0)], "sector string, eval_date date, value double, n_top_tier int, names string, mean_tps double, k6 double, k12 double, k24 double")
    s, out = profiles.seed_signals(p, "v1", threshold=0.3, least_tier=3, horizons={30: "k6", 90: "k12", 180: "k24"})
    r = s.collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    given = sha(json.dumps({"sector": "A", "eval_date": "2020-03-31", "sms_value": 0.5, "n_top_tier": 4}, sort_keys=True))
    told = sha(json.dumps({"direction": "NEGATIVE_ALPHA", "top_investors": ["x", "y"]}, sort_keys=True))
    assert len(r) == 1 and (r[0].input_sha256, r[0].output_sha256) == (given, told) and r[0].receipt_sha256 == sha(f"v1{given}{told}2020-03-31T00:00:00+00:00")
    assert sorted((x.horizon_days, x.direction_correct) for x in out.collect()) == [(30, False), (90, True)]


def test_places_over_all_rows(spark):
    rnd = random.Random(3)
    values = [rnd.choice([1.0, 2.0, 2.0, 5.0, None, rnd.random()]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = placed(df, [F.desc("v"), F.col("id")], row="row", total="n").collect()
    order = sorted(range(300), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert {r.id: r.row for r in got} == {i: k for k, i in enumerate(order, 1)} and {r.n for r in got} == {300}
    ranks = {r.id: r.rank for r in placed(df.filter("v is not null"), [F.desc("v")], rank="rank").collect()}
    assert all(ranks[i] == 1 + sum(w is not None and w > v for w in values) for i, v in enumerate(values) if v is not None)
    assert placed(df.limit(0), [F.col("v")], row="row").collect() == []


def test_outcomes_by_the_nearest_prices(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    prices = [("T", day(2), 10.0), ("T", day(5), 12.0), ("T", day(40), 5.0), ("S", day(0), 100.0), ("S", day(10), 110.0)]
    p = spark.createDataFrame(prices, "ticker string, day date, close double")
    s = spark.createDataFrame([(1, "T", day(0)), (2, "T", day(6)), (3, "S", day(0)), (4, "none", day(0)), (5, "T", day(2))], "signal_id long, ticker string, issued_on date")
    got = {(r.signal_id, r.horizon_days): (round(r.ret, 6), round(r.benchmark_ret, 6)) for r in outcomes(s, p, "S", (10, 5)).collect()}
    assert got == {(1, 10): (0.2, 0.1), (1, 5): (0.2, 0.0), (3, 10): (0.1, 0.1), (3, 5): (0.0, 0.0), (5, 10): (0.2, 0.0)}


def test_exits_and_thinned(spark):
    held = spark.createDataFrame([("i", "c1"), ("i", "c1"), ("i", "c2"), ("j", "c9"), ("j", None)], "k string, company_id string")
    c = spark.createDataFrame([("c1", "ipo"), ("c1", "ipo"), ("c2", "acquired"), ("c3", "ipo")], "id string, status string")
    assert sorted(map(tuple, profiles.exits(held, c, "k").collect())) == [("i", 2, 1, 1, 100.0), ("j", 1, 0, 0, 0.0)]
    t = profiles.thinned(spark.createDataFrame([("a", k) for k in range(7)], "k string, n int"), ["k"], ["n"], 3)
    assert [r.n for r in t.orderBy("n").collect()] == [0, 3, 6]


def test_letters_in_common_bound_the_matching_ratio():
    rnd = random.Random(3)
    xs, ys = (["".join(rnd.choice("abcd é") for _ in range(rnd.randint(0, 12))) for _ in range(40)] for _ in range(2))
    both = profiles.letters_ratio(xs, ys)
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            assert both[i, j] >= difflib.SequenceMatcher(None, y, x).ratio() - 1e-6
    want = {(x, y) for x in xs for y in ys if difflib.SequenceMatcher(None, y, x).ratio() >= 0.78}
    assert {(x, y) for x, y, _, _ in profiles._alike(xs, ys, 0.78)} == want
