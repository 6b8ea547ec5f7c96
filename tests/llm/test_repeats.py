import datetime as dt
import random

from dealweave.llm.repeats import Deliveries, entity_keys, points

DAY = 86_400_000_000
NEWS = [
    (1, "Budrofikemu Tundra", None, 10 * DAY),
    (2, "Budrofigemu Tundra", None, 11 * DAY),  # a consonant mistyped, nobody named
    (3, "Kazihenatof Compass", "Velmorrin Lantern Partners", 40 * DAY),
    (4, "Kazihematof Compass", "Velmortin Lantern Partners", 41 * DAY),  # both mistyped
    (5, "Hollugimokus Ember", "Dojavetuth Canyon Growth", 70 * DAY),
    (6, "Hollugimotus Ember", "Dojavetuth Canyon Growth", None),  # mistyped, and no time
    (7, "Budrofigemu Tundra", None, 90 * DAY),  # long after
    (8, "Gromebrefuta Ember", None, 11 * DAY),  # another company
]


def test_near_names_meet_without_investor_or_time(spark):
    rows = [(i, c, None, v, None, "series-a", None, t, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i)) for i, c, v, t in NEWS]
    d = spark.createDataFrame(rows, "id long, c string, ci string, v string, vi string, r string, u string, t long, at timestamp")
    none = entity_keys(spark.createDataFrame([], "id string, name string"), entity_id="id", name="name")
    run = Deliveries(spark)
    run.accept(*points(d, none, row_id="id", company="c", company_id="ci", investor="v", investor_id="vi", round_type="r", url="u", time_us="t", arrived="at"))
    assert {tuple(x) for x in run.repeats().collect()} == {(1, 2), (3, 4), (5, 6)}


def deliveries(spark, parts):
    none = entity_keys(spark.createDataFrame([], "id string, name string"), entity_id="id", name="name")
    run = Deliveries(spark)
    for rows in parts:
        d = spark.createDataFrame(rows, "id long, c string, ci string, v string, vi string, r string, u string, t long, at timestamp")
        run.accept(*points(d, none, row_id="id", company="c", company_id="ci", investor="v", investor_id="vi", round_type="r", url="u", time_us="t", arrived="at"))
    return {tuple(x) for x in run.repeats().collect()}


def news(i, c, t, r="series-a"):
    return (i, c, None, None, None, r, None, t, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i))


def test_a_row_without_time_is_met_by_a_later_delivery_of_known_skeletons(spark):
    first = [news(1, "Budrofikemu Tundra", None), news(2, "Kazihenatof Compass", 200 * DAY), news(3, "Hollugimokus Ember", None)]
    second = [news(4, "Budrofikemu Tundra", 60 * DAY), news(5, "Kazihenatof Compass", 400 * DAY), news(8, "Hollugimokus Ember", 500 * DAY, "seed")]
    assert deliveries(spark, [first, second]) == {(1, 4)} == deliveries(spark, [[*first, *second]])
    # All skeletons are known here, of rows with and without a time.
    third = [news(9, "Kazihenatof Compass", None), news(10, "Hollugimokus Ember", 90 * DAY)]
    assert deliveries(spark, [first, second, third]) == deliveries(spark, [[*first, *second, *third]]) == {(1, 4), (3, 10), (5, 9)}


def test_cells_of_time_meet_at_their_edges(spark):
    edges = [x for k in range(1, 5) for x in (30 * k * DAY - DAY, 30 * k * DAY + DAY, 30 * k * DAY + 7 * DAY)]
    got = deliveries(spark, [[news(i, "Budrofikemu Tundra", t) for i, t in enumerate(edges, 1)]])
    assert got == {(1 + 3 * k, 2 + 3 * k) for k in range(4)}


def test_points_are_shuffled_few_times(spark):
    # Each row is shuffled once for each join and once for all its comparisons, not by window, and in few columns.
    rnd = random.Random(3)
    name = lambda: "".join(rnd.choice("bdgkmnrtvz") + rnd.choice("aeiou") for _ in range(5)).title() + " Tundra"
    names = [name() for _ in range(6000)]
    rows = [(i, n, None, name(), None, "series-a", None, rnd.randrange(2000) * DAY + rnd.randrange(DAY), dt.datetime(2020, 1, 1)) for i, n in enumerate(names, 1)]
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = sent()
    deliveries(spark, [rows[:3000], rows[3000:]])
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sent() - before < 350 * len(rows)
