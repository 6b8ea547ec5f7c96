import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealweave.operators import signals


def test_swarm_keeps_its_score_unrounded(spark):
    day = dt.date(2020, 3, 1)
    entries = spark.createDataFrame([(f"i{k}", "s", day) for k in range(5)], "investor_name string, sector string, first_entry_date date")
    panel = spark.createDataFrame([(dt.date(2020, 3, 31), "i0", 0.1234994999, True)], "eval_date date, investor string, tps double, in_top_tier boolean")
    s = signals.swarm(panel, entries).withColumn("six", F.round("ssi", 6)).first()
    assert s.ssi == pytest.approx(0.1234994999, abs=1e-12) and s.six == 0.123499 and s.n_entrants == 5


def test_event_panel_reads_the_swarm_from_a_table(spark):
    from dealweave.plans.signals import ssi_event_panel

    plan = ssi_event_panel(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 5 and "swarm-" in "".join(ssi_event_panel(spark, "/root/testdata/sf0.001").inputFiles())
