"""Attributes as they were known at an event's time.

Each version row of an entity has a time from which it holds (valid_from) and a time at which it became visible
(visible_at). It is usable from the later of both. The state known at time t is, among usable versions, the one of the latest
valid_from, then the latest visible_at, then the smallest version id. That is a running maximum over the change log,
so it can be cut into periods: the state at a period's start (the snapshot) is the maximum over all earlier periods, and
an event needs only its period's snapshot and the changes inside that period.

The snapshots are a table (snapshot_table) that can be kept and brought up to date with new versions alone; as_known reads it and replays only the
changes of the events' own periods.

Work is split by (entity, period), and a group with very many events is salted, so a hot entity spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.session import written

DAY_US = 86_400_000_000


def _log(versions: DataFrame, entity: str, version_id: str, valid_from: str, visible_at: str, attributes: Sequence[str], period_days: int) -> DataFrame:
    """(_k, _p, _t, _s): each usable version with its state and the time and period from which it counts."""
    v = versions.select(
        F.col(entity).alias("_k"),
        F.struct(
            _micros(versions, valid_from).alias("valid"),
            _micros(versions, visible_at).alias("seen"),
            (-F.col(version_id)).alias("less"),
            F.col(version_id).alias("vid"),
            *[F.col(a).alias(f"a{i}") for i, a in enumerate(attributes)],
        ).alias("_s"),
    ).filter("_k is not null and _s.valid is not null and _s.seen is not null and _s.vid is not null")
    v = v.withColumn("_t", F.greatest("_s.valid", "_s.seen"))
    return v.select("_k", F.floor(F.col("_t") / F.lit(period_days * DAY_US)).cast("int").alias("_p"), "_t", "_s")


def snapshot_table(
    versions: DataFrame, *, entity: str, version_id: str, valid_from: str, visible_at: str, attributes: Sequence[str], period_days: int = 91, before: DataFrame | None = None
) -> DataFrame:
    """(_k, _p, _s): the state of each entity at the end of each period in which it changed; a written table, for as_known.

    before is an earlier such table: versions then need only hold what was published since, and only entities with new versions get new states.
    """
    new = _log(versions, entity, version_id, valid_from, visible_at, attributes, period_days).groupBy("_k", "_p").agg(F.max("_s").alias("_s"))
    if before is not None:
        touched = before.join(new.select("_k").distinct(), "_k", "left_semi")
        new = new.unionByName(touched).groupBy("_k", "_p").agg(F.max("_s").alias("_s"))
    w = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    state = new.withColumn("_s", F.max("_s").over(w))
    if before is not None:
        state = state.unionByName(before.join(new.select("_k").distinct(), "_k", "left_anti"))
    return written(state, "snapshots")


def as_known(
    events: DataFrame,
    versions: DataFrame,
    *,
    event_id: str,
    event_time: str,
    entity: str,
    version_id: str,
    valid_from: str,
    visible_at: str,
    attributes: Sequence[str],
    period_days: int = 91,
    salt_rows: int = 200_000,
    snapshots: DataFrame | None = None,
) -> DataFrame:
    """One row (event_id, version_id, *attributes) for each row of events, by the version in force and visible at its time.

    Null entity or time, or no version known by then: version_id and the attributes are NULL. Rows of versions with a NULL
    entity, valid_from, visible_at or version_id are never in force. Repeated event rows give repeated result rows; repeated
    version rows change nothing; ties go to the smaller version id. valid_from may be a date (00:00 UTC) or a timestamp. Other
    columns of either table, whatever their names, are ignored. An empty table of versions gives NULLs, one of events no rows.
    snapshots is the snapshot_table of versions by the same columns and period_days; without it, it is made and written first.
    """
    log = dict(entity=entity, version_id=version_id, valid_from=valid_from, visible_at=visible_at, attributes=attributes, period_days=period_days)
    kept = snapshot_table(versions, **log) if snapshots is None else snapshots
    period = lambda t: F.floor(t / F.lit(period_days * DAY_US)).cast("int")
    e = events.select(
        F.col(event_id).alias("_id"), F.col(entity).alias("_k"), _micros(events, event_time).alias("_t")
    )
    usable = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    timed = e.filter(usable).withColumn("_p", period(F.col("_t")))

    v = _log(versions, **log)
    # The snapshot before each period that some event falls in: the last one kept of an earlier period.
    asked = timed.groupBy("_k", "_p").agg(F.count(F.lit(1)).alias("_n"))
    none = F.lit(None).cast(v.schema["_s"].dataType)
    starting = (
        kept.withColumn("_n", F.lit(None).cast("long"))
        .unionByName(asked.withColumn("_s", none))
        .groupBy("_k", "_p")
        .agg(F.max("_s").alias("_s"), F.max("_n").alias("_n"))
        .withColumn("_s", F.max("_s").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
        .filter("_n is not null")
        .withColumn("_salts", F.ceil(F.col("_n") / F.lit(salt_rows)).cast("int"))
        .select("_k", "_p", "_s", "_salts")
    )
    starting = written(starting, "starts")
    salts = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")
    starts = starting.filter("_s is not null").select("_k", "_p", salts, F.lit(None).cast("long").alias("_t"), "_s")
    changes = v.join(starting.select("_k", "_p", "_salts"), ["_k", "_p"]).select("_k", "_p", salts, "_t", "_s")
    hot = starting.filter("_salts > 1").select("_k", "_p", "_salts")
    asking = timed.join(hot, ["_k", "_p"], "left").select(
        "_k",
        "_p",
        F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id", "_t"), F.col("_salts"))).cast("int").alias("_salt"),
        "_t",
        none.alias("_s"),
        "_id",
    )
    replay = starts.unionByName(changes).withColumn("_id", F.lit(None).cast(e.schema["_id"].dataType)).withColumn("_ask", F.lit(0))
    w = Window.partitionBy("_k", "_p", "_salt").orderBy(F.col("_t").asc_nulls_first(), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    known = replay.unionByName(asking.withColumn("_ask", F.lit(1))).withColumn("_s", F.max("_s").over(w)).filter("_ask = 1").select("_id", "_s")
    rest = e.filter(~usable).select("_id", none.alias("_s"))
    return known.unionByName(rest).select(
        F.col("_id").alias(event_id),
        F.col("_s.vid").alias(version_id),
        *[F.col(f"_s.a{i}").alias(a) for i, a in enumerate(attributes)],
    )


def _micros(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind == "date":
        return F.unix_date(name).cast("long") * DAY_US
    if kind == "timestamp_ntz":
        at = F.col(name)
        return F.unix_date(at.cast("date")).cast("long") * DAY_US + F.expr(
            f"(hour(`{name}`) * 3600L + minute(`{name}`) * 60L) * 1000000L + cast(extract(second from `{name}`) * 1000000 as bigint)"
        )
    return F.unix_micros(name)
