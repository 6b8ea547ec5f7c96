"""Queries that run the live operators over the events table as a stream, to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.session import shared_dir
from dealweave.streaming import live

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _to_end(stream: DataFrame) -> DataFrame:
    """All that a stream gives on what is there now, through a table in the shared folder (exactly once by its checkpoint)."""
    at = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def _deals(spark: SparkSession, d: str) -> DataFrame:
    e = live.read_events(spark, d, EVENTS, names="events.parquet").filter("event_type in ('signup', 'purchase')")
    return e.select("event_id", "ts", F.concat(F.lit("I"), "user_id").alias("investor"), F.concat(F.lit("C"), F.get_json_object("props", "$.k")).alias("company"),
                    F.when(F.col("event_type") == "signup", "series-a").otherwise("series-b").alias("kind"), F.concat(F.lit("S"), F.pmod("user_id", F.lit(6))).alias("sector"))


def stm_sliding_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per sector and ten-day window, sliding by five: events and the share of first rounds; windows that the watermark closed."""
    s = live.sliding_scores(_deals(spark, d).withColumn("is_silent", F.col("kind") == "series-a"), "10 days", "5 days", "1 day")
    out = _to_end(s)
    return out.select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "sector", "n_expected", "n_silent", F.round("sms_score", 6).alias("sms_score"))


def stm_pending_silences(spark: SparkSession, d: str) -> DataFrame:
    """Seats of a first round, each told once its five days are over."""
    return _to_end(live.pending_silences(_deals(spark, d), overdue_days=5))


def stm_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Events once per (investor, company, kind) within the watermark."""
    return _to_end(live.deduplicated(_deals(spark, d), ["investor", "company", "kind"], "40 days")).select("investor", "company", "kind")


QUERIES = {f.__name__: f for f in (stm_sliding_scores, stm_pending_silences, stm_deduplicated)}

ORACLE = {
    "stm_deduplicated": "select distinct 'I' || user_id as investor, 'C' || json_extract_string(props, '$.k') as company, case event_type when 'signup' then 'series-a' else 'series-b' end as kind from events where event_type in ('signup', 'purchase')",
}
