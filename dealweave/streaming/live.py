"""The live pipeline on Structured Streaming: ingest, pending silences, sliding scores, alerts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from dealweave.sources.files import upsert_path


def read_events(spark: SparkSession, path: str, schema: str, per_trigger: int = 16, names: str = "*") -> DataFrame:
    """Events from files as they are dropped into a folder, those whose names match; ts becomes an instant."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", names).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; NULL in a key counts as a value."""
    safe = events.withWatermark("ts", late).withColumns({f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for i, k in enumerate(keys)})
    return safe.dropDuplicatesWithinWatermark([f"_k{i}" for i in range(len(keys))]).drop(*[f"_k{i}" for i in range(len(keys))])


def sliding_scores(seats: DataFrame, window: str = "90 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_end, sector, n_expected, n_silent, sms_score) over sliding windows of seats (ts, sector, is_silent)."""
    g = seats.withWatermark("ts", late).groupBy(F.window("ts", window, step), "sector").agg(F.count(F.lit(1)).alias("n_expected"), F.sum(F.col("is_silent").cast("int")).alias("n_silent"))
    return g.select(F.col("window.end").alias("window_end"), "sector", "n_expected", "n_silent", (F.col("n_silent") / F.col("n_expected")).alias("sms_score"))


def alerts(scores: DataFrame, base: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Scores that deviate from a static baseline (sector, mean, sigma) by more than the threshold."""
    j = scores.join(base, "sector", "left").withColumn("deviation_sigma", (F.col("sms_score") - F.coalesce("mean", F.lit(0.25))) / F.greatest(F.coalesce("sigma", F.lit(0.1)), F.lit(1e-6)))
    return j.filter(F.col("deviation_sigma") > threshold)


def run_once(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Takes in all that is there and ends: each micro-batch is upserted by key, so a batch that is replayed changes nothing."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: upsert_path(df.sparkSession, path, df, keys)).start()
    q.awaitTermination()


SEAT = "company string, investor string, series_a timestamp, series_b timestamp, is_silent boolean"


def pending_silences(events: DataFrame, overdue_days: float, late: str = "1 hour") -> DataFrame:
    """(company, investor, series_a, series_b, is_silent) of events (ts, company, investor, kind), each seat told once its time is over.

    Per company the first time of each investor in an earlier and in a later round is kept; a seat of the earlier round is judged once the
    watermark has passed its overdue time, by what came until then.
    """
    wait = int(overdue_days * 86_400_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"first": {}, "later": {}, "told": []}
        for pdf in batches:
            for investor, kind, ts in zip(pdf["investor"], pdf["kind"], pdf["ts"]):
                if investor is not None:
                    seen, ms = kept["first" if kind == "series-a" else "later"], int(pd.Timestamp(ts).timestamp() * 1000)
                    seen[investor] = min(ms, seen.get(investor, ms))
        now, out, told = state.getCurrentWatermarkMs(), [], set(kept["told"])
        came = min(kept["later"].values(), default=None)
        for investor, ms in sorted(kept["first"].items()):
            if ms + wait <= now and investor not in told:
                out.append((key[0], investor, pd.Timestamp(ms, unit="ms"), None if came is None else pd.Timestamp(came, unit="ms"), investor not in kept["later"]))
                told.add(investor)
        kept["told"] = sorted(told)
        state.update((json.dumps(kept),))
        due = [ms + wait for investor, ms in kept["first"].items() if investor not in told]
        if due:
            state.setTimeoutTimestamp(max(min(due), now + 1))
        if out:
            yield pd.DataFrame(out, columns=["company", "investor", "series_a", "series_b", "is_silent"])

    return events.withWatermark("ts", late).groupBy("company").applyInPandasWithState(step, SEAT, "kept string", "append", "EventTimeTimeout")
