"""Audits of progress and request logs over groups of any size."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora.functions import vocab as V
from corrobora.operators.ordering import previous, running_sum


def stalls(events: DataFrame, gap_seconds: float = V.STALL_SECONDS) -> DataFrame:
    """(run_id, event_id, gap): silences longer than the gap, found at the event that ended them."""
    rows = events.select("run_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    back = previous(rows, ["run_id"], ["us", "event_id"], "us", "before")
    gap = (F.col("us") - F.col("before")) / 1_000_000.0
    return back.withColumn("gap", gap).filter(F.col("gap") > gap_seconds).select("run_id", "event_id", F.round("gap", 3).alias("gap"))


def pacing_audit(log: DataFrame) -> DataFrame:
    """Per provider: requests, starts closer than its spacing, most in flight, starts beyond its limit.

    In-flight counts come from one sweep over starts and ends, never from comparing requests in pairs.
    """
    spark = log.sparkSession
    limits = spark.createDataFrame([(k, n, s) for k, (n, s) in V.PROVIDER_LIMITS.items()], "provider string, max_n int, spacing double")
    r = log.select("provider", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "duration_s")
    close = previous(r, ["provider"], ["us", "event_id"], "us", "before").withColumn("gap", (F.col("us") - F.col("before")) / 1_000_000.0)
    ends = F.col("us") + F.round(F.col("duration_s") * 1_000_000).cast("long")
    edges = r.select("provider", "event_id", F.inline(F.array(
        F.struct(F.col("us").alias("at"), F.lit(1).alias("step")), F.struct(ends.alias("at"), F.lit(-1).alias("step")))))
    flight = running_sum(edges, ["provider"], ["at", "step", "event_id"], "step", "in_flight").filter("step = 1")
    a = close.join(limits, "provider").groupBy("provider").agg(
        F.count("*").alias("requests"), F.count_if(F.col("gap") < F.col("spacing")).alias("too_close"))
    b = flight.join(limits, "provider").groupBy("provider").agg(
        F.max("in_flight").alias("max_in_flight"), F.count_if(F.col("in_flight") > F.col("max_n")).alias("over_limit"))
    return a.join(b, "provider")
