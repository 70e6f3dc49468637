"""The evidence rules over Structured Streaming sources.

Sinks write one directory per batch, replaced when a batch is replayed, so restarts are idempotent; the
current state is a merge on read that combines map-side.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corrobora.functions import exprs as X, vocab as V
from corrobora.operators.evidence import family_bits, is_model
from corrobora.operators.people import screen
from corrobora.sources.tables import upsert_raw
from corrobora.streaming.ledgers import credibility_segments, fold_segments


def read_table(spark: SparkSession, folder: str, name: str, schema, per_trigger: int | None = None) -> DataFrame:
    """File stream over one table's files with an explicit schema; the table is a file of the folder, or a folder in it."""
    r = spark.readStream.schema(schema)
    if per_trigger is not None:
        r = r.option("maxFilesPerTrigger", per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(path) and fs.getFileStatus(path).isDirectory():
        return r.parquet(f"{folder}/{name}.parquet")
    return r.option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def with_event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; the session runs in UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def split_undated(df: DataFrame, col: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(dated, undated): rows without event time are kept aside, never dropped by a watermark."""
    return df.filter(F.col(col).isNotNull()), df.filter(F.col(col).isNull())


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append"):
    """Process what is available and stop; a restart with the same checkpoint continues where it ended."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).foreachBatch(each).start())
    q.awaitTermination()
    return q


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def read_sink(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches with their ``batch_id``; empty when nothing arrived."""
    fields = [f for f in schema.fields if f.name != "batch_id"]
    return spark.read.schema(T.StructType([*fields, T.StructField("batch_id", T.LongType())])).parquet(path)


# --- de-duplication, evidence, mix -----------------------------------------------------------------
def dedupe_stream(s: DataFrame, keys: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """One row per key within the delay; state is dropped when the watermark passes."""
    return s.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tier_stream(assertions: DataFrame, ts: str | None = None, delay: str | None = None) -> DataFrame:
    """Running evidence per claim (update mode): combinable counters only, so tiers can only rise and a
    contest, once seen, stays. With ``ts`` and ``delay`` the memory of seen sources expires."""
    keys = ["claim_id", "source_id", "source_type", "contra"]
    flagged = assertions.withColumn("contra", F.coalesce(F.col("stance") == "contradict", F.lit(False)))
    once = flagged.dropDuplicates(keys) if ts is None else dedupe_stream(flagged, keys, delay, ts)
    model, agree = is_model(F.col("source_type")), ~F.col("contra")
    per = once.groupBy("claim_id").agg(
        F.count_if(~model & agree).alias("n_other"), F.max((model & agree).cast("long")).alias("n_model"),
        F.bit_or(family_bits(F.col("source_type"))).alias("fam"), F.max(F.col("source_type").isNotNull()).alias("typed"),
        F.max(F.col("contra").cast("int")).alias("c"))
    weight = F.col("n_other") + F.col("n_model")
    tier = F.when(F.col("c") == 1, V.CONTESTED).otherwise(X.gated_tier(weight, F.when(F.col("typed"), F.bit_count("fam"))))
    return per.select("claim_id", "c", tier.alias("confidence_tier"))


def mix_stream(s: DataFrame, window: str, delay: str = "1 hour", lane: str = "lane", score: str = "score", ts: str = "ts") -> DataFrame:
    """Per tumbling window and lane: rows and how many were novel."""
    return (s.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), F.col(lane).alias("lane"))
            .agg(F.count("*").alias("n"), F.count_if(X.novelty_tier(F.col(score)) == "novel").alias("novel"))
            .select(F.col("w.start").alias("start"), "lane", "n", "novel",
                    (F.col("novel") / F.col("n") < V.SATURATION_NOVEL).alias("saturated")))


def latest(state: DataFrame, keys: list[str]) -> DataFrame:
    """Current row per key of an update-mode sink."""
    rest = [c for c in state.columns if c not in (*keys, "batch_id")]
    return state.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


# --- ledgers and upserts ---------------------------------------------------------------------------
def credibility_stream(events: DataFrame, path: str, checkpoint: str):
    """Every batch is folded to one segment per domain and chunk; events count in arrival order."""
    def each(batch: DataFrame, batch_id: int) -> None:
        credibility_segments(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return run_batches(events, checkpoint, each)


def credibility_scores(spark: SparkSession, path: str) -> DataFrame:
    from corrobora.streaming.ledgers import SEGMENT
    segments = spark.read.schema(SEGMENT + ", batch_id long").parquet(path)
    return fold_segments(segments, ["batch_id", "first_ts", "first_id"])


def raw_sink(rows: DataFrame, path: str, checkpoint: str):
    """Append raw-source batches; within a batch only the latest text per key is written."""
    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_raw(batch, batch.limit(0)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return run_batches(rows, checkpoint, each)


def read_raw(spark: SparkSession, path: str, schema) -> DataFrame:
    rows = spark.read.schema(schema).parquet(path)
    return upsert_raw(rows, rows.limit(0))


def screen_stream(findings: DataFrame, cards: DataFrame, path: str, checkpoint: str):
    """Identity screen of arriving findings against the static cards; both sides of the split are kept."""
    def each(batch: DataFrame, batch_id: int) -> None:
        kept, bad = screen(batch, cards)
        cols = ["finding_id", "name"]
        out = (kept.select(*cols, F.lit("kept").alias("side"), "reason")
               .union(bad.select(*cols, F.lit("quarantined"), "quarantine_reason")))
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return run_batches(findings, checkpoint, each)


# --- joins, sessions -------------------------------------------------------------------------------
def lead_answers(leads: DataFrame, findings: DataFrame, bound: str = "1 hour", delay: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Findings that arrive within ``bound`` after their lead was asked; ``leftOuter`` also reports silence."""
    a = leads.withWatermark("asked_at", delay)
    b = findings.withWatermark("found_at", delay)
    on = F.expr(f"lead_key = find_key AND found_at >= asked_at AND found_at <= asked_at + INTERVAL {bound}")
    return a.join(b, on, how)


def load_stream(log: DataFrame, size: str = "10 seconds", slide: str = "5 seconds", delay: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Requests per provider in sliding windows."""
    return (log.withWatermark(ts, delay).groupBy(F.window(ts, size, slide).alias("w"), "provider")
            .agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), "provider", "requests"))


def stall_sessions(s: DataFrame, gap_seconds: int = V.STALL_SECONDS, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Progress sessions per run; a new session starts after a silence longer than the gap."""
    return (s.withWatermark(ts, delay).groupBy(F.session_window(ts, f"{gap_seconds} seconds").alias("w"), "run_id")
            .agg(F.count("*").alias("beats"), F.max(ts).alias("last_beat")).select("run_id", F.col("w.start").alias("start"), "last_beat", "beats"))
