"""Streams over several shuffled files end where the batch computation ends."""
import tempfile

from pyspark.sql import functions as F

from corrobora.operators.evidence import evidence_tiers
from corrobora.plans.views import Tables
from corrobora.streaming import ledgers, streams as S

SF = "/root/testdata/sf0.001"


def split_files(spark, df, parts=4):
    folder = tempfile.mkdtemp(prefix="corrobora-test-")
    df.repartition(parts).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def out():
    base = tempfile.mkdtemp(prefix="corrobora-test-")
    return f"{base}/out", f"{base}/ck"


def test_tiers_equal_batch_and_never_fall(spark):
    a = Tables(spark, SF).v_assertions
    s = S.tier_stream(split_files(spark, a))
    path, ck = out()
    S.run_batches(s, ck, S.batch_sink(path), "update")
    state = S.read_sink(spark, path, s.schema)
    got = {r["claim_id"]: r["confidence_tier"] for r in S.latest(state, ["claim_id"]).collect()}
    assert got == {r["claim_id"]: r["confidence_tier"] for r in evidence_tiers(a).collect()}
    rank = {"Speculative": 0, "Moderately Accepted": 1, "Accepted": 2, "Controversial": 3}
    seen = {}
    for r in sorted(state.collect(), key=lambda r: r["batch_id"]):
        assert rank[r["confidence_tier"]] >= seen.get(r["claim_id"], 0)
        seen[r["claim_id"]] = rank[r["confidence_tier"]]


def test_credibility_stream_folds_in_arrival_order(spark):
    e = Tables(spark, SF).v_cred_events
    path, ck = out()
    S.credibility_stream(split_files(spark, e, 3), path, ck)
    n = {r["domain"]: r["n"] for r in S.credibility_scores(spark, path).collect()}
    assert n == {r["domain"]: r["n"] for r in ledgers.credibility_fold(e).collect()}


def test_dedupe_within_delay(spark):
    e = S.with_event_time(Tables(spark, SF).events)
    twice = e.unionByName(e).select("event_id", "user_id", "ts")
    path, ck = out()
    s = S.dedupe_stream(split_files(spark, twice), ["event_id"], "60 days")
    S.run_batches(s, ck, S.batch_sink(path))
    assert S.read_sink(spark, path, s.schema).count() == e.count()


def test_restart_emits_nothing_new_and_undated_rows_are_kept(spark):
    e = S.with_event_time(Tables(spark, SF).events).withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts")))
    dated, undated = S.split_undated(e)
    assert dated.count() + undated.count() == e.count() and undated.count() > 0
    src, (path, ck) = split_files(spark, e.select("event_id")), out()
    S.run_batches(src, ck, S.batch_sink(path))
    n = spark.read.parquet(path).count()
    S.run_batches(src, ck, S.batch_sink(path))
    assert spark.read.parquet(path).count() == n == e.count()


def test_lead_answers_outer_reports_silence(spark):
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (9, "2024-01-03 00:00:00")]
    found = [(1, "2024-01-01 00:30:00"), (2, "2024-01-01 05:00:00"), (8, "2024-01-03 00:00:00")]
    a = split_files(spark, spark.createDataFrame(rows, "lead_key int, asked_at string").withColumn("asked_at", F.to_timestamp("asked_at")), 1)
    b = split_files(spark, spark.createDataFrame(found, "find_key int, found_at string").withColumn("found_at", F.to_timestamp("found_at")), 1)
    j = S.lead_answers(a, b, "1 hour", "1 minute", "leftOuter")
    path, ck = out()
    S.run_batches(j, ck, S.batch_sink(path))
    got = {(r["lead_key"], r["find_key"]) for r in S.read_sink(spark, path, j.schema).collect()}
    assert (1, 1) in got and (2, None) in got and (2, 2) not in got


def test_stall_sessions_match_gaps(spark):
    e = S.with_event_time(Tables(spark, SF).events).select(F.col("user_id").alias("run_id"), "ts", "event_id")
    s = S.stall_sessions(split_files(spark, e, 1), 6 * 3600)
    path, ck = out()
    S.run_batches(s.withColumn("x", F.lit(1)), ck, S.batch_sink(path), "append")
    beats = spark.read.parquet(path).agg(F.sum("beats")).first()[0] or 0
    assert 0 < beats <= e.count()


def test_a_table_that_is_a_folder_of_files_streams_whole(spark, tmp_path):
    whole = spark.range(40).select(F.col("id").alias("doc_id"))
    whole.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(5).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/pages.parquet")
    s = S.read_table(spark, str(tmp_path), "documents", whole.schema)
    S.run_batches(s, f"{tmp_path}/ck", S.batch_sink(f"{tmp_path}/out"))
    assert sorted(r["doc_id"] for r in S.read_sink(spark, f"{tmp_path}/out", s.schema).collect()) == list(range(40))
