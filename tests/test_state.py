"""Stateful processors and compacted sinks: equal to the batch form, bounded, and safe to stop anywhere."""
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.operators.evidence import evidence_tiers
from corrobora.streaming import ledgers as G, sinks as K, state as ST, streams as S


def folders():
    base = tempfile.mkdtemp(prefix="corrobora-test-")
    return f"{base}/out", f"{base}/ck"


def arriving(spark, df, parts, order):
    """A stream that takes one file a batch, in the order of ``order``."""
    folder = tempfile.mkdtemp(prefix="corrobora-test-")
    for i in range(parts):
        df.filter(F.col(order) == i).drop(order).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03}")
    return spark.readStream.schema(df.drop(order).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_composed_runs_equal_walking():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        run, moves = np.sort(rng.integers(0, 5, n)), rng.integers(-3, 4, n) * 50
        steps = list(zip(*G.runs_composed(run, moves)))
        for (shift, lo, hi), r in zip(steps, np.unique(run)):
            for x in (50, 500, 930):
                want = x
                for m in moves[run == r]:
                    want = min(G._HI, max(G._LO, want + m))
                assert min(hi, max(lo, x + shift)) == want
    assert G.compose(np.zeros(0, np.int64)) == (0, -G._NO, G._NO)


@pytest.fixture(scope="module")
def assertions(spark):
    rng = random.Random(3)
    kinds = ["llm", "web", "youtube", "podcast", None]
    rows = [(None if rng.random() < 0.05 else rng.randrange(12) if rng.random() < 0.7 else 0, rng.randrange(6), rng.choice(kinds),
             rng.choice(["agree", "agree", "agree", None, "contradict" if rng.random() < 0.1 else "agree"]),
             f"2024-01-{1 + i // 20:02} {i % 20:02}:00:00", min(3, i // 75)) for i in range(300)]
    return spark.createDataFrame(rows, "claim_id int, source_id int, source_type string, stance string, ts string, part int").withColumn("ts", F.to_timestamp("ts"))


@pytest.mark.parametrize("timed", [True, False])
def test_tier_state_equals_batch_and_emits_changes_only(spark, assertions, timed):
    s = arriving(spark, assertions, 4, "part")
    changes = ST.tier_changes(s, *(("ts", "100 days", "100 days") if timed else ()))
    out, ck = folders()
    sink = K.CompactedSink(spark, out, changes.schema, K.latest_by("claim_id"))
    with ST.rocksdb(spark):
        S.run_batches(changes, ck, sink.write)
        seen = sink.current()
        got = {r["claim_id"]: r["confidence_tier"] for r in seen.collect()}
        assert got == {r["claim_id"]: r["confidence_tier"] for r in evidence_tiers(assertions).collect()} and None in got
        before = len(sink.files.names("deltas"))
        S.run_batches(changes, ck, sink.write)                  # a restart with nothing new
    assert sink.current().count() == len(got) and {r["claim_id"]: r["batch_id"] for r in sink.current().collect()} == {r["claim_id"]: r["batch_id"] for r in seen.collect()}
    assert len(sink.files.names("deltas")) <= before + 1


def test_quiet_claims_are_forgotten_and_begin_anew(spark):
    rows = [(1, 1, "web", "agree", "2024-01-01", 0), (1, 2, "web", "agree", "2024-01-01", 0), (2, 9, "web", "agree", "2024-02-01", 1),
            (3, 9, "web", "agree", "2024-02-02", 2), (1, 3, "podcast", "agree", "2024-02-02", 3), (4, 9, "web", "agree", "2024-02-02", 4)]
    df = spark.createDataFrame(rows, "claim_id int, source_id int, source_type string, stance string, ts string, part int").withColumn("ts", F.to_timestamp("ts"))
    changes = ST.tier_changes(arriving(spark, df, 5, "part"), "ts", "1 day", "2 days")
    out, ck = folders()
    with ST.rocksdb(spark):
        q = S.run_batches(changes, ck, S.batch_sink(out))
    got = sorted((r["batch_id"], r["claim_id"], r["confidence_tier"]) for r in S.read_sink(spark, out, changes.schema).collect())
    tiers = [t for _, c, t in got if c == 1]
    assert tiers == ["Moderately Accepted", "Speculative"]      # two sources in January are not remembered in February
    held = [op.numRowsTotal for op in q.recentProgress[-1].stateOperators]
    assert max(held) <= 4


def test_credibility_state_equals_batch_over_batches(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), f"2024-01-01 {i // 60:02}:{i % 60:02}:00", i, rng.choice([1, 1, -1, None, 3]), rng.choice(["x", None, "y"]), i // 30)
            for i in range(300)]
    df = spark.createDataFrame(rows, "domain string, ts string, event_id long, delta int, reason string, part int")
    want = {r["domain"]: (r["score"], r["n"], r["last_reason"]) for r in G.credibility_fold(df).collect()}
    s = arriving(spark, df, 10, "part")
    out, ck = folders()
    changes = ST.credibility_changes(s)
    with ST.rocksdb(spark):
        S.run_batches(changes, ck, S.batch_sink(out))
    state = S.latest(S.read_sink(spark, out, changes.schema), ["domain"])
    assert {r["domain"]: (r["score"], r["n"], r["last_reason"]) for r in state.collect()} == want
    out, ck = folders()
    sink = K.CompactedSink(spark, out, spark.createDataFrame([], G.SEGMENT).schema, K.folded, every=3)
    S.run_batches(s, ck, lambda batch, i: sink.write(G.credibility_segments(batch), i))
    got = G.fold_segments(sink.current(), ["batch_id", "first_ts", "first_id"])
    assert {r["domain"]: (r["score"], r["n"], r["last_reason"]) for r in got.collect()} == want


def batch(spark, i):
    return spark.createDataFrame([(k, i) for k in range(i % 7, 20, 3)] + [(None, i)], "key int, value int")


def test_fifty_batches_are_read_like_five(spark):
    out, _ = folders()
    sink = K.CompactedSink(spark, out, batch(spark, 0).schema, K.latest_by("key"), every=4, at_most=12)
    read = []
    for i in range(50):
        sink.write(batch(spark, i).coalesce(1), i)
        read.append(len(sink._rows()[2]))
    want = {}
    for i in range(50):
        want |= {k: i for k in range(i % 7, 20, 3)} | {None: i}
    assert {r["key"]: r["value"] for r in sink.current().collect()} == want
    assert max(read) <= 12 and max(read[40:]) <= max(read[:20]) and len(sink.files.names("snapshots")) <= 2 and len(sink.files.names("deltas")) <= 24


def test_a_crash_before_the_manifest_or_a_replay_loses_nothing(spark, monkeypatch):
    out, _ = folders()
    sink = K.CompactedSink(spark, out, batch(spark, 0).schema, K.latest_by("key"), every=3)
    for i in range(2):
        sink.write(batch(spark, i), i)
    want = {r["key"]: r["value"] for r in K.latest_by("key")(sink._rows()[0].unionByName(batch(spark, 2).withColumn("batch_id", F.lit(2).cast("long")))).collect()}

    def crash(*_):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(sink.files, "put", crash)
        with pytest.raises(OSError):
            sink.write(batch(spark, 2), 2)
    again = K.CompactedSink(spark, out, batch(spark, 0).schema, K.latest_by("key"), every=3)
    assert again._manifests() == [] and {r["key"]: r["value"] for r in again.current().collect()} == want
    again.write(batch(spark, 2), 2)                             # replayed after the crash, then once more after its snapshot
    again.write(batch(spark, 2), 2)
    assert again._manifests() == [2] and {r["key"]: r["value"] for r in again.current().collect()} == want
    empty = K.CompactedSink(spark, folders()[0], batch(spark, 0).schema, K.latest_by("key"))
    assert empty.current().count() == 0


def test_claims_of_a_bucket_keep_their_own_evidence_and_time(spark, assertions):
    changes = ST.tier_changes(arriving(spark, assertions, 4, "part"), "ts", "100 days", "100 days", buckets=2)
    out, ck = folders()
    with ST.rocksdb(spark):
        S.run_batches(changes, ck, S.batch_sink(out))
    seen = S.latest(S.read_sink(spark, out, changes.schema), ["claim_id"])
    assert {r["claim_id"]: r["confidence_tier"] for r in seen.collect()} == {
        r["claim_id"]: r["confidence_tier"] for r in evidence_tiers(assertions).collect()}
