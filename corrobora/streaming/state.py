"""Running state per key in the RocksDB store: what changes is emitted, what is quiet for too long expires.

A key's state is a few counters; claims, of which there are many, are held in buckets. Distinct sources are told apart before, by ``dropDuplicatesWithinWatermark`` on the whole
source key, so a claim with a third of all rows is spread over its sources and only new ones reach its counters.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from corrobora.functions import exprs as X, vocab as V
from corrobora.operators.evidence import family_bits, is_model
from corrobora.session import ship
from corrobora.streaming.ledgers import START, compose, moves_of
from corrobora.streaming.streams import dedupe_stream

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; stateful processors need it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Expiring(StatefulProcessor):
    """One value a key. ``quiet_ms``: by event time, a key without rows for so long is forgotten when the watermark passes."""

    SCHEMA = ""

    def __init__(self, quiet_ms: int | None = None, ttl_ms: int | None = None):
        self.quiet_ms, self.ttl_ms = quiet_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.SCHEMA}, until long", self.ttl_ms)

    def old(self) -> tuple[tuple | None, int | None]:
        """What is known of the key, and until when."""
        held = self.value.get()
        return (None, None) if held is None else (tuple(held[:-1]), held[-1])

    def keep(self, was: tuple | None, now: tuple, until: int | None, newest_ms: int | None) -> bool:
        """Store a changed value and move the key's one timer to its newest row plus the quiet time. True if the value changed."""
        at = until
        if newest_ms is not None and (until is None or newest_ms + self.quiet_ms > until):
            at = newest_ms + self.quiet_ms
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(at)
        if was != now or at != until:
            self.value.update((*now, at))
        return was != now

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def _clock(ts: str | None, ttl: str | None) -> str:
    """A time to live needs processing time; such a query has always a next batch and is stopped by its owner."""
    return "EventTime" if ts else "ProcessingTime" if ttl else "None"


# --- evidence of a claim ---------------------------------------------------------------------------
BUCKETS = 1 << 14       # groups of claims whose evidence is held as one value


class _Evidence(StatefulProcessor):
    """Evidence of a bucket of claims as one value, with one timer for the claim that is forgotten first: a call serves many
    claims, as a call for each would cost more than its rows. Each claim keeps its own time: ``quiet_ms`` beyond its newest
    row by the watermark, or ``ttl_ms`` of processing time beyond its last change."""

    NONE = (0, 0, 0, False, 0)          # n_other, n_model, fam, typed, c

    def __init__(self, quiet_ms: int | None = None, ttl_ms: int | None = None):
        self.quiet_ms, self.ttl_ms = quiet_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "held string, due long", self.ttl_ms)

    def held(self) -> tuple[dict, int | None]:
        """({claim: (evidence, until)}, when the timer is due)."""
        row = self.value.get()
        return ({}, None) if row is None else ({k: (tuple(v), at) for k, *v, at in json.loads(row[0])}, row[1])

    def put(self, held: dict, due: int | None) -> None:
        soonest = min((at for _, at in held.values()), default=None) if self.quiet_ms is not None else None
        if soonest != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if soonest is not None:
                self.handle.registerTimer(soonest)
        if held:
            self.value.update((json.dumps([[k, *v, at] for k, (v, at) in held.items()]), soonest))
        else:
            self.value.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, due = self.held()
        now = None
        if self.ttl_ms is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            held = {k: x for k, x in held.items() if x[1] > now}
        changed, moved = {}, False
        for pdf in rows:
            code, claims = pd.factorize(pdf["claim"])
            agree, model = pdf["contra"].to_numpy() == 0, pdf["model"].to_numpy() == 1
            n, fam, at = len(claims), np.zeros(len(claims), "int64"), np.zeros(len(claims), "int64")
            any_of = lambda flag: np.bincount(code[flag], minlength=n) > 0
            np.bitwise_or.at(fam, code, pdf["fam"].to_numpy())
            if self.quiet_ms is not None:
                np.maximum.at(at, code, pdf["at"].to_numpy())
            found = zip(claims, np.bincount(code[agree & ~model], minlength=n).tolist(), any_of(agree & model).tolist(), fam.tolist(),
                        any_of(pdf["typed"].to_numpy(dtype=bool)).tolist(), any_of(~agree).tolist(), at.tolist())
            for k, n_other, n_model, bits, typed, c, newest in found:
                old, until = held.get(k, (self.NONE, None))
                new = (old[0] + n_other, max(old[1], int(n_model)), old[2] | bits, old[3] or typed, max(old[4], int(c)))
                if until is None or new != old:
                    changed[k] = new
                    until = until if now is None else now + self.ttl_ms
                if self.quiet_ms is not None:
                    until = max(until or 0, newest + self.quiet_ms)
                moved |= held.get(k) != (new, until)
                held[k] = (new, until)
        if moved:
            self.put(held, due)
        if changed:
            yield pd.DataFrame([(k, *v) for k, v in changed.items()], columns=["claim", "n_other", "n_model", "fam", "typed", "c"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, due = self.held()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        self.put({k: x for k, x in held.items() if x[1] > passed}, None)
        return iter(())

    def close(self) -> None:
        pass


def tier_changes(assertions: DataFrame, ts: str | None = None, delay: str = "1 hour", quiet: str = "1 day", ttl: str | None = None,
                 buckets: int = BUCKETS) -> DataFrame:
    """(claim_id, c, confidence_tier) of each claim whose evidence changed in a batch; start it inside ``rocksdb``.

    With ``ts``: sources are remembered for ``delay`` and a claim for ``quiet`` beyond its newest row, both by the watermark;
    rows without event time belong to ``split_undated``. Without ``ts``: sources are remembered for good, a claim for
    ``ttl`` of processing time where that is given. A forgotten claim begins anew. Null stances agree, null types are no
    family, a null claim is a claim of its own. ``buckets``: how many groups of claims there are, the same for all runs on a
    checkpoint; a batch rewrites the groups it touches.
    """
    ship(assertions.sparkSession)
    keys = ["claim_id", "source_id", "source_type", "contra"]
    flagged = assertions.withColumn("contra", F.coalesce((F.col("stance") == "contradict").cast("int"), F.lit(0)))
    once = flagged.dropDuplicates(keys) if ts is None else dedupe_stream(flagged, keys, delay, ts)
    t = F.col("source_type")
    kind = assertions.schema["claim_id"].dataType.simpleString()
    text = F.base64("claim_id") if kind == "binary" else F.col("claim_id").cast("string")
    claim = F.coalesce(F.concat(F.lit("="), text), F.lit(""))           # null is a claim, and no number in pandas
    rows = once.select(F.pmod(F.xxhash64(claim), F.lit(buckets)).cast("int").alias("bucket"), claim.alias("claim"), "contra",
                       is_model(t).cast("int").alias("model"), family_bits(t).cast("long").alias("fam"),
                       t.isNotNull().alias("typed"), *([] if ts is None else [F.unix_millis(ts).alias("at"), ts]))
    kept = _Evidence(None if ts is None else milliseconds(assertions.sparkSession, quiet),
                     None if ttl is None else milliseconds(assertions.sparkSession, ttl))
    per = rows.groupBy("bucket").transformWithStateInPandas(
        kept, "claim string, n_other long, n_model long, fam long, typed boolean, c long", "append", _clock(ts, ttl))
    families = F.when(F.col("typed"), F.bit_count("fam"))
    tier = F.when(F.col("c") == 1, V.CONTESTED).otherwise(X.gated_tier(F.col("n_other") + F.col("n_model"), families))
    named = F.when(F.col("claim") != "", F.substring("claim", 2, 2**31 - 1))
    return per.select((F.unbase64(named) if kind == "binary" else named.cast(kind)).alias("claim_id"), "c", tier.alias("confidence_tier"))


# --- credibility of a domain -----------------------------------------------------------------------
class _Credibility(_Expiring):
    SCHEMA = "score long, n long, last_reason string"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old, until = self.old()
        score, n, reason = old or (START, 0, None)
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable", na_position="first")
        shift, lo, hi = compose(moves_of(pdf["delta"]))
        score, n, reason = int(min(hi, max(lo, score + shift))), n + len(pdf), pdf["reason"].iloc[-1]
        reason = reason if isinstance(reason, str) else None
        self.keep(old, (score, n, reason), until, None if self.quiet_ms is None else int(pdf["at"].max()))
        yield pd.DataFrame({"domain": [key[0]], "score": [score / 1000], "n": [n], "last_reason": [reason]})


def credibility_changes(events: DataFrame, ts: str | None = None, delay: str = "1 hour", quiet: str = "1 day", ttl: str | None = None) -> DataFrame:
    """(domain, score, n, last_reason) of each domain with events in a batch; start it inside ``rocksdb``.

    Batches count in the order they arrive, events of a batch by (ts, event_id); a run of events is composed to one step,
    not walked. What a key holds at a time is its events of one batch. ``ts``: event-time column after whose ``quiet`` a
    domain is forgotten; without it a ledger is kept for good, or for ``ttl`` of processing time. A null delta moves nothing.
    """
    spark = events.sparkSession
    ship(spark)
    s = events if ts is None else events.withWatermark(ts, delay)
    rows = s.select("domain", F.col("ts").cast("string").alias("ts"), F.col("event_id").cast("long").alias("event_id"),
                    F.coalesce(F.col("delta").cast("long"), F.lit(0)).alias("delta"), "reason",
                    *([] if ts is None else [F.unix_millis(ts).alias("at"), F.col(ts).alias("_event_time")]))
    kept = _Credibility(None if ts is None else milliseconds(spark, quiet), None if ttl is None else milliseconds(spark, ttl))
    return rows.groupBy("domain").transformWithStateInPandas(
        kept, "domain string, score double, n long, last_reason string", "append", _clock(ts, ttl))


def milliseconds(spark: SparkSession, interval: str) -> int:
    """Length of an interval written as text, months not allowed."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    length = F.timestamp_diff("MICROSECOND", epoch, epoch + F.expr(f"INTERVAL {interval}"))
    return int(spark.range(1).select(length).first()[0] // 1000)
