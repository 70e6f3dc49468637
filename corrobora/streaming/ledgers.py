"""Ordered, clamped score ledgers that fold in parallel."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corrobora.functions import vocab as V
from corrobora.session import ship

_LO, _HI = round(V.CRED_MIN * 1000), round(V.CRED_MAX * 1000)
_STEP, START = round(V.CRED_STEP * 1000), round(V.CRED_DEFAULT * 1000)
_NO = 10 ** 9           # no bound

SEGMENT = ("domain string, first_ts string, first_id long, shift long, lo long, hi long, n long, "
           "last_ts string, last_id long, last_reason string")


def moves_of(delta) -> np.ndarray:
    return np.asarray(delta, np.int64) * _STEP


def _then(a, b):
    """The step that does a, then b. A step is x -> min(hi, max(lo, x + shift)); such steps are closed under composition."""
    return a[0] + b[0], np.clip(a[1] + b[0], b[1], b[2]), np.clip(a[2] + b[0], b[1], b[2])


def runs_composed(run: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
    """(shift, lo, hi) of each run of equal neighbours in ``run``: neighbours are paired until each run is one step."""
    step = moves, np.full(len(moves), _LO), np.full(len(moves), _HI)
    while True:
        first = np.concatenate(([True], run[1:] != run[:-1])) if len(run) else np.zeros(0, bool)
        if first.all():
            return step
        start = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
        even = (np.arange(len(run)) - start) % 2 == 0
        left = np.flatnonzero(even)
        paired = np.append(~even[1:], False)[left]              # an odd place always belongs to the run of the one before
        right = np.minimum(left + 1, len(run) - 1)
        both = _then([x[left] for x in step], [x[right] for x in step])
        step = tuple(np.where(paired, b, x[left]) for b, x in zip(both, step))
        run = run[left]


def compose(moves: np.ndarray) -> tuple[int, int, int]:
    """All moves as one step."""
    if not len(moves):
        return 0, -_NO, _NO
    return tuple(int(x[0]) for x in runs_composed(np.zeros(len(moves), np.int8), moves))


def _fold_partition(batches):
    """One row per domain run in a sorted chunk; a run that goes on in the next batch is carried there."""
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    open_run = None
    for pdf in batches:
        if pdf.empty:
            continue
        run = pd.factorize(pdf["domain"], use_na_sentinel=False)[0]
        first = np.concatenate(([True], run[1:] != run[:-1]))
        at, end = np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], len(run)) - 1
        shift, lo, hi = runs_composed(run, moves_of(pdf["delta"]))
        out = pd.DataFrame({"domain": pdf["domain"].to_numpy()[at], "first_ts": pdf["ts"].to_numpy()[at], "first_id": pdf["event_id"].to_numpy()[at],
                            "shift": shift, "lo": lo, "hi": hi, "n": end - at + 1, "last_ts": pdf["ts"].to_numpy()[end],
                            "last_id": pdf["event_id"].to_numpy()[end], "last_reason": pdf["reason"].to_numpy()[end]})[names]
        if open_run is not None:
            head = out.iloc[0]
            if head["domain"] == open_run["domain"] or pd.isna(head["domain"]) and pd.isna(open_run["domain"]):
                step = _then([open_run[c] for c in ("shift", "lo", "hi")], [head[c] for c in ("shift", "lo", "hi")])
                for c, v in (("first_ts", open_run["first_ts"]), ("first_id", open_run["first_id"]), ("n", open_run["n"] + head["n"]),
                             *zip(("shift", "lo", "hi"), step)):
                    out.at[0, c] = v
            else:
                yield open_run.to_frame().T
        open_run = out.iloc[-1]
        yield out.iloc[:-1]
    if open_run is not None:
        yield open_run.to_frame().T


def credibility_segments(events: DataFrame) -> DataFrame:
    """Events (domain, ts, event_id, delta, reason) folded per range chunk; a busy domain spans many chunks."""
    ship(events.sparkSession)
    e = events.select(F.col("domain"), F.col("ts").cast("string").alias("ts"), F.col("event_id").cast("long").alias("event_id"),
                      F.coalesce(F.col("delta").cast("long"), F.lit(0)).alias("delta"), F.col("reason"))
    keys = ["domain", "ts", "event_id"]
    return e.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(_fold_partition, SEGMENT)


def _apply(score: Column, s: Column) -> Column:
    return F.least(s["hi"], F.greatest(s["lo"], score + s["shift"]))


def fold_segments(segments: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Score, count and last reason per domain. A domain has at most one segment per chunk, so the list is short."""
    keys = order or ["first_ts", "first_id"]
    s = F.struct(*keys, "shift", "lo", "hi", "n", "last_reason")
    per = segments.groupBy("domain").agg(F.array_sort(F.collect_list(s)).alias("ss"))
    score = F.aggregate("ss", F.lit(START).cast("long"), _apply)
    return per.select("domain", (score / 1000).alias("score"), F.aggregate("ss", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"),
                      F.element_at("ss", -1)["last_reason"].alias("last_reason"))


def composed_segments(segments: DataFrame) -> DataFrame:
    """Segments (with batch_id) of a domain as one: its list holds a row for each batch and chunk since it was last composed."""
    s = F.struct("batch_id", "first_ts", "first_id", "shift", "lo", "hi", "n", "last_ts", "last_id", "last_reason")
    per = segments.groupBy("domain").agg(F.array_sort(F.collect_list(s)).alias("ss"))
    within = lambda x, b: F.least(b["hi"], F.greatest(b["lo"], x))
    none = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(-_NO).cast("long").alias("lo"), F.lit(_NO).cast("long").alias("hi"), F.lit(0).cast("long").alias("n"))
    all_of = F.aggregate("ss", none, lambda a, b: F.struct((a["shift"] + b["shift"]).alias("shift"), within(a["lo"] + b["shift"], b).alias("lo"),
                                                           within(a["hi"] + b["shift"], b).alias("hi"), (a["n"] + b["n"]).alias("n")))
    first, last = F.element_at("ss", 1), F.element_at("ss", -1)
    return per.select("domain", first["first_ts"].alias("first_ts"), first["first_id"].alias("first_id"), all_of.alias("f"), last.alias("l")).select(
        "domain", "first_ts", "first_id", "f.shift", "f.lo", "f.hi", "f.n", "l.last_ts", "l.last_id", "l.last_reason", "l.batch_id")


def credibility_fold(events: DataFrame) -> DataFrame:
    return fold_segments(credibility_segments(events))


def lateral_nudge(scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One-off adjustment from independent sources: credible up, low down, anything else unchanged."""
    v = F.lower(F.trim("verdict"))
    move = F.when(v == "credible", V.CRED_STEP).when(v == "low", -V.CRED_STEP).otherwise(0.0)
    moved = F.bround(F.greatest(F.lit(V.CRED_MIN), F.least(F.lit(V.CRED_MAX), F.col("score") + move)), 3)
    return scores.join(verdicts, "domain", "left").withColumn("score", moved)
