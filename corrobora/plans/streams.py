"""Queries for streaming operators; each stream is run to the end of what is available."""
from pyspark.sql import functions as F

from corrobora.functions import vocab as V
from corrobora.plans import views
from corrobora.plans.catalog import query
from corrobora.plans.evidence import TIERS
from corrobora.plans.linking import CARD_HITS, conflict_sql
from corrobora.session import scratch_path
from corrobora.streaming import ledgers as G, pacing as P, sinks as K, state as ST, streams as S


def streamed(t, *names):
    """The same tables and views with the named tables read as streams."""
    out = views.Tables(t.spark, t.dir)
    for n in names:
        out._made[n] = S.read_table(t.spark, t.dir, n, getattr(t, n).schema)
    return out


def paths(t, label):
    base = scratch_path(t.spark, label)
    return f"{base}/out", f"{base}/checkpoint"


def drained(t, stream, label, mode="append"):
    out, ck = paths(t, label)
    S.run_batches(stream, ck, S.batch_sink(out), mode)
    return S.read_sink(t.spark, out, stream.schema)


@query("I1_dedupe_stream", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    s = S.with_event_time(streamed(t, "events").events)
    kept = S.dedupe_stream(s, ["user_id", "event_type"], "60 days")
    return drained(t, kept.select("user_id", "event_type"), "dedupe").select("user_id", "event_type")


@query("I2_tier_stream", f"WITH {TIERS} SELECT claim_id, confidence_tier FROM tr")
def _(t):
    s = S.tier_stream(streamed(t, "lineitem").v_assertions)
    state = S.latest(drained(t, s, "tiers", "update"), ["claim_id"])
    return state.select("claim_id", "confidence_tier")


def compacted(t, stream, label, merge):
    """Run a stream of changes into a compacted sink and return its current rows."""
    out, ck = paths(t, label)
    sink = K.CompactedSink(t.spark, out, stream.schema, merge)
    with ST.rocksdb(t.spark):
        S.run_batches(stream, ck, sink.write)
    return sink.current().drop("batch_id")


@query("I2_tier_state", f"WITH {TIERS} SELECT claim_id, confidence_tier FROM tr")
def _(t):
    dated = S.with_event_time(streamed(t, "lineitem").v_dated_assertions)
    changes = ST.tier_changes(dated, "ts", "3650 days", "3650 days")
    return compacted(t, changes, "tier-state", K.latest_by("claim_id")).select("claim_id", "confidence_tier")


@query("I3_mix_stream", """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS lane, count(*) AS n, count(*) FILTER (value / 40.0::double < 0.4) AS novel,
           CASE WHEN count(*) FILTER (value / 40.0::double < 0.4) / count(*) < 0.1 THEN 1 ELSE 0 END AS saturated FROM events GROUP BY 1, 2""")
def _(t):
    s = S.with_event_time(streamed(t, "events").events).withColumn("score", F.col("value") / 40.0)
    state = drained(t, S.mix_stream(s, "1 day", lane="event_type"), "mix", "update")
    return S.latest(state, ["start", "lane"]).select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "lane", "n", "novel", F.col("saturated").cast("int").alias("saturated"))


FOLD = """SELECT domain, list_reduce(list_concat([500], list(delta * 50 ORDER BY ts, event_id)), lambda a, x: least(950, greatest(50, a + x))) / 1000.0::double AS score,
    count(*) AS n, arg_max(reason, (ts, event_id)) AS last_reason FROM v_cred_events GROUP BY domain"""


@query("I4_credibility_fold", FOLD)
def _(t):
    return G.credibility_fold(t.v_cred_events)


@query("I4_credibility_stream", FOLD)
def _(t):
    out, ck = paths(t, "credibility")
    S.credibility_stream(streamed(t, "events").v_cred_events, out, ck)
    return S.credibility_scores(t.spark, out)


@query("I4_credibility_state", FOLD)
def _(t):
    return compacted(t, ST.credibility_changes(streamed(t, "events").v_cred_events), "credibility-state", K.latest_by("domain"))


@query("I4_credibility_compacted", FOLD)
def _(t):
    out, ck = paths(t, "credibility-compacted")
    sink = K.CompactedSink(t.spark, out, t.spark.createDataFrame([], G.SEGMENT).schema, K.folded)
    S.run_batches(streamed(t, "events").v_cred_events, ck, lambda batch, i: sink.write(G.credibility_segments(batch), i))
    return G.fold_segments(sink.current(), ["batch_id", "first_ts", "first_id"])


@query("I5_stalls", """
    WITH g AS (SELECT user_id AS run_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
    SELECT run_id, event_id, round(d / 1000000.0, 3)::double AS gap FROM g WHERE d / 1000000.0 > 21600""")
def _(t):
    return P.stalls(t.events.select(F.col("user_id").alias("run_id"), "event_id", "ts"), 6 * 3600)


_LIM = ", ".join(f"('{k}', {n}, {s}::double)" for k, (n, s) in V.PROVIDER_LIMITS.items())


@query("I6_pacing_audit", f"""
    WITH l AS (SELECT * FROM (VALUES {_LIM}) x(provider, max_n, spacing)), r AS (SELECT provider, event_id, epoch_us(ts) AS us, cast(round(duration_s * 1000000) AS bigint) AS d FROM v_requests),
    g AS (SELECT *, (us - lag(us) OVER (PARTITION BY provider ORDER BY us, event_id)) / 1000000.0::double AS gap FROM r),
    a AS (SELECT provider, count(*) AS requests, count(*) FILTER (gap < spacing) AS too_close FROM g JOIN l USING (provider) GROUP BY 1),
    e AS (SELECT provider, event_id, us AS t, 1 AS step FROM r UNION ALL SELECT provider, event_id, us + d, -1 FROM r),
    f AS (SELECT *, sum(step) OVER (PARTITION BY provider ORDER BY t, step, event_id ROWS UNBOUNDED PRECEDING) AS fl FROM e),
    b AS (SELECT provider, cast(max(fl) AS bigint) AS max_in_flight, count(*) FILTER (fl > max_n) AS over_limit FROM f JOIN l USING (provider) WHERE step = 1 GROUP BY 1)
    SELECT * FROM a JOIN b USING (provider)""")
def _(t):
    return P.pacing_audit(t.v_requests)


@query("I6_load_stream", """
    WITH e AS (SELECT CASE user_id % 8 WHEN 0 THEN 'exa' WHEN 1 THEN 'jina' WHEN 2 THEN 'firecrawl' WHEN 3 THEN 'wayback' WHEN 4 THEN 'openrouter' WHEN 5 THEN 'groq' WHEN 6 THEN 'perplexity' ELSE 'openalex' END AS provider,
                      floor(epoch_us(ts) / 3600000000.0) AS h FROM events),
    w AS (SELECT provider, h * 3600 AS s FROM e UNION ALL SELECT provider, (h - 1) * 3600 FROM e)
    SELECT provider, cast(s AS bigint) AS start_s, count(*) AS requests FROM w GROUP BY 1, 2""")
def _(t):
    s = S.with_event_time(streamed(t, "events").v_requests)
    state = drained(t, S.load_stream(s, "2 hours", "1 hour"), "load", "update")
    return S.latest(state, ["start", "provider"]).select("provider", F.unix_timestamp("start").alias("start_s"), "requests")


@query("I7_raw_sink", """
    SELECT 'u' || user_id AS url, event_type AS branch_id, arg_max(props, ts) AS raw_text FROM events GROUP BY 1, 2""")
def _(t):
    rows = lambda x: x.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("branch_id"),
                                     F.lit("t").alias("title"), F.lit("web").alias("source_type"), F.col("props").alias("raw_text"), F.col("ts").alias("created_at"))
    out, ck = paths(t, "raw")
    S.raw_sink(rows(streamed(t, "events")), out, ck)
    return S.read_raw(t.spark, out, rows(t).schema).select("url", "branch_id", "raw_text")


@query("I7_raw_compacted", """
    SELECT 'u' || user_id AS url, event_type AS branch_id, arg_max(props, ts) AS raw_text FROM events GROUP BY 1, 2""")
def _(t):
    rows = streamed(t, "events").events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("branch_id"),
                                               F.lit("t").alias("title"), F.lit("web").alias("source_type"), F.col("props").alias("raw_text"), F.col("ts").alias("created_at"))
    return compacted(t, rows, "raw-compacted", K.latest_raw).select("url", "branch_id", "raw_text")


@query("I8_screen_stream", f"""
    WITH {CARD_HITS}, {conflict_sql("SELECT finding_id, name, claim, role, employer, born, died FROM hits JOIN v_case_claims USING (finding_id) JOIN v_cards USING (name)")}
    SELECT finding_id, name, CASE WHEN hard IS NOT NULL THEN 'quarantined' ELSE 'kept' END AS side,
           coalesce(hard, CASE WHEN nk > 0 THEN 'claim calls them ''' || trim(alien) || '''; known as ''' || CASE WHEN role <> '' THEN role ELSE employer END || '''' END, '') AS reason
    FROM cf""")
def _(t):
    out, ck = paths(t, "screen")
    S.screen_stream(streamed(t, "documents").v_case_claims, t.v_cards, out, ck)
    return t.spark.read.schema("finding_id string, name string, side string, reason string, batch_id long").parquet(out).drop("batch_id")


@query("I9_late_rows", """
    WITH m AS (SELECT quantile_disc(event_id, 0.5) AS half FROM events), d AS (SELECT * FROM events WHERE event_type <> 'error'),
    w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM d, m WHERE event_id >= half AND event_id % 2 = 0)
    SELECT 'undated_kept' AS metric, count(*) FILTER (event_type = 'error') AS n FROM events UNION ALL
    SELECT 'groups_dropped_late', count(*) FROM (SELECT DISTINCT date_trunc('day', ts) AS day, event_type FROM d, m, w
      WHERE event_id < half AND date_trunc('day', ts) + INTERVAL 1 DAY <= mark)""")
def _(t):
    src = scratch_path(t.spark, "late")
    e = t.events.withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts")))
    half = F.col("event_id") >= t.events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)")).first()[0]
    # rows are late by the watermark of the batch before: the first batch sets it, the third is judged by it
    for i, part in enumerate([e.filter(half & (F.col("event_id") % 2 == 0)), e.filter(half & (F.col("event_id") % 2 == 1)), e.filter(~half)]):
        part.coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    r = t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    dated, undated = S.split_undated(S.with_event_time(r))
    out, ck = paths(t, "late-dated")
    q = S.run_batches(dated.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").count().select("event_type", "count"), ck, S.batch_sink(out))
    late = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    side = drained(t, undated.select("event_id", "user_id"), "undated")
    return (side.agg(F.count("*").alias("n")).select(F.lit("undated_kept").alias("metric"), "n")
            .union(side.limit(1).select(F.lit("groups_dropped_late"), F.lit(int(late)).cast("long"))))


@query("I10_lead_answers", """
    SELECT a.event_id AS lead_id, b.event_id AS finding_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase'
      AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""")
def _(t):
    pick = lambda kind, key, when, ident: S.with_event_time(streamed(t, "events").events).filter(F.col("event_type") == kind).select(
        F.col("user_id").alias(key), F.col("ts").alias(when), F.col("event_id").alias(ident))
    joined = S.lead_answers(pick("view", "lead_key", "asked_at", "lead_id"), pick("purchase", "find_key", "found_at", "finding_id"), "6 hours")
    return drained(t, joined.select("lead_id", "finding_id"), "answers").drop("batch_id")


@query("I11_resume", """
    SELECT count(*) AS rows, count(DISTINCT event_id) AS events, 1 AS batches_first, 0 AS batches_second FROM events""")
def _(t):
    out, ck = paths(t, "resume")
    seen = []

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        seen.append(batch_id)
    s = streamed(t, "events").events.select("event_id", "user_id")
    S.run_batches(s, ck, each)
    first = len(seen)
    S.run_batches(streamed(t, "events").events.select("event_id", "user_id"), ck, each)
    rows = S.read_sink(t.spark, out, s.schema)
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events")).withColumn(
        "batches_first", F.lit(first)).withColumn("batches_second", F.lit(len(seen) - first))
