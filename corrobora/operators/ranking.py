"""Ordering, top-k, prioritised unions and set operations."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from corrobora.functions import exprs as X, vocab as V
from corrobora.functions.text import literals, squash
from corrobora.operators.ordering import row_numbers
from corrobora.operators.people import entity_hits
from corrobora.session import one_row


def top_corroborated(hits: DataFrame, k: int, by: str = "probe_id") -> DataFrame:
    order = [F.desc("cross_source"), F.desc("corroboration_count"), F.desc("score"), "vec_id"]
    return hits.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("place") <= k)


def budget_cut(df: DataFrame, budget: int, by: str = "label", overhead: int = 4) -> DataFrame:
    """Best-corroborated rows per bucket while their running length fits the budget; reports kept of total.

    Every row costs at least its overhead, so at most ``budget / overhead`` rows can fit: that many are
    taken by a partial top-k first, and the running sum never sees an unbounded bucket.
    """
    size = F.length("claim") + overhead
    least = max(1, overhead)        # blank claims without overhead are free: as many as there are characters are read
    order = W.partitionBy(by).orderBy(F.desc("corroboration_count"), "finding_id")
    total = df.groupBy(by).agg(F.count("*").alias("n_total"))
    short = (df.select("finding_id", by, "corroboration_count", size.cast("long").alias("_s"))
             .withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= budget // least + 1))
    run = short.withColumn("used", F.sum("_s").over(order.rowsBetween(W.unboundedPreceding, 0)))
    kept = run.filter(F.col("used") <= budget).select("finding_id", by, "used")
    n = kept.groupBy(by).agg(F.count("*").alias("n_kept"))
    return kept.join(n, by).join(total, by)


def entity_evidence(findings: DataFrame, entities: DataFrame, n: int | None = None) -> DataFrame:
    """Evidence per entity, best corroborated first; the cap is optional and the total always told."""
    hits = entity_hits(findings, entities).join(findings.select("finding_id", "corroboration_count"), "finding_id")
    total = hits.groupBy("name").agg(F.count("*").alias("n_total"))
    if n is None:       # a person may hold a third of all findings: number them in chunks
        ranked = row_numbers(hits.withColumn("_o", -F.col("corroboration_count")), ["name"], ["_o", "finding_id"], "rank").drop("_o")
    else:               # bounded: only the best n per task leave it
        order = W.partitionBy("name").orderBy(F.desc("corroboration_count"), "finding_id")
        ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.join(total, "name")


def ordered_distinct(sources: list[DataFrame], cap: int | None = None, key: str = "item", order: str = "pos") -> DataFrame:
    """Union of sources in priority order, first occurrence of each item kept, optional cap."""
    tagged = [s.select(F.col(key).alias("item"), F.lit(i).alias("prio"), F.col(order).cast("long").alias("pos")) for i, s in enumerate(sources)]
    rows = tagged[0]
    for s in tagged[1:]:
        rows = rows.unionByName(s)
    first = rows.filter(squash(F.col("item")) != "").groupBy("item").agg(F.min(F.struct("prio", "pos")).alias("m"))
    out = first.select("item", "m.prio", "m.pos").orderBy("prio", "pos", "item")
    out = out.withColumn("n_total", one_row(first.agg(F.count("*").alias("n")))["n"])
    return out if cap is None else out.limit(cap)


def rotate_angles(entities: DataFrame, templates=V.LEAD_TEMPLATES, order: str = "entity_id", by: str = "case_id") -> DataFrame:
    """The i-th entity of a case is asked the (i mod n)-th template."""
    slot = ((F.col("_n") - 1) % len(templates)).cast("int")
    lead = F.replace(F.get(literals(templates), slot), F.lit("{n}"), F.col("name"))
    return row_numbers(entities, [by], [order], "_n").withColumn("slot", slot).withColumn("lead", lead).drop("_n")


def open_threads(coverage: DataFrame, hypotheses: DataFrame, ledger: DataFrame, anomalies: DataFrame,
                 cap: int | None = None) -> DataFrame:
    """Unresolved questions in order of origin: uncovered leads, live hypotheses, unsettled claims, anomalies;
    ``n_total`` counts them all."""
    say = lambda df, prefix, col, pos: df.select(F.concat(F.lit(prefix), F.col(col)).alias("item"), F.col(pos).alias("pos"))
    live = hypotheses.filter(F.lower(F.trim("verdict")).isin("survives", "weakened"))
    unsettled = ledger.filter(F.lower("verdict").isin("unproven", "contested", "hearsay"))
    claim = unsettled.select(F.concat(F.lit("Unresolved claim ("), "verdict", F.lit("): "), "claim").alias("item"), F.col("claim_id").alias("pos"))
    return ordered_distinct([
        say(coverage.filter("covered = 0"), "No evidence found for: ", "lead", "lead_id"),
        say(live, "Still live — not resolved: ", "hypothesis", "hyp_id"), claim,
        say(anomalies, "Anomaly not put to rest: ", "anomaly", "pos")], cap)


def next_questions(threads: DataFrame, coverage: DataFrame, follow_ups: DataFrame, rich: int | None = None) -> DataFrame:
    """Unresolved threads first, then follow-ups of the ``rich`` leads with most findings (all, by default); unusable
    questions and repeats drop out. ``n_total`` counts what all leads would give."""
    covered = coverage.filter("covered = 1").select("lead_id", "findings")
    top = covered if rich is None else covered.orderBy(F.desc("findings"), "lead_id").limit(rich)
    chosen = top.select("lead_id", F.lit(True).alias("_top"))
    fu = follow_ups.join(covered, "lead_id").join(chosen, "lead_id", "left").select(squash(F.col("text")).alias("q"), F.lit(1).alias("prio"),
                                                             (-F.col("findings")).alias("pos"), "lead_id",
                                          F.coalesce("_top", F.lit(False)).alias("_top"))
    th = threads.select(squash(F.col("item")).alias("q"), F.lit(0).alias("prio"), F.col("pos").alias("pos"), F.lit(0).cast("long").alias("lead_id"), F.lit(True).alias("_top"))
    ok = th.unionByName(fu).filter((F.col("q") != "") & (X.bad_question(F.col("q")) == ""))
    per = ok.groupBy(F.lower("q").alias("k")).agg(F.min(F.when(F.col("_top"), F.struct("prio", "pos", "lead_id", "q"))).alias("m"))
    total = one_row(per.agg(F.count("*").alias("n")))["n"]
    return per.filter("m IS NOT NULL").select("m.q", "m.prio", "m.pos", total.alias("n_total")).orderBy("prio", "pos", "q")


def rank_patterns(df: DataFrame) -> DataFrame:
    """``place`` by verdict, then links, then contact with a known fact; numbered in chunks, never in one task."""
    place = F.coalesce(F.array_position(literals(("unresolved-notable", "supported", "unverified", "debunked")), F.col("verdict")), F.lit(0))
    keyed = df.withColumn("_v", F.when(place == 0, 5).otherwise(place)).withColumn("_l", -F.col("n_links")).withColumn("_t", -F.col("touches_fact"))
    return row_numbers(keyed, [], ["_v", "_l", "_t", "pattern_id"], "place").drop("_v", "_l", "_t")


def ach_table(df: DataFrame) -> DataFrame:
    """Competing hypotheses, fewest disconfirming items first; unknown verdicts read as weakened."""
    v = X.within(F.col("verdict"), V.HYPOTHESIS_VERDICTS, "weakened")
    d = df.withColumn("verdict", v).withColumn("n_disconfirming", F.size("disconfirming"))
    smaller = d.groupBy("n_disconfirming").agg(F.count("*").alias("c"))
    # competition rank from the few distinct counts: no global sort of the hypotheses
    rank = smaller.withColumn("rank", F.coalesce(F.sum("c").over(
        W.orderBy("n_disconfirming").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).select("n_disconfirming", "rank")
    return d.join(rank, "n_disconfirming")


def frontier(coverage: DataFrame, asked: DataFrame, per_round: int | None = None, cap: int | None = None) -> DataFrame:
    """Richest unasked covered leads per round; ``n_total`` counts a round's before any cut."""
    new = coverage.filter("covered = 1").join(asked.select("lead_id"), "lead_id", "left_anti")
    rank = F.row_number().over(W.partitionBy("round_n").orderBy(F.desc("findings"), "lead_id"))
    if per_round is None:
        top = row_numbers(new.withColumn("_f", -F.col("findings")), ["round_n"], ["_f", "lead_id"], "rank").drop("_f")
    else:
        top = new.withColumn("rank", rank).filter(F.col("rank") <= per_round)
    top = top.join(new.groupBy("round_n").agg(F.count("*").alias("n_total")), "round_n")
    return top if cap is None else top.orderBy("round_n", "rank").limit(cap)


def rank_hits(hits: DataFrame, cap: int, by: str = "lead_id") -> DataFrame:
    """Hits of all query variants: each url once at its first place, primary-looking first, page cap."""
    first = hits.groupBy(by, "url").agg(F.min(F.struct("variant", "pos")).alias("m"))
    order = [F.desc(X.is_primary_source(F.col("url"))), "m", "url"]
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= cap).select(by, "url", "rank")


# --- set operations --------------------------------------------------------------------------------
def union_lanes(**lanes: DataFrame) -> DataFrame:
    """Union of retrieval lanes; each row says where it came from."""
    out = None
    for name, df in lanes.items():
        tagged = df.withColumn("lane", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def with_contested(hits: DataFrame, contested: DataFrame, key: str = "finding_id") -> DataFrame:
    """Relevance slice plus every contested row; a row in both keeps the slice's version."""
    extra = contested.join(hits.select(key), key, "left_anti")
    return hits.withColumn("via", F.lit("relevance")).unionByName(extra.withColumn("via", F.lit("contested")), allowMissingColumns=True)


def exclude(df: DataFrame, ids: DataFrame, key: str = "finding_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def useful(verdicts: DataFrame, include_context: bool = True) -> DataFrame:
    keep = ("keep", "context") if include_context else ("keep",)
    v = X.within(F.col("verdict"), V.TRIAGE_VERDICTS, "keep")
    return verdicts.filter(v.isin(*keep)).select("finding_id").distinct()
