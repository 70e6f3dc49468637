"""Counts, coverage and progress."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora.functions import exprs as X, vocab as V
from corrobora.functions.text import matches, word_count, words
from corrobora.session import one_row


def _types(default: str = "web"):
    t = F.coalesce("source_types", F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(t) == 0, F.array(F.lit(default))).otherwise(t))


def organ_mix(df: DataFrame) -> DataFrame:
    """Findings per lane; a finding counts once in each of its lanes, ``web`` when it names none."""
    return df.select(F.explode(_types()).alias("lane")).groupBy("lane").agg(F.count("*").alias("n"))


def contribution_ledger(mix: DataFrame) -> DataFrame:
    """What every expected lane added: dead, weak or firing; academic lanes do not apply without papers."""
    dim = mix.sparkSession.createDataFrame(list(V.LANES.items()), "lane string, title string")
    rows = dim.join(mix, "lane", "left").select("lane", "title", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    academic = rows.filter(F.col("lane").isin(*V.ACADEMIC_LANES)).agg(F.sum("n").alias("papers"))
    status = (F.when(F.col("lane").isin(*V.ACADEMIC_LANES) & (F.col("papers") == 0), "N/A (no academic sources in case)")
              .when(F.col("n") == 0, "DEAD (0 findings)").when(F.col("n") < 5, "weak (barely fired)").otherwise("firing"))
    return rows.withColumn("papers", one_row(academic)["papers"]).select("title", "n", status.alias("status"))


def triage_stats(verdicts: DataFrame) -> DataFrame:
    """Keep / context / reject per file and over all; anything unrecognised was kept."""
    v = X.within(F.col("verdict"), V.TRIAGE_VERDICTS, "keep")
    rows = verdicts.select("file", v.alias("v"))
    return rows.rollup("file").agg(*[F.count_if(F.col("v") == x).alias(x) for x in V.TRIAGE_VERDICTS],
                                   F.count("*").alias("total"), F.grouping("file").alias("g")).select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col("file")).alias("file"), *V.TRIAGE_VERDICTS, "total")


def tallies(profiles: DataFrame, on: str = "report_id") -> DataFrame:
    """Per report and status: people, and those with a documented cause."""
    status = F.lower(F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")))
    cause = F.coalesce("cause", F.lit("")) != ""
    return profiles.groupBy(on, status.alias("status")).agg(F.count("*").alias("n"), F.count_if(cause).alias("with_cause"))


def coverage_audit(findings: DataFrame, read: DataFrame) -> DataFrame:
    """Gathered against read per lane, and the share nothing ever read."""
    seen = read.select("finding_id").distinct().withColumn("_r", F.lit(1))
    lanes = findings.join(seen, "finding_id", "left").select("_r", F.explode(_types("(none)")).alias("lane"))
    return lanes.groupBy("lane").agg(F.count("*").alias("gathered"), F.count_if(F.col("_r").isNull()).alias("unread")).withColumn(
        "pct_lost", F.bround(100.0 * F.col("unread") / F.col("gathered"), 1))


def strongest_unread(findings: DataFrame, read: DataFrame, k: int | None = None) -> DataFrame:
    """Well-supported findings nothing read, best corroborated first, with their total."""
    un = findings.join(read.select("finding_id"), "finding_id", "left_anti").filter(
        F.col("confidence_tier").isin("Accepted", "Moderately Accepted"))
    n = un.agg(F.count("*").alias("n_total"))
    top = un.orderBy(F.desc("corroboration_count"), "finding_id")
    top = top if k is None else top.limit(k)
    return top.select("finding_id", "confidence_tier", "corroboration_count", one_row(n)["n_total"].alias("n_total"))


def collect_sources(findings: DataFrame, order: str = "doc_id") -> DataFrame:
    """Each cited url once, with the type of the finding that cited it first."""
    return (findings.select(F.explode("urls").alias("url"), F.col(order).alias("o"), F.get(_types(), 0).alias("source_type"))
            .groupBy("url").agg(F.min(F.struct("o", "source_type")).alias("m")).select("url", "m.source_type", F.col("m.o").alias("first_seen")))


def goal_progress(criteria: DataFrame, hits: DataFrame, tiers: DataFrame, previous: DataFrame, floor: float = 0.4) -> DataFrame:
    """Coverage of success criteria. ``hits`` are retrieval results (query_id, doc_id, score, rank)."""
    best = hits.groupBy("query_id").agg(F.max_by(F.struct("doc_id", "score"), F.struct("score", -F.col("rank"))).alias("b"))
    rows = criteria.select("query_id").join(best, "query_id", "left").select("query_id", F.col("b.doc_id").alias("doc_id"), F.col("b.score").alias("score"))
    rows = rows.join(tiers.select("doc_id", "confidence_tier"), "doc_id", "left")
    ok = (X.standard_label(F.col("confidence_tier")) == "well-supported") & (F.col("score") >= floor)
    now = rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_covered"))
    was = previous.agg(F.count_if("covered").alias("n_before"))
    ratio = F.col("n_covered") / F.greatest("n", F.lit(1))
    plateau = F.col("n_covered") <= F.col("n_before")
    return now.withColumn("n_before", one_row(was)["n_before"]).select(
        "n_covered", (F.col("n") - F.col("n_covered")).alias("n_open"),
        F.when(ratio >= 0.66, "substantial").when(ratio >= 0.33, "partial").otherwise("limited").alias("proximity"),
        plateau.alias("plateauing"), ((F.col("n") > F.col("n_covered")) & plateau).alias("checkpoint_user"))


def saturation(log: DataFrame, floor: float = V.SATURATION_NOVEL) -> DataFrame:
    """Per cycle: keep going, saturated, or failed (an empty round is a failure, never saturation)."""
    total = F.col("novel") + F.col("incremental") + F.col("redundant")
    state = (F.when(F.col("kb_reuse") == 1, "continue").when(total == 0, "failed")
             .when(F.col("novel") / total < floor, "saturated").otherwise("continue"))
    return log.withColumn("state", state)


def run_delta(before: DataFrame, after: DataFrame, log: DataFrame) -> DataFrame:
    """Per branch: nodes before and after, added and removed, plus what the run's log recorded."""
    both = (before.select("branch_id", "finding_id", F.lit(1).alias("b"))
            .join(after.select("branch_id", "finding_id", F.lit(1).alias("a")), ["branch_id", "finding_id"], "full_outer"))
    d = both.groupBy("branch_id").agg(
        F.count("b").alias("n_before"), F.count("a").alias("n_after"),
        F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"))
    run = log.groupBy("branch_id").agg(F.count("question").alias("asked"), F.sum("n_contested").alias("contested_marked"),
                                       F.count_if("kb_reuse").alias("reused"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return d.join(run, "branch_id", "left").select("branch_id", "n_before", "n_after", "added", "removed", z("asked"),
                                                   z("contested_marked"), z("reused"))


def lean_card(scores: DataFrame) -> DataFrame:
    """Per model: distortion with and without the protocol and how much it helps, least distorted first."""
    side = lambda c, p: F.coalesce(F.sum(F.when(F.col("protocol") == p, F.col(c))), F.lit(0)).cast("long").alias(f"{c}_{p}")
    card = scores.groupBy("model").agg(side("softening", "on"), side("softening", "off"), side("stripping", "on"), side("stripping", "off"))
    on = F.col("softening_on") + F.col("stripping_on")
    return card.withColumn("helps", F.col("softening_off") + F.col("stripping_off") - on).orderBy(on, "model")


def ab_compare(results: DataFrame) -> DataFrame:
    """Findings per matched pair and arm, with a TOTAL row."""
    arm = lambda a: F.coalesce(F.sum(F.when(F.col("arm") == a, F.col("findings"))), F.lit(0)).cast("long").alias(f"{a}_n")
    return results.rollup("pair").agg(arm("old"), arm("new"), F.grouping("pair").alias("g")).select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("pair").cast("string")).alias("pair"), "old_n", "new_n")


def retention(outputs: DataFrame, terms: DataFrame, on: str = "report_id") -> DataFrame:
    """Must-keep terms of each output that literally survived."""
    hit = F.contains(F.lower("text"), F.lower("term"))
    return terms.join(outputs, on).groupBy(on).agg(F.count_if(hit).alias("kept"), F.count_if(~hit).alias("dropped"))


def coverage_score(texts: DataFrame, roster: DataFrame, on: str = "report_id") -> DataFrame:
    """Per text: roster members named, and of those with a status, a cause and a date near their surname.

    The neighbourhood is 120 characters before to 400 after each of the first three mentions.
    """
    surname = F.element_at(words(F.col("name")), -1)
    rows = roster.select(on, F.lower(surname).alias("sn")).join(texts.select(on, "text", F.lower("text").alias("low")), on)
    low, sn = F.col("low"), F.col("sn")
    at = F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.length(F.call_function("substring_index", low, sn, i)) + 1),
                  lambda p: p <= F.length(low))
    pos = F.array_distinct(at)
    seg = F.array_join(F.transform(pos, lambda p: F.substr(F.col("text"), F.greatest(p - 120, F.lit(1)),
                                                           p + 400 - F.greatest(p - 120, F.lit(1)))), " ")
    rows = rows.select(on, F.contains(low, sn).alias("named"), seg.alias("seg"))
    n = lambda c, name: F.count_if(F.col("named") & c).alias(name)
    return rows.groupBy(on).agg(n(F.lit(True), "named"), n(matches(F.col("seg"), V.COVER_STATUS), "status"),
                                n(matches(F.col("seg"), V.COVER_CAUSE), "cause"), n(matches(F.col("seg"), V.COVER_WHEN), "dated"))


def monoculture(questions: DataFrame, by: str) -> DataFrame:
    """Generators that fill in one template: few distinct three-word openings over four or more questions."""
    head = F.lower(F.array_join(F.slice(words(F.col("text")), 1, 3), " "))
    per = questions.filter(word_count(F.col("text")) > 0).groupBy(by).agg(
        F.count("*").alias("n"), F.count_distinct(head).alias("openings"))
    return per.withColumn("monoculture", (F.col("n") >= 4) & (F.col("openings") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4))))


def question_report(questions: DataFrame, by: str = "lane") -> DataFrame:
    """Pass rate and average words per generator and in total."""
    ok = X.bad_question(F.col("text")) == ""
    return questions.rollup(by).agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"),
                                    F.floor(F.sum(word_count(F.col("text"))) / F.count("*")).alias("avg_words"),
                                    F.grouping(by).alias("g")).select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col(by)).alias(by), "n", "passed", "avg_words")


def coverage_rollup(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("round_n").agg(F.count("*").alias("leads"), F.sum("covered").cast("long").alias("covered"),
                                           F.sum("findings").cast("long").alias("findings"))
