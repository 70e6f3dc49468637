"""Joins between findings, questions, feeds, sources and verdict tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corrobora.functions import exprs as X, vocab as V
from corrobora.functions.text import literals, sig_tokens, squash, words
from corrobora.operators.lexical import hybrid, known_claims
from corrobora.operators.matching import contains_join
from corrobora.operators.ordering import row_numbers
from corrobora.operators.people import with_conflict, with_facts


def override_tier(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """The stored tier wins over the tier a search hit carried."""
    cur = truth.select("finding_id", F.col("confidence_tier").alias("_t"))
    return hits.join(cur, "finding_id", "left").withColumn(
        "confidence_tier", F.coalesce("_t", "confidence_tier", F.lit(V.DEFAULT_TIER))).drop("_t")


def contribute(new: DataFrame, existing: DataFrame, cards: DataFrame) -> DataFrame:
    """Intake of outside claims: (claim_id, reason, tier). First failing check names the reason; accepted
    claims enter as Speculative with reason ``added``."""
    known = known_claims(new, existing).select("claim_id", ((F.col("n_words") < 4) | F.col("known")).alias("dup"))
    surnames = cards.withColumn("k", F.lower(F.element_at(words(F.col("name")), -1)))
    hits = contains_join(new, "claim_id", F.lower("claim"), surnames, "k").join(surnames, "k")
    clash = (with_conflict(hits.join(with_facts(new), "claim_id")).filter("verdict = 'hard'").select("claim_id").distinct()
             .withColumn("clash", F.lit(True)))
    rows = new.join(known, "claim_id", "left").join(clash, "claim_id", "left")
    reason = (F.when(X.is_meta(F.col("claim")), "self_description").when(F.col("dup"), "duplicate")
              .when(F.col("clash"), "namesake").otherwise("added"))
    return rows.select("claim_id", reason.alias("reason")).withColumn(
        "tier", F.when(F.col("reason") == "added", V.DEFAULT_TIER))


def contribution_report(contributed: DataFrame) -> DataFrame:
    return contributed.groupBy("reason").agg(F.count("*").alias("n"))


def unseen(questions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Questions not yet asked in their branch, compared on the normalised text."""
    key = X.norm_question(F.col("text")).alias("q_key")
    return questions.withColumn("q_key", key).join(
        ledger.select("branch_id", key).distinct(), ["branch_id", "q_key"], "left_anti")


def relevant_feeds(topics: DataFrame, feeds: DataFrame) -> DataFrame:
    """(topic_id, feed_id) sharing at least one specific topic token; place words alone do not count."""
    sig = lambda c: F.array_except(sig_tokens(c, V.STOPWORDS), literals(V.WEAK_TOKENS))
    t = topics.select("topic_id", F.explode(sig(F.col("topic"))).alias("w"))
    meta = F.concat_ws(" ", "title", "author")
    f = feeds.select("feed_id", F.explode(sig(meta)).alias("w")).join(t.select("w").distinct(), "w", "left_semi")
    return t.join(f, "w").select("topic_id", "feed_id").distinct()


def matching_episodes(episodes: DataFrame, tokens: DataFrame, max_eps: int | None = None) -> DataFrame:
    """Episodes mentioning a case token, newest first per show; the whole list is searched, only the
    expensive follow-up is capped. No tokens at all keeps every episode."""
    low = F.lower(F.regexp_replace("text", "<[^>]+>", " "))
    if tokens.isEmpty():
        kept = episodes
    else:
        hit = contains_join(episodes, "episode_id", low, tokens, "token").select("episode_id").distinct()
        kept = episodes.join(hit, "episode_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("show").orderBy("episode_id"))
    n = kept.groupBy("show").agg(F.count("*").alias("n_total"))
    ranked = row_numbers(kept, ["show"], ["episode_id"], "rank") if max_eps is None else kept.withColumn("rank", rank).filter(F.col("rank") <= max_eps)
    return ranked.join(n, "show")


def verify_queue(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Order for reciprocal checking: speculative claims first."""
    first = F.when(F.lower(F.coalesce("confidence_tier", F.lit(""))).startswith("spec"), 0).otherwise(1)
    q = findings.withColumn("_o", first).orderBy("_o", "finding_id")
    return (q if limit is None else q.limit(limit)).drop("_o")


def verify_evidence(claims: DataFrame, docs: DataFrame, vectors: DataFrame, k: int = 6) -> DataFrame:
    """The k best other texts to check a claim against; its own text is no evidence for it."""
    return hybrid(claims, docs, vectors, k, skip_own_text=True).select("query_id", "doc_id", F.col("rank").alias("place"), "score")


def verify_tally(targets: DataFrame, verdicts: DataFrame) -> DataFrame:
    v = X.within(F.col("verdict"), ("supported", "contradicted", "insufficient"), "error")
    return targets.join(verdicts, "finding_id", "left").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumn("p_a", F.least("entity_a", "entity_b")).withColumn("p_b", F.greatest("entity_a", "entity_b"))


def check_links(links: DataFrame, confirmed: DataFrame, nonlinks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each asserted link against confirmed links, explicit non-links and ledger verdicts (unordered pairs)."""
    on = ["p_a", "p_b"]
    flag = lambda d, n: _pair(d).select(*on).distinct().withColumn(n, F.lit(1))
    led = _pair(ledger).groupBy(on).agg(F.max("verdict").alias("ledger_verdict"))
    out = (_pair(links).join(flag(confirmed, "confirmed"), on, "left").join(flag(nonlinks, "nonlink"), on, "left")
           .join(led, on, "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = (F.when(z("nonlink") == 1, "debunked").when((z("confirmed") == 1) | (F.col("ledger_verdict") == "verified"), "supported")
              .otherwise(X.norm_verdict(F.col("ledger_verdict"))))
    return out.withColumn("status", status)


def anchors(payloads: DataFrame, cards: DataFrame, case_anchor: str) -> DataFrame:
    """Disambiguating anchor per payload: its own card (equal or contained name), else the case anchor."""
    key = F.lower(squash(F.col("payload")))
    c = cards.select(F.lower("name").alias("card"), X.disambiguator(F.col("role"), F.col("employer"), F.col("place")).alias("phrase"))
    keys = payloads.select(key.alias("key")).distinct()
    equal = keys.join(c, F.col("key") == F.col("card")).select("key", "card")
    inside = contains_join(c, "card", F.col("card"), keys.filter(F.length("key") > 3), "key").select("key", "card")
    best = equal.union(inside).groupBy("key").agg(F.min("card").alias("card"))
    phrase = best.join(c, "card").select("key", "phrase")
    return (payloads.withColumn("key", key).join(phrase, "key", "left")
            .withColumn("anchor", F.coalesce(F.nullif("phrase", F.lit("")), F.lit(case_anchor))).drop("key", "phrase"))


def review_queue(cited: DataFrame, reviewed: DataFrame, per_batch: int | None = None) -> DataFrame:
    """Cited domains neither pre-vetted nor reviewed yet, first cited first; ``n_total`` counts a batch's."""
    trusted = sorted({d for _, doms in V.REGISTRY.values() for d in doms})
    seen = (cited.withColumn("domain", X.domain_of(F.col("url"))).filter((F.col("domain") != "") & ~F.col("domain").isin(trusted))
            .groupBy("batch", "domain").agg(F.min("pos").alias("pos")))
    new = seen.join(reviewed.select("domain").distinct(), "domain", "left_anti")
    rank = F.row_number().over(W.partitionBy("batch").orderBy("pos", "domain"))
    ranked = row_numbers(new, ["batch"], ["pos", "domain"], "rank") if per_batch is None else new.withColumn("rank", rank).filter(F.col("rank") <= per_batch)
    return ranked.join(new.groupBy("batch").agg(F.count("*").alias("n_total")), "batch")


def apply_gate(leads: DataFrame, grades: DataFrame) -> DataFrame:
    """Leads the checker rejects, or that are not templates, take a graded rewrite when the grade is C or F."""
    open_to_rewrite = (X.bad_question(F.col("lead")) != "") | ~F.lower("lead").startswith("verify the identity")
    rw = F.trim(F.coalesce("rewrite", F.lit("")))
    out = F.when(open_to_rewrite & F.col("grade").isin("C", "F") & (rw != ""), rw).otherwise(F.col("lead"))
    return leads.join(grades, "lead_id", "left").withColumn("lead", out).drop("grade", "rewrite")
