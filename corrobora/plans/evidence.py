"""Queries for evidence weight, consolidation and tier movement."""
from pyspark.sql import functions as F

from corrobora.functions import vocab as V
from corrobora.operators import evidence as E, similarity as S
from corrobora.plans.catalog import query
from corrobora.plans.entities import clusters_sql
from corrobora.plans.expressions import sql_map
from corrobora.plans.retrieval import COS, knn_sql
from corrobora.session import dealt
from corrobora.streaming.ledgers import credibility_fold

TIERS = f"""ds AS (SELECT claim_id, source_id, source_type, max(CASE WHEN stance = 'contradict' THEN 1 ELSE 0 END) AS c FROM v_assertions GROUP BY 1, 2, 3),
    wt AS (SELECT claim_id, count(*) FILTER (source_type <> 'llm') + max(CASE WHEN source_type = 'llm' THEN 1 ELSE 0 END) AS weight,
                  count(DISTINCT {sql_map('source_type', V.TYPE_FAMILY, "'web'")}) AS n_families, max(c) AS c FROM ds GROUP BY 1),
    tr AS (SELECT claim_id, weight, n_families, c, CASE WHEN c = 1 THEN 'Controversial' WHEN weight >= 3 AND n_families >= 2 THEN 'Accepted'
                  WHEN weight >= 2 THEN 'Moderately Accepted' ELSE 'Speculative' END AS confidence_tier FROM wt)"""


@query("D2_evidence_labels", f"""
    WITH {TIERS}, l AS (SELECT unnest(['well-supported', 'contested', 'unverified', 'disproven']) AS label)
    SELECT l.label, count(tr.claim_id) AS n FROM l LEFT JOIN tr ON l.label = {sql_map('confidence_tier', V.STANDARD_LABEL, "'unverified'")} GROUP BY 1""")
def _(t):
    return E.label_counts(E.evidence_tiers(t.v_assertions))


@query("D2_evidence_tiers", f"WITH {TIERS} SELECT claim_id, weight, n_families, c AS contested, confidence_tier FROM tr")
def _(t):
    return E.evidence_tiers(t.v_assertions).withColumn("contested", F.col("contested").cast("int"))


@query("D1_cluster_outcomes", """
    WITH p AS (SELECT claim_id AS cluster_id, count(DISTINCT source_id) AS n_sources, count(DISTINCT source_type) AS n_types, count(*) AS n_claims,
                      CASE WHEN claim_id % 9 <> 0 THEN max(CASE WHEN stance = 'contradict' THEN 1 ELSE 0 END) ELSE 0 END AS g
               FROM v_assertions GROUP BY claim_id HAVING count(DISTINCT source_id) >= 2)
    SELECT cluster_id, CASE WHEN g = 1 THEN 'gap' ELSE 'corroboration' END AS kind, n_sources, n_types, n_claims,
           CASE WHEN g = 1 THEN round_even(n_sources / (SELECT count(DISTINCT source_id) FROM v_assertions)::double, 3) END AS disagreement_score FROM p""")
def _(t):
    a = t.v_assertions
    claims = a.select(F.col("claim_id").alias("cluster_id"), F.col("source_id").alias("source_label"), "source_type")
    stance = dealt(a.select(F.col("claim_id").alias("cluster_id"), "stance"), "cluster_id").groupBy("cluster_id").agg(F.max("stance").alias("s")).select(
        "cluster_id", F.when(F.col("cluster_id") % 9 != 0, F.col("s")).alias("stance"))
    return E.cluster_outcomes(claims, stance)


_REL = "CASE WHEN {0} % 11 = 0 THEN NULL WHEN {0} % 5 = 0 THEN 'same' WHEN {0} % 5 = 1 THEN 'collaborative' WHEN {0} % 5 = 3 THEN 'Contradicts' WHEN {0} % 5 = 4 THEN 'unsure' ELSE 'distinct' END"


def act_sql(score, rel):
    return (f"CASE WHEN {score} >= 0.9 THEN 'merged' WHEN {score} >= 0.6 AND {rel} = 'same' THEN 'merged' WHEN {rel} = 'collaborative' THEN 'nested' "
            f"WHEN lower({rel}) = 'contradicts' THEN 'kept_contested' ELSE 'new' END")


DECIDE = f"""tw AS (SELECT claim_id, target_id, score FROM (SELECT b.vec_id AS claim_id, a.vec_id AS target_id, {COS} AS score,
        row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS r FROM v_index a JOIN v_index b
        ON a.branch_id = b.branch_id AND a.vec_id < b.vec_id AND {COS} >= 0.45) WHERE r = 1),
    nk AS ({knn_sql(a='v_index', b='v_probes')}), ix AS (SELECT probe_id AS claim_id, vec_id AS target_id, score FROM nk WHERE rank = 1 AND score >= 0.45),
    dc AS (SELECT i.vec_id AS claim_id, i.branch_id AS batch, tw.target_id AS tt, tw.score AS ts, ix.target_id AS it, ix.score AS sx,
           CASE WHEN tw.score IS NOT NULL THEN {act_sql('tw.score', _REL.format('i.vec_id'))} END AS ta,
           CASE WHEN ix.score IS NOT NULL THEN {act_sql('ix.score', _REL.format('i.vec_id'))} ELSE 'new' END AS ia
           FROM v_index i LEFT JOIN tw ON tw.claim_id = i.vec_id LEFT JOIN ix ON ix.claim_id = i.vec_id),
    de AS (SELECT claim_id, batch, CASE WHEN ta IN ('merged', 'nested') THEN ta ELSE ia END AS action,
           CASE WHEN ta IN ('merged', 'nested') THEN tt WHEN ia <> 'new' THEN it END AS target_id,
           greatest(coalesce(ts, 0), coalesce(sx, 0)) AS nearest_score FROM dc)"""


def decisions(t):
    cand = E.ingest_candidates(t.v_index, t.v_probes)
    rel = cand.select("claim_id", "target_id").distinct().select("claim_id", "target_id", F.expr(_REL.format("claim_id")).alias("relation"))
    return E.decide(t.v_index, cand, rel)


@query("H1_decide", f"WITH {DECIDE} SELECT claim_id, action, target_id, nearest_score FROM de")
def _(t):
    return decisions(t).select("claim_id", "action", "target_id", "nearest_score")


@query("D6_consolidation_summary", f"""
    WITH {DECIDE} SELECT batch, count(*) AS n_in, count(*) FILTER (action = 'new') AS new, count(*) FILTER (action = 'merged') AS merged,
      count(*) FILTER (action = 'nested') AS nested, count(*) FILTER (action = 'kept_contested') AS kept_contested,
      count(*) FILTER (nearest_score < 0.4) AS novel, count(*) FILTER (nearest_score >= 0.4 AND nearest_score < 0.6) AS incremental,
      count(*) FILTER (nearest_score >= 0.6) AS redundant, count(*) FILTER (action IN ('new', 'kept_contested')) AS distinct_added FROM de GROUP BY batch""")
def _(t):
    d = decisions(t).join(t.v_index.select(F.col("vec_id").alias("claim_id"), F.col("branch_id").alias("batch")), "claim_id")
    return E.consolidation_summary(d)


_MERGES = "SELECT o_orderkey AS claim_id, 'find_' || cast(o_custkey as {s}) AS target_id, 'https://m' || cast(o_custkey % 7 as {s}) || '.example.com/' || cast(o_orderkey % 3 as {s}) AS url, 'src' || cast(o_orderkey % 9 as {s}) AS source FROM orders"


def merge_parts(t):
    m = t.sql(_MERGES.format(s="string"))
    claims = m.select(F.concat(F.lit("c"), F.col("claim_id").cast("string")).alias("claim_id"), "target_id", "url", "source")
    arrays = claims.select(F.col("claim_id").alias("finding_id"), F.array("url").alias("urls"), F.array("source").alias("source_ids"))
    nodes = t.v_findings.withColumn("source_ids", F.array(F.concat(F.lit("src"), (F.col("n_chars") % 9).cast("string"))))
    return nodes, claims.select("claim_id", "target_id"), E.provenance(arrays)


@query("H2_apply_merge", f"""
    WITH m AS ({_MERGES.format(s='varchar')}), n AS (SELECT *, 'src' || (n_chars % 9) AS s0 FROM v_findings),
    s AS (SELECT finding_id, count(DISTINCT s) AS n_src FROM (SELECT finding_id, s0 AS s FROM n UNION ALL SELECT target_id, source FROM m) GROUP BY 1),
    u AS (SELECT finding_id, count(DISTINCT u) AS n_urls FROM (SELECT finding_id, unnest(urls) AS u FROM v_findings UNION ALL SELECT target_id, url FROM m) GROUP BY 1),
    k AS (SELECT n.finding_id, confidence_tier, n.finding_id IN (SELECT target_id FROM m) AS hit, CASE WHEN n.finding_id IN (SELECT target_id FROM m)
          THEN greatest(corroboration_count, n_src) ELSE corroboration_count END AS c FROM n JOIN s USING (finding_id))
    SELECT finding_id, cast(c AS bigint) AS corroboration_count, CASE WHEN NOT hit OR confidence_tier = 'Controversial' THEN confidence_tier
      WHEN c >= 3 THEN 'Accepted' WHEN c = 2 THEN 'Moderately Accepted' ELSE 'Speculative' END AS confidence_tier, coalesce(n_urls, 0) AS n_urls
    FROM k LEFT JOIN u USING (finding_id)""")
def _(t):
    nodes, merges, new_prov = merge_parts(t)
    out, prov = E.apply_merge(nodes, E.provenance(nodes), merges, new_prov)
    urls = prov.filter("kind = 'url'").groupBy("finding_id").agg(F.count("*").alias("n_urls"))
    return out.join(urls, "finding_id", "left").select("finding_id", "corroboration_count", "confidence_tier",
                                                       F.coalesce("n_urls", F.lit(0)).alias("n_urls"))


@query("H3_apply_nest", f"""
    WITH m AS ({_MERGES.format(s='varchar')}), k AS (SELECT target_id AS finding_id, count(*) + 1 AS n FROM m GROUP BY 1)
    SELECT f.finding_id, cast(coalesce(n, corroboration_count) AS bigint) AS corroboration_count, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS nested,
      CASE WHEN n IS NULL OR confidence_tier = 'Controversial' THEN confidence_tier WHEN n >= 3 THEN 'Accepted' WHEN n = 2 THEN 'Moderately Accepted' ELSE 'Speculative' END AS confidence_tier
    FROM v_findings f LEFT JOIN k USING (finding_id)""")
def _(t):
    nodes, nests, _ = merge_parts(t)
    none = nodes.select("finding_id", F.col("finding_id").alias("child_id"), "claim").limit(0)
    new = nests.select("claim_id", F.col("claim_id").alias("claim"))
    out, _children = E.apply_nest(nodes, none, nests, new)
    return out.select("finding_id", "corroboration_count", F.col("nested").cast("int").alias("nested"), "confidence_tier")


_COUNTS = "SELECT vec_id, branch_id, embedding, cast(1 + vec_id % 3 as bigint) AS corroboration_count, CASE WHEN vec_id % 13 = 0 THEN 'Controversial' ELSE 'Speculative' END AS confidence_tier FROM v_vectors"


@query("H4_dedupe_verbatim", f"""
    WITH RECURSIVE {clusters_sql('v_vectors', 0.9)}, n AS ({_COUNTS}),
    p AS (SELECT component, count(*) AS members, cast(sum(corroboration_count) AS bigint) AS total FROM n JOIN comp USING (vec_id) GROUP BY 1)
    SELECT n.vec_id, total AS corroboration_count, CASE WHEN members = 1 OR confidence_tier = 'Controversial' THEN confidence_tier WHEN total >= 3 THEN 'Accepted'
      WHEN total = 2 THEN 'Moderately Accepted' ELSE 'Speculative' END AS confidence_tier FROM p JOIN n ON n.vec_id = p.component""")
def _(t):
    return E.dedupe_verbatim(t.sql(_COUNTS), dry_run=False).select("vec_id", "corroboration_count", "confidence_tier")


_OUT = "SELECT vec_id AS probe_id, branch_id, embedding, vec_id % 5 AS weight, vec_id % 3 AS n_families, vec_id % 10 = 0 AS is_gap FROM v_probes"


@query("H5_promote", f"""
    WITH k AS ({knn_sql()}), h AS (SELECT k.vec_id, score, weight, n_families, is_gap FROM k JOIN ({_OUT}) o USING (probe_id) WHERE rank = 1 AND score >= 0.55),
    p AS (SELECT vec_id, max(CASE WHEN is_gap THEN 0 WHEN weight >= 3 AND n_families >= 2 THEN 2 WHEN weight >= 2 THEN 1 ELSE 0 END) AS tr,
                 bool_or(is_gap) AS g, max(score) AS match, count(*) AS n_outcomes FROM h GROUP BY 1),
    m AS (SELECT i.vec_id, confidence_tier AS from_tier, round(match, 3) AS match, n_outcomes, CASE WHEN g OR confidence_tier = 'Controversial' THEN 'Controversial'
          WHEN tr > CASE confidence_tier WHEN 'Accepted' THEN 2 WHEN 'Moderately Accepted' THEN 1 ELSE 0 END THEN ['Speculative', 'Moderately Accepted', 'Accepted'][tr + 1]
          ELSE confidence_tier END AS to_tier FROM p JOIN v_index i USING (vec_id))
    SELECT vec_id, from_tier, to_tier, match, n_outcomes FROM m WHERE from_tier <> to_tier""")
def _(t):
    return E.promote(t.v_index, t.sql(_OUT))[1]


@query("H6_apply_controversy", """
    WITH d AS (SELECT DISTINCT dispute_id, unnest(finding_ids) AS finding_id FROM v_disputes WHERE trim(coalesce(side_a, '')) <> '' AND trim(coalesce(side_b, '')) <> ''),
    k AS (SELECT d.* FROM d JOIN v_findings USING (finding_id)), v AS (SELECT dispute_id FROM k GROUP BY 1 HAVING count(*) >= 2)
    SELECT finding_id, CASE WHEN finding_id IN (SELECT finding_id FROM k WHERE dispute_id IN (SELECT dispute_id FROM v)) THEN 'Controversial' ELSE confidence_tier END AS confidence_tier
    FROM v_findings""")
def _(t):
    return E.apply_controversy(t.v_findings, t.v_disputes).select("finding_id", "confidence_tier")


@query("H7_retract", f"""
    WITH k AS ({knn_sql('a.vec_id <> b.vec_id', 'v_vectors', 'v_vectors')}), c AS (SELECT probe_id, count(*) AS n FROM k WHERE rank <= 7 AND score >= 0.35 GROUP BY 1),
    b AS (SELECT vec_id FROM c JOIN v_relations r ON r.vec_id = c.probe_id WHERE n >= 3 AND relation = 'contradicts')
    SELECT 'd' || (vec_id % 12) || '.example.org' AS domain, greatest(0.05, round(0.5 - 0.05 * count(*), 3))::double AS score, count(*) AS n FROM b GROUP BY 1""")
def _(t):
    claims = t.v_vectors.withColumnRenamed("vec_id", "probe_id")
    verdicts = t.v_relations.select(F.col("vec_id").alias("probe_id"), (F.col("relation") == "contradicts").alias("contradicts"))
    bad = S.consensus(claims, t.v_vectors, verdicts)
    sited = claims.withColumn("url", F.concat(F.lit("https://www.d"), (F.col("probe_id") % 12).cast("string"), F.lit(".example.org/")))
    _, events, _ = E.retract(sited, bad)
    return credibility_fold(events.withColumn("ts", F.lit(0))).select("domain", "score", "n")


@query("H8_disagreement_input", """
    WITH p AS (SELECT branch_id, count(*) FILTER (confidence_tier = 'Controversial') AS c, count(*) FILTER (confidence_tier IN ('Accepted', 'Moderately Accepted')) AS s FROM v_findings GROUP BY 1)
    SELECT branch_id, c AS n_contested, s AS n_supported, CASE WHEN c > 0 THEN 1 ELSE 0 END AS contested,
           CASE WHEN c > 0 THEN CASE WHEN branch_id = 'en' THEN 'first side' ELSE 'balanced' END END AS toward,
           CASE WHEN c > 0 THEN CASE WHEN branch_id = 'en' THEN 'strong' ELSE 'slight' END END AS magnitude FROM p""")
def _(t):
    leans = t.v_findings.select("branch_id").distinct().select(
        "branch_id", F.when(F.col("branch_id") == "en", " first side ").otherwise("").alias("toward"),
        F.when(F.col("branch_id") == "en", "Strong").otherwise("huge").alias("magnitude"))
    return E.disagreement_input(t.v_findings, leans).withColumn("contested", F.col("contested").cast("int"))


_INGEST = """f AS (SELECT claim_id, action, target_id FROM de WHERE action IN ('merged', 'nested') UNION ALL SELECT f.claim_id, f.action, d.target_id
      FROM f JOIN de d ON d.claim_id = f.target_id WHERE d.action IN ('merged', 'nested')),
    st AS (SELECT * FROM f WHERE target_id NOT IN (SELECT claim_id FROM de WHERE action IN ('merged', 'nested'))),
    nd AS (SELECT vec_id AS finding_id, 'Speculative' AS tier FROM v_probes UNION ALL
      SELECT claim_id, CASE WHEN action = 'kept_contested' THEN 'Controversial' ELSE 'Speculative' END FROM de WHERE action IN ('new', 'kept_contested')),
    sr AS (SELECT vec_id AS finding_id, vec_id % 5 AS s FROM v_probes UNION SELECT claim_id, claim_id % 5 FROM de WHERE action IN ('new', 'kept_contested')
      UNION SELECT target_id, claim_id % 5 FROM st WHERE action = 'merged'),
    ns AS (SELECT finding_id, count(*) AS n FROM sr GROUP BY 1), ch AS (SELECT target_id AS finding_id, count(*) + 1 AS n FROM st WHERE action = 'nested' GROUP BY 1),
    c AS (SELECT nd.finding_id, tier, coalesce(ch.n, CASE WHEN nd.finding_id IN (SELECT target_id FROM st WHERE action = 'merged') THEN ns.n END) AS n, coalesce(ch.n, 0) AS n_children
      FROM nd JOIN ns USING (finding_id) LEFT JOIN ch ON ch.finding_id = nd.finding_id)"""


@query("H1_ingest_run", f"""
    WITH RECURSIVE {DECIDE}, {_INGEST} SELECT finding_id, cast(coalesce(n, 1) AS bigint) AS corroboration_count, n_children,
      CASE WHEN n IS NULL OR tier = 'Controversial' THEN tier WHEN n >= 3 THEN 'Accepted' WHEN n = 2 THEN 'Moderately Accepted' ELSE 'Speculative' END AS confidence_tier FROM c""")
def _(t):
    nodes, _, children = ingested(t)
    n = children.groupBy("finding_id").agg(F.count("*").alias("n_children"))
    return nodes.join(n, "finding_id", "left").select("finding_id", "corroboration_count", F.coalesce("n_children", F.lit(0)).alias("n_children"), "confidence_tier")


def ingested(t, before=None):
    """A whole batch (the index vectors) taken in over the probe vectors, or once more over what came out."""
    say = lambda d, name: d.select(F.col("vec_id").alias(name), F.concat(F.lit("claim "), F.col("vec_id").cast("string")).alias("claim"))
    said = lambda d: d.select(F.col("vec_id").alias("finding_id"), F.lit("source").alias("kind"), F.concat(F.lit("src"), (F.col("vec_id") % 5).cast("string")).alias("value"))
    if before is None:
        nodes = say(t.v_probes, "finding_id").withColumns({"corroboration_count": F.lit(1).cast("long"), "confidence_tier": F.lit("Speculative")})
        before = nodes, said(t.v_probes), nodes.select("finding_id", F.col("finding_id").alias("child_id"), "claim").limit(0)
    return E.ingest(*before, say(t.v_index, "claim_id"), said(t.v_index), decisions(t))


@query("D2_source_sketches", """
    SELECT claim_id, count(DISTINCT source_id) AS n_sources FROM v_assertions GROUP BY 1
    UNION ALL SELECT -1, count(DISTINCT claim_id % 400) FROM v_assertions""")
def _(t):
    # two batches, merged; few sources for a claim are told apart exactly, and so are four hundred
    a = t.v_assertions
    batch = lambda i: E.source_sketches(a.filter(F.pmod(F.xxhash64("source_id"), F.lit(2)) == i))
    whole = E.source_sketches(a.select(F.lit(-1).cast("long").alias("claim_id"), (F.col("claim_id") % 400).alias("s")), source="s")
    return E.sketched_sources(E.merge_sketches(batch(0).union(batch(1)))).union(E.sketched_sources(whole))
