"""Queries for joins between findings, people, works and verdict tables."""
from pyspark.sql import functions as F

from corrobora.functions import exprs as X, vocab as V
from corrobora.operators import citations as G, links as L, people as P
from corrobora.plans.catalog import query
from corrobora.plans.expressions import KEYS_SQL, NAMES_SQL, PLAUSIBLE_SQL, sql_bad, sql_rx, sql_squash
from corrobora.plans.retrieval import HY, KNOWN, hybrid_queries
from corrobora.plans.scans import sql_any, sql_list

HITS = f"""ks AS ({KEYS_SQL.format('v_roster')}),
    hits AS (SELECT DISTINCT finding_id, name FROM v_case_claims JOIN ks ON contains(lower(claim), k))"""


@query("C1_override_tier", """
    SELECT f.finding_id, coalesce(t.confidence_tier, f.confidence_tier, 'Speculative') AS confidence_tier
    FROM v_findings f LEFT JOIN v_truth t USING (finding_id)""")
def _(t):
    return L.override_tier(t.v_findings, t.v_truth).select("finding_id", "confidence_tier")


@query("C2_case_files", f"""
    WITH {HITS} SELECT c.finding_id, coalesce(name, '_unassigned') AS file FROM v_case_claims c LEFT JOIN hits USING (finding_id)""")
def _(t):
    return P.case_files(t.v_case_claims, t.v_roster)


def conflict_sql(pairs: str) -> str:
    """Hard and weak conflicts by scanning every position for a cue (the SQL engine has no look-around)."""
    def years(cue, tag):
        return f"""{tag}p AS (SELECT pk, claim, unnest(generate_series(1, length(claim))) AS i FROM cl),
        {tag}c AS (SELECT pk, claim, i, length(regexp_extract(substr(claim, i), '(?i)^{cue}', 0)) AS n FROM {tag}p
                   WHERE (i = 1 OR regexp_matches(substr(claim, i - 1, 1), '[^A-Za-z0-9_]')) AND regexp_matches(substr(claim, i), '(?i)^{cue}')),
        {tag}y AS (SELECT pk, list_sort(list_distinct(flatten(list(regexp_extract_all(substr(claim, greatest(1, i - 60), i + n + 60 - greatest(1, i - 60)), '{V.YEAR}', 1))))) AS ys
                   FROM {tag}c GROUP BY pk)"""
    return f"""pr AS ({pairs}), cl AS (SELECT DISTINCT claim AS pk, claim FROM pr), {years(V.DEATH_CUE, 'd')}, {years(V.BIRTH_CUE, 'b')},
    ap AS (SELECT claim AS pk, regexp_extract_all(claim, '(?i){V.APPOSITIVE}', 1) AS st FROM cl),
    cf AS (SELECT pr.*, CASE WHEN died IS NOT NULL AND len(dy.ys) > 0 AND len(list_filter(dy.ys, lambda y: abs(cast(y AS int) - died) <= 1)) = 0
              THEN 'death/disappearance year [' || array_to_string(dy.ys, ', ') || '] conflicts with known ' || died
              WHEN born IS NOT NULL AND len(by_.ys) > 0 AND len(list_filter(by_.ys, lambda y: abs(cast(y AS int) - born) <= 1)) = 0
              THEN 'birth year [' || array_to_string(by_.ys, ', ') || '] conflicts with known ' || born END AS hard,
           list_filter(ap.st, lambda s: len(regexp_extract_all(lower(s), '[a-z]{{4,}}')) > 0
              AND NOT list_has_any(regexp_extract_all(lower(s), '[a-z]{{4,}}'), regexp_extract_all(lower(role || ' ' || employer), '[a-z]{{4,}}')))[1] AS alien,
           len(regexp_extract_all(lower(role || ' ' || employer), '[a-z]{{4,}}')) AS nk
        FROM pr LEFT JOIN dy ON dy.pk = pr.claim LEFT JOIN by_ ON by_.pk = pr.claim LEFT JOIN ap ON ap.pk = pr.claim)""".replace(
        "by AS (SELECT pk, list_sort", "by_ AS (SELECT pk, list_sort")


CARD_HITS = f"""ks AS ({KEYS_SQL.format('v_cards')}),
    hits AS (SELECT DISTINCT finding_id, name FROM v_case_claims JOIN ks ON contains(lower(claim), k))"""


@query("C3_screen", f"""
    WITH {CARD_HITS}, {conflict_sql("SELECT finding_id, name, claim, role, employer, born, died FROM hits JOIN v_case_claims USING (finding_id) JOIN v_cards USING (name)")}
    SELECT finding_id, name, CASE WHEN hard IS NOT NULL THEN 'quarantined' ELSE 'kept' END AS side,
           coalesce(hard, CASE WHEN nk > 0 THEN 'claim calls them ''' || trim(alien) || '''; known as ''' || CASE WHEN role <> '' THEN role ELSE employer END || '''' END, '') AS reason
    FROM cf""")
def _(t):
    kept, bad = P.screen(t.v_case_claims, t.v_cards)
    return (kept.select("finding_id", "name", F.lit("kept").alias("side"), "reason")
            .union(bad.select("finding_id", "name", F.lit("quarantined"), "quarantine_reason")))


WRONG = f"""wp AS (SELECT finding_id, name, claim, lower(claim) AS low, list_extract(string_split(name, ' '), -1) AS sn,
        [lower(w) for w in list_slice(string_split(name, ' '), 1, len(string_split(name, ' ')) - 1)] AS gv FROM hits JOIN v_case_claims USING (finding_id)),
    wq AS (SELECT *, regexp_extract_all(claim, '\\b([A-Z][a-z]{{2,}})\\s+(?:[A-Z][a-z]*\\.?\\s+)?' || sn || '\\b', 1) AS firsts,
           regexp_extract_all(claim, '\\b([A-Z][a-z]{{2,}})\\s+(?:[A-Z][a-z]*\\.?\\s+)?' || sn || '\\b', 0) AS spans,
           regexp_extract(claim, sn || '\\s+(?i:{V.NOT_A_PERSON})\\b', 0) AS place FROM wp),
    wr AS (SELECT finding_id, name, CASE WHEN len(list_filter(gv, lambda g: contains(low, g))) > 0 OR {sql_rx('claim', V.FAMILY)} THEN ''
        ELSE coalesce('''' || list_filter([z for z in list_zip(spans, firsts)], lambda z: NOT list_contains(gv, lower(z[2])) AND lower(z[2]) NOT IN ({sql_list(V.NOT_A_GIVEN_NAME)}))[1][1]
             || ''' — different given name (this is ' || name || ')',
             CASE WHEN place <> '' THEN '''' || place || ''' — a place/institution, not ' || name END, '') END AS reason FROM wq)"""


@query("C4_wrong_person", f"WITH {HITS}, {WRONG} SELECT finding_id, name, reason FROM wr")
def _(t):
    return P.namesakes(t.v_case_claims, t.v_roster)


@query("D9_findings_per_entity", f"""
    WITH {HITS}, {WRONG} SELECT r.name, count(wr.finding_id) AS n FROM v_roster r LEFT JOIN wr ON wr.name = r.name AND reason = '' GROUP BY r.name""")
def _(t):
    return P.findings_per_entity(t.v_case_claims, t.v_roster)


@query("D10_thin_entities", """
    WITH m AS (SELECT list_sort(list(findings))[cast(floor(count(*) / 2) AS bigint) + 1] AS median FROM v_coverage)
    SELECT lead AS name, findings AS n, median, cast(greatest(3, floor(median * 0.5)) AS bigint) AS floor FROM v_coverage, m
    WHERE findings < greatest(3, floor(median * 0.5))""")
def _(t):
    return P.thin_entities(t.v_coverage.select(F.col("lead").alias("name"), F.col("findings").alias("n")))


@query("C17_contribute", f"""
    WITH {KNOWN}, sn AS (SELECT *, lower(list_extract(string_split(name, ' '), -1)) AS k FROM v_cards),
    inc AS (SELECT claim_id, claim FROM v_incoming UNION ALL SELECT doc_id + 500000000, claim FROM v_case_claims),
    known2 AS (SELECT claim_id FROM kn UNION SELECT i.claim_id FROM (SELECT claim_id, list_distinct(regexp_extract_all(lower(claim), '[a-z]{{4,}}')) AS ws FROM inc WHERE claim_id >= 500000000) i
        JOIN e ON len(e.ws) > 0 AND len(i.ws) > 0 AND len(list_intersect(i.ws, e.ws)) / greatest(1, least(len(i.ws), len(e.ws)))::double >= 0.6),
    {conflict_sql("SELECT claim_id, name, claim, role, employer, born, died FROM (SELECT * FROM inc WHERE claim_id >= 500000000) inc JOIN sn ON contains(lower(claim), k)")}
    SELECT claim_id, CASE WHEN {sql_rx('claim', V.META)} THEN 'self_description'
        WHEN len(list_distinct(regexp_extract_all(lower(claim), '[a-z]{{4,}}'))) < 4 OR claim_id IN (SELECT claim_id FROM known2) THEN 'duplicate'
        WHEN claim_id IN (SELECT claim_id FROM cf WHERE hard IS NOT NULL) THEN 'namesake' ELSE 'added' END AS reason FROM inc""")
def _(t):
    new = t.v_incoming.select("claim_id", "claim").union(
        t.v_case_claims.select(F.col("doc_id") + 500000000, "claim"))
    return L.contribute(new, t.v_existing, t.v_cards).select("claim_id", "reason")


MENT = f"m AS (SELECT finding_id, unnest(list_distinct({NAMES_SQL})) AS name FROM v_case_claims)"
ORG = f"o AS (SELECT finding_id, org FROM (SELECT finding_id, claim, unnest([{sql_list(V.ORG_CUES)}]) AS org FROM v_case_claims) WHERE contains(lower(claim), org))"
NO = f"{MENT}, {ORG}, no AS (SELECT DISTINCT org, name FROM o JOIN m USING (finding_id))"


@query("C18_shared_org", f"""
    WITH {NO}, s AS (SELECT org, count(*) AS n_names FROM no GROUP BY org HAVING count(*) >= 2) SELECT org, name, n_names FROM no JOIN s USING (org)""")
def _(t):
    return P.shared_org(P.mentions(t.v_case_claims), P.org_mentions(t.v_case_claims))


@query("C19_non_connections", f"""
    WITH {NO} SELECT DISTINCT least(entity_a, entity_b) AS entity_a, greatest(entity_a, entity_b) AS entity_b FROM v_links l
    WHERE entity_a <> entity_b AND NOT EXISTS (SELECT 1 FROM no a JOIN no b ON a.org = b.org WHERE a.name = l.entity_a AND b.name = l.entity_b)""")
def _(t):
    return P.non_connections(t.v_links, P.mentions(t.v_case_claims), P.org_mentions(t.v_case_claims))


@query("C20_missing_entities", f"""
    WITH {MENT}, c AS (SELECT DISTINCT lower({sql_squash('name')}) AS name FROM m), r AS (SELECT DISTINCT lower(name) AS name FROM v_roster),
    g AS (SELECT name FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE contains(c.name, r.name) OR contains(r.name, c.name)))
    SELECT name, (SELECT count(*) FROM g) AS n_total FROM g ORDER BY name LIMIT 20""")
def _(t):
    return P.missing_entities(P.mentions(t.v_case_claims), t.v_roster, 20).withColumn("name", F.lower("name"))


@query("C21_omitted_names", """
    SELECT DISTINCT report_id, name FROM v_profiles JOIN v_reports USING (report_id)
    WHERE NOT contains(lower(text), lower(list_extract(string_split(name, ' '), -1)))""")
def _(t):
    return P.omitted_names(t.v_reports, t.v_profiles)


QK = r"rtrim(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '?. ')"


@query("C22_unseen", f"""
    SELECT question_id, branch_id FROM v_questions q WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT branch_id, {QK} AS k FROM v_asked) a WHERE a.branch_id = q.branch_id AND a.k = {QK.replace('text', 'q.text')})""")
def _(t):
    return L.unseen(t.v_questions, t.v_asked).select("question_id", "branch_id")


def sig_sql(e: str) -> str:
    return (f"list_distinct(list_filter([lower(w) for w in regexp_extract_all({e}, '[A-Za-z0-9'']+')], lambda w: length(w) >= 4 "
            f"AND w NOT IN ({sql_list(V.STOPWORDS)}) AND w NOT IN ({sql_list(V.WEAK_TOKENS)})))")


@query("C23_relevant_feeds", f"""
    WITH a AS (SELECT topic_id, unnest({sig_sql('topic')}) AS w FROM v_topics), f AS (SELECT feed_id, unnest({sig_sql("title || ' ' || author")}) AS w FROM v_feeds),
    p AS (SELECT DISTINCT topic_id, feed_id FROM a JOIN f USING (w)) SELECT topic_id, count(*) AS feeds, cast(sum(feed_id) AS bigint) AS id_sum FROM p GROUP BY topic_id""")
def _(t):
    return L.relevant_feeds(t.v_topics, t.v_feeds).groupBy("topic_id").agg(
        F.count("*").alias("feeds"), F.sum("feed_id").alias("id_sum"))


@query("C24_matching_episodes", """
    WITH k AS (SELECT DISTINCT lower(list_extract(string_split(text, ' '), 2)) AS token FROM benchmark WHERE length(list_extract(string_split(text, ' '), 2)) >= 4),
    h AS (SELECT doc_id AS episode_id, source AS "show" FROM documents WHERE EXISTS (SELECT 1 FROM k WHERE contains(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), token))),
    r AS (SELECT *, row_number() OVER (PARTITION BY "show" ORDER BY episode_id) AS rank, count(*) OVER (PARTITION BY "show") AS n_total FROM h)
    SELECT episode_id, "show", rank, n_total FROM r WHERE rank <= 3""")
def _(t):
    tokens = t.benchmark.select(F.lower(F.get(F.split("text", " "), 1)).alias("token")).filter(F.length("token") >= 4)
    eps = t.documents.select(F.col("doc_id").alias("episode_id"), F.col("source").alias("show"), "text")
    return L.matching_episodes(eps, tokens, 3).select("episode_id", "show", "rank", "n_total")


SAME = """(a.t[1] = b.t[1] AND (a.t[-1] = b.t[-1] OR len(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) = 0
    OR len(list_filter(b.t, lambda x: NOT list_contains(a.t, x))) = 0))"""

CANDS = f"""{MENT}, cn AS (SELECT name, count(*) AS n FROM m WHERE {PLAUSIBLE_SQL} GROUP BY name),
    cu AS (SELECT name, n FROM cn WHERE NOT EXISTS (SELECT 1 FROM (SELECT lower(name) AS k, string_split(lower(name), ' ') AS t FROM v_few) b,
           (SELECT lower(cn.name) AS l, string_split(lower(cn.name), ' ') AS t) a WHERE contains(l, k) OR contains(k, l) OR {SAME})),
    v_few AS (SELECT name FROM v_cards)""".replace("v_few", "few")
CANDS = CANDS.replace(MENT + ",", "few AS (SELECT name FROM v_cards), " + MENT + ",").rsplit(",\n    few AS", 1)[0]


@query("C25_unknown_candidates", f"WITH {CANDS} SELECT name, n FROM cu")
def _(t):
    return P.unknown_candidates(P.mentions(t.v_case_claims), t.v_cards)


def works(t):
    return t.v_works.withColumn("referenced_works", F.array("ref_a", "ref_b"))


@query("C26_expand_refs", """
    WITH RECURSIVE w AS (SELECT *, CASE WHEN oa_url IS NULL AND (abstract IS NULL OR abstract = '') THEN 'gated' WHEN oa_url IS NOT NULL THEN 'oa_fulltext' ELSE 'abstract' END AS kind FROM v_works),
    e AS (SELECT work_id, ref_a AS ref_id FROM w UNION ALL SELECT work_id, ref_b FROM w),
    walk AS (SELECT item_id AS work_id, 0 AS lvl FROM benchmark UNION
             SELECT e.ref_id, lvl + 1 FROM walk JOIN e ON e.work_id = walk.work_id JOIN w ON w.work_id = walk.work_id AND (walk.lvl = 0 OR w.kind <> 'gated') WHERE lvl < 3),
    f AS (SELECT work_id, min(lvl) AS level FROM walk WHERE lvl > 0 GROUP BY 1)
    SELECT f.work_id, cast(level AS int) AS level, kind, (SELECT count(*) FROM f) AS n_total FROM f JOIN w USING (work_id)""")
def _(t):
    return G.expand_refs(works(t), t.benchmark.select(F.col("item_id").alias("work_id")), depth=3, max_refs=25).select(
        "work_id", "level", "kind", "n_total")


@query("C27_cited_by", """
    WITH e AS (SELECT work_id, ref_a AS ref_id, cited_count, pub_year FROM v_works UNION SELECT work_id, ref_b, cited_count, pub_year FROM v_works),
    r AS (SELECT ref_id, work_id, cited_count, row_number() OVER (PARTITION BY ref_id ORDER BY cited_count DESC, work_id) AS rank
          FROM e WHERE pub_year >= 2012 AND ref_id IN (SELECT doc_id FROM labels))
    SELECT ref_id, work_id, cited_count, rank FROM r WHERE rank <= 3""")
def _(t):
    return G.cited_by(works(t), t.labels.select(F.col("doc_id").alias("work_id")), since_year=2012, k=3).select(
        "ref_id", "work_id", "cited_count", "rank")


@query("C28_gated_leads", """
    SELECT work_id, branch_id, 'gated' AS gap_type, 'LOCKED LEAD — ' || coalesce(doi, landing_page_url, cast(work_id AS varchar)) AS question
    FROM v_works WHERE oa_url IS NULL AND (abstract IS NULL OR abstract = '')""")
def _(t):
    return G.gated_leads(t.v_works).select("work_id", "branch_id", "gap_type", "question")


_VV = ("CASE WHEN n_chars % 4 = 0 THEN 'Supported' WHEN n_chars % 4 = 1 THEN 'contradicted' WHEN n_chars % 4 = 2 THEN 'insufficient' ELSE NULL END")


@query("C32_verify_tally", f"""
    WITH q AS (SELECT finding_id, {_VV} AS v FROM v_findings ORDER BY CASE WHEN lower(coalesce(confidence_tier, '')) LIKE 'spec%' THEN 0 ELSE 1 END, finding_id)
    SELECT CASE WHEN lower(v) IN ('supported', 'contradicted', 'insufficient') THEN lower(v) ELSE 'error' END AS verdict, count(*) AS n FROM q GROUP BY 1""")
def _(t):
    v = t.v_findings.select("finding_id", F.expr(_VV).alias("verdict"))
    return L.verify_tally(L.verify_queue(t.v_findings), v)


_OWN = "own AS (SELECT q.item_id AS query_id, d.doc_id FROM benchmark q JOIN documents d ON lower(trim(q.text)) = lower(trim(d.text))), "
_HYX = (HY.replace("FROM sc WHERE score > 0", "FROM sc WHERE score > 0 AND (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM own)")
        .replace("IN (SELECT item_id FROM benchmark)", "IN (SELECT item_id FROM benchmark) AND (a.vec_id, b.vec_id) NOT IN (SELECT query_id, doc_id FROM own)")
        .replace("rank <= 20", "rank <= 24"))


@query("C32_verify_evidence", f"""
    WITH {_OWN}{_HYX} SELECT y.query_id, y.doc_id, y.rank AS place, coalesce(k.score, 0.0) AS score FROM hy y
    LEFT JOIN kn k ON k.query_id = y.query_id AND k.doc_id = y.doc_id AND k.rank <= 24 WHERE y.rank <= 6""")
def _(t):
    return L.verify_evidence(hybrid_queries(t), t.documents, t.v_probes)


_LK = ("SELECT entity_a, entity_b, CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS conf, CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS nonl, "
       "CASE WHEN n % 5 = 0 THEN 'verified' WHEN n % 5 = 1 THEN 'Debunked' WHEN n % 5 = 2 THEN 'open' ELSE NULL END AS lv FROM v_links")


@query("C33_check_links", f"""
    WITH l AS ({_LK}), p AS (SELECT least(entity_a, entity_b) AS a, greatest(entity_a, entity_b) AS b, conf, nonl, lv FROM l),
    g AS (SELECT a, b, max(conf) AS conf, max(nonl) AS nonl, max(lv) AS lv FROM p GROUP BY 1, 2)
    SELECT CASE WHEN g.nonl = 1 THEN 'debunked' WHEN g.conf = 1 OR g.lv = 'verified' THEN 'supported' WHEN g.lv = 'Debunked' THEN 'debunked'
                WHEN g.lv = 'open' THEN 'unresolved-notable' ELSE 'unverified' END AS status, count(*) AS n
    FROM p JOIN g ON g.a = p.a AND g.b = p.b GROUP BY 1""")
def _(t):
    l = t.sql(_LK)
    out = L.check_links(l.select("entity_a", "entity_b"), l.filter("conf = 1").select(F.col("entity_b").alias("entity_a"), F.col("entity_a").alias("entity_b")),
                        l.filter("nonl = 1"), l.select("entity_a", "entity_b", F.col("lv").alias("verdict")))
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query("C34_anchors", f"""
    WITH c AS (SELECT lower(name) AS card, name FROM v_cards), ph AS (
      SELECT lower(name) AS card, array_to_string(list_slice(string_split(
        trim(CASE WHEN p = '' OR contains(lower(er), lower(p)) THEN er ELSE er || ' ' || p END), ' '), 1, 6), ' ') AS phrase
      FROM (SELECT name, {sql_squash('place')} AS p, trim(CASE WHEN {sql_squash('role')} = '' OR contains(lower({sql_squash('employer')}), lower({sql_squash('role')}))
            THEN {sql_squash('employer')} ELSE {sql_squash('employer')} || ' ' || {sql_squash('role')} END) AS er FROM v_cards)),
    k AS (SELECT entity_id, lower(payload) AS key FROM (SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN name ELSE list_extract(string_split(name, ' '), -1) END AS payload FROM v_entity_ctx)),
    b AS (SELECT key, min(card) AS card FROM (SELECT DISTINCT key FROM k) k2 JOIN c ON key = card OR (length(key) > 3 AND contains(card, key)) GROUP BY key)
    SELECT entity_id, coalesce(nullif(phrase, ''), 'case terms') AS anchor FROM k LEFT JOIN b USING (key) LEFT JOIN ph USING (card)""")
def _(t):
    pay = t.v_entity_ctx.select("entity_id", F.when(F.col("entity_id") % 2 == 0, F.col("name")).otherwise(
        F.element_at(F.split("name", " "), -1)).alias("payload"))
    return L.anchors(pay, t.v_cards, "case terms").select("entity_id", "anchor")


_DOMS = sorted({d for _, doms in V.REGISTRY.values() for d in doms})


@query("C35_review_queue", f"""
    WITH u AS (SELECT page_id AS pos, page_id % 20 AS batch, url FROM pages UNION ALL SELECT page_id, page_id % 20, 'https://www.nature.com/' || page_id FROM pages),
    d AS (SELECT batch, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\\.', '') AS domain, min(pos) AS pos FROM u GROUP BY 1, 2),
    k AS (SELECT * FROM d WHERE domain <> '' AND domain NOT IN ({sql_list(_DOMS)}) AND domain NOT LIKE 'm.%'),
    r AS (SELECT batch, domain, row_number() OVER (PARTITION BY batch ORDER BY pos, domain) AS rank FROM k) SELECT * FROM r WHERE rank <= 3""")
def _(t):
    u = t.pages.select(F.col("page_id").alias("pos"), (F.col("page_id") % 20).alias("batch"), "url")
    u = u.union(u.select("pos", "batch", F.concat(F.lit("https://www.nature.com/"), F.col("pos").cast("string"))))
    done = t.pages.select(X.domain_of(F.col("url")).alias("domain")).filter("domain LIKE 'm.%'")
    return L.review_queue(u, done, 3).select("batch", "domain", "rank")


_GR = "CASE WHEN question_id % 4 = 0 THEN 'C' WHEN question_id % 4 = 1 THEN 'F' ELSE 'A' END"
_RW = "CASE WHEN question_id % 5 = 0 THEN '  ' WHEN question_id % 5 = 1 THEN NULL ELSE ' What happened? ' END"


@query("C36_apply_gate", f"""
    SELECT question_id AS lead_id, CASE WHEN ({sql_bad('text')} <> '' OR NOT starts_with(lower(text), 'verify the identity')) AND {_GR} IN ('C', 'F')
           AND trim(coalesce({_RW}, '')) <> '' THEN trim({_RW}) ELSE text END AS lead FROM v_questions""")
def _(t):
    q = t.v_questions.select(F.col("question_id").alias("lead_id"), F.col("text").alias("lead"), F.expr(_GR).alias("grade"), F.expr(_RW).alias("rewrite"))
    return L.apply_gate(q.select("lead_id", "lead"), q.select("lead_id", "grade", "rewrite"))
