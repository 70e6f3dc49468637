"""Queries for ordering, top-k, prioritised unions and set operations."""
from pyspark.sql import functions as F

from corrobora.functions import vocab as V
from corrobora.functions.exprs import standard_label
from corrobora.operators import ranking as R, similarity as S
from corrobora.plans.catalog import query
from corrobora.plans.expressions import sql_bad, sql_map, sql_squash
from corrobora.plans.linking import HITS
from corrobora.plans.retrieval import knn_sql, probes
from corrobora.plans.scans import sql_any, sql_list


@query("E1_top_corroborated", f"""
    WITH k AS ({knn_sql("b.node_kind = 'finding'")}), h AS (SELECT probe_id, k.vec_id, score, len(source_types) > 1 AS x, corroboration_count AS c FROM k JOIN v_index i ON i.vec_id = k.vec_id WHERE rank <= 200),
    r AS (SELECT probe_id, vec_id, row_number() OVER (PARTITION BY probe_id ORDER BY x DESC, c DESC, score DESC, vec_id) AS place FROM h) SELECT * FROM r WHERE place <= 3""")
def _(t):
    hits = S.query_index(probes(t), t.v_index, 200, kind="finding")
    return R.top_corroborated(hits, 3).select("probe_id", "vec_id", "place")


@query("E2_budget_cut", f"""
    WITH f AS (SELECT finding_id, {sql_map('confidence_tier', V.STANDARD_LABEL, "'unverified'")} AS label, length(claim) + 4 AS s, corroboration_count AS c FROM v_findings),
    r AS (SELECT *, sum(s) OVER (PARTITION BY label ORDER BY c DESC, finding_id ROWS UNBOUNDED PRECEDING) AS used, count(*) OVER (PARTITION BY label) AS n_total FROM f),
    k AS (SELECT * FROM r WHERE used <= 150000)
    SELECT finding_id, label, cast(used AS bigint) AS used, count(*) OVER (PARTITION BY label) AS n_kept, n_total FROM k""")
def _(t):
    return R.budget_cut(t.v_findings.withColumn("label", standard_label(F.col("confidence_tier"))), 150_000)


@query("E3_entity_evidence", f"""
    WITH {HITS}, r AS (SELECT name, finding_id, row_number() OVER (PARTITION BY name ORDER BY corroboration_count DESC, finding_id) AS rank, count(*) OVER (PARTITION BY name) AS n_total
      FROM hits JOIN v_findings USING (finding_id)) SELECT * FROM r WHERE rank <= 10""")
def _(t):
    return R.entity_evidence(t.v_case_claims, t.v_roster, 10).select("name", "finding_id", "rank", "n_total")


_SRC = ["SELECT p_type AS item, p_partkey AS pos FROM part", "SELECT p_brand AS item, p_partkey AS pos FROM part",
        "SELECT c_mktsegment AS item, c_custkey AS pos FROM customer", "SELECT p_name AS item, p_partkey AS pos FROM part"]


@query("E4_ordered_distinct", f"""
    WITH u AS ({' UNION ALL '.join(f"SELECT item, {i} AS prio, cast(pos AS bigint) AS pos FROM ({s})" for i, s in enumerate(_SRC))}),
    m AS (SELECT item, min((prio, pos)) AS m FROM u WHERE trim(item) <> '' GROUP BY item)
    SELECT item, m[1] AS prio, m[2] AS pos, (SELECT count(*) FROM m) AS n_total FROM m ORDER BY 2, 3, 1 LIMIT 60""")
def _(t):
    return R.ordered_distinct([t.sql(s) for s in _SRC], 60)


@query("E5_rotate_angles", f"""
    WITH r AS (SELECT s_suppkey AS entity_id, s_nationkey AS case_id, s_name AS name, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 7 AS slot FROM supplier)
    SELECT entity_id, cast(slot AS int) AS slot, replace([{', '.join("'" + x.replace("'", "''") + "'" for x in V.LEAD_TEMPLATES)}][slot + 1], '{{n}}', name) AS lead FROM r""")
def _(t):
    e = t.supplier.select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("case_id"), F.col("s_name").alias("name"))
    return R.rotate_angles(e).select("entity_id", "slot", "lead")


THREADS = """th AS (SELECT 'No evidence found for: ' || lead AS item, 0 AS prio, lead_id AS pos FROM v_coverage WHERE covered = 0
    UNION ALL SELECT 'Still live — not resolved: ' || hypothesis, 1, hyp_id FROM v_hypotheses WHERE lower(trim(verdict)) IN ('survives', 'weakened')
    UNION ALL SELECT 'Unresolved claim (' || verdict || '): ' || claim, 2, claim_id FROM v_ledger WHERE verdict IN ('unproven', 'contested', 'hearsay')
    UNION ALL SELECT 'Anomaly not put to rest: ' || text, 3, item_id FROM benchmark),
    ot AS (SELECT item, min((prio, pos)) AS m FROM th GROUP BY item)"""


def threads(t, cap):
    an = t.benchmark.select(F.col("text").alias("anomaly"), F.col("item_id").alias("pos"))
    return R.open_threads(t.v_coverage, t.v_hypotheses, t.v_ledger, an, cap)


@query("E6_open_threads", f"WITH {THREADS} SELECT item, m[1] AS prio, m[2] AS pos, (SELECT count(*) FROM ot) AS n_total FROM ot ORDER BY 2, 3, 1 LIMIT 15")
def _(t):
    return threads(t, 15)


@query("E7_next_questions", f"""
    WITH {THREADS}, t AS (SELECT {sql_squash('item')} AS q, 0 AS prio, m[2] AS pos, 0 AS lead_id FROM ot),
    c AS (SELECT lead_id, findings FROM v_coverage WHERE covered = 1 ORDER BY findings DESC, lead_id LIMIT 4),
    f AS (SELECT {sql_squash('text')} AS q, 1 AS prio, -findings AS pos, lead_id FROM (SELECT o_custkey AS lead_id, 'What about order ' || (o_orderkey % 50) || '?' AS text FROM orders) JOIN c USING (lead_id)),
    a AS (SELECT * FROM t UNION ALL SELECT * FROM f), k AS (SELECT * FROM a WHERE q <> '' AND {sql_bad('q')} = ''),
    g AS (SELECT min((prio, pos, lead_id, q)) AS m FROM k GROUP BY lower(q)) SELECT m[4] AS q, m[1] AS prio, m[2] AS pos FROM g""")
def _(t):
    fu = t.orders.select(F.col("o_custkey").alias("lead_id"), F.concat(F.lit("What about order "), (F.col("o_orderkey") % 50).cast("string"), F.lit("?")).alias("text"))
    return R.next_questions(threads(t, None), t.v_coverage, fu, 4).drop("n_total")


_PAT = """SELECT l_orderkey AS pattern_id, CASE WHEN min(l_returnflag) = 'A' THEN 'unresolved-notable' WHEN min(l_returnflag) = 'N' THEN 'supported' ELSE 'debunked' END AS verdict,
    count(*) AS n_links, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS touches_fact FROM lineitem GROUP BY l_orderkey"""


@query("E8_rank_patterns", f"""
    SELECT pattern_id, verdict, n_links, row_number() OVER (ORDER BY CASE verdict WHEN 'unresolved-notable' THEN 1 WHEN 'supported' THEN 2 ELSE 4 END,
           n_links DESC, touches_fact DESC, pattern_id) AS place FROM ({_PAT})""")
def _(t):
    return R.rank_patterns(t.sql(_PAT)).select("pattern_id", "verdict", "n_links", "place")


@query("E9_ach_table", """
    WITH h AS (SELECT hyp_id, CASE WHEN lower(trim(verdict)) IN ('survives', 'weakened', 'refuted') THEN lower(trim(verdict)) ELSE 'weakened' END AS verdict, len(disconfirming) AS n FROM v_hypotheses)
    SELECT hyp_id, verdict, cast(n AS int) AS n_disconfirming, rank() OVER (ORDER BY n) AS rank FROM h""")
def _(t):
    return R.ach_table(t.v_hypotheses).select("hyp_id", "verdict", "n_disconfirming", "rank")


@query("E10_frontier", """
    WITH r AS (SELECT lead_id, round_n, findings, row_number() OVER (PARTITION BY round_n ORDER BY findings DESC, lead_id) AS rank FROM v_coverage
      WHERE covered = 1 AND lead_id NOT IN (SELECT s_suppkey FROM supplier))
    SELECT lead_id, round_n, findings, rank FROM r WHERE rank <= 8 ORDER BY round_n, rank LIMIT 14""")
def _(t):
    asked = t.supplier.select(F.col("s_suppkey").alias("lead_id"))
    return R.frontier(t.v_coverage, asked, 8, 14).select("lead_id", "round_n", "findings", "rank")


_HITS = """SELECT o_custkey AS lead_id, o_orderkey % 3 AS variant, o_orderkey AS pos,
    CASE WHEN o_orderkey % 4 = 0 THEN 'https://doi.org/10.1/' ELSE 'https://blog.example.com/' END || cast(o_orderkey % 6 as {s}) AS url FROM orders"""


@query("E11_rank_hits", f"""
    WITH h AS ({_HITS.format(s='varchar')}), f AS (SELECT lead_id, url, min((variant, pos)) AS m FROM h GROUP BY 1, 2),
    r AS (SELECT lead_id, url, row_number() OVER (PARTITION BY lead_id ORDER BY CASE WHEN {sql_any('url', V.PRIMARY_HINTS)} THEN 0 ELSE 1 END, m, url) AS rank FROM f)
    SELECT * FROM r WHERE rank <= 4""")
def _(t):
    return R.rank_hits(t.sql(_HITS.format(s="string")), 4)


@query("F1_union_lanes", """
    SELECT doc_id AS id, lang AS extra, 'documents' AS lane FROM documents UNION ALL SELECT page_id, NULL, 'pages' FROM pages
    UNION ALL SELECT item_id, NULL, 'benchmark' FROM benchmark""")
def _(t):
    return R.union_lanes(documents=t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("extra")),
                         pages=t.pages.select(F.col("page_id").alias("id")), benchmark=t.benchmark.select(F.col("item_id").alias("id")))


@query("F2_with_contested", """
    WITH h AS (SELECT finding_id FROM v_findings WHERE corroboration_count >= 4)
    SELECT finding_id, 'relevance' AS via FROM h UNION ALL SELECT finding_id, 'contested' FROM v_findings WHERE confidence_tier = 'Controversial' AND finding_id NOT IN (SELECT finding_id FROM h)""")
def _(t):
    f = t.v_findings.select("finding_id", "corroboration_count", "confidence_tier")
    return R.with_contested(f.filter("corroboration_count >= 4"), f.filter("confidence_tier = 'Controversial'")).select("finding_id", "via")


@query("F3_exclude", "SELECT finding_id FROM v_findings EXCEPT SELECT finding_id FROM v_verdicts WHERE trim(lower(verdict)) = 'reject'")
def _(t):
    return R.exclude(t.v_findings, t.v_verdicts.filter("trim(lower(verdict)) = 'reject'")).select("finding_id")


@query("F4_useful", """
    SELECT DISTINCT finding_id FROM v_verdicts WHERE CASE WHEN lower(trim(verdict)) IN ('keep', 'context', 'reject') THEN lower(trim(verdict)) ELSE 'keep' END <> 'reject'""")
def _(t):
    return R.useful(t.v_verdicts.unionByName(t.v_verdicts))


@query("F5_shared_tokens", """
    SELECT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) INTERSECT
    SELECT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark)""")
def _(t):
    from corrobora.functions.text import words4
    one = lambda df: df.select(F.explode(words4(F.col("text"))).alias("w"))
    return one(t.documents).intersect(one(t.benchmark))
