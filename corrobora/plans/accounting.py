"""Queries for counts, coverage and progress."""
from pyspark.sql import functions as F

from corrobora.functions import vocab as V
from corrobora.operators import accounting as A, lexical as L
from corrobora.operators.evidence import label_counts
from corrobora.plans.catalog import query
from corrobora.plans.expressions import sql_bad, sql_map, sql_rx, sql_words
from corrobora.plans.retrieval import HY, hybrid_queries
from corrobora.plans.scans import sql_list


@query("D3_buckets", f"""
    WITH l AS (SELECT unnest(['well-supported', 'contested', 'unverified', 'disproven']) AS label)
    SELECT l.label, count(f.finding_id) AS n FROM l LEFT JOIN v_findings f ON l.label = {sql_map('confidence_tier', V.STANDARD_LABEL, "'unverified'")} GROUP BY 1""")
def _(t):
    return label_counts(t.v_findings)


LANE = "unnest(list_distinct(CASE WHEN source_types IS NULL OR len(source_types) = 0 THEN ['{}'] ELSE source_types END))"
MIX = f"mx AS (SELECT lane, count(*) AS n FROM (SELECT {LANE.format('web')} AS lane FROM v_findings) GROUP BY 1)"


@query("D4_organ_mix", f"WITH {MIX} SELECT lane, n FROM mx")
def _(t):
    return A.organ_mix(t.v_findings)


@query("D5_contribution_ledger", f"""
    WITH {MIX}, l AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in V.LANES.items())}) x(lane, title)),
    r AS (SELECT lane, title, coalesce(n, 0) AS n, coalesce(sum(CASE WHEN lane IN ('abstract', 'secondary_review') THEN n END) OVER (), 0) AS papers FROM l LEFT JOIN mx USING (lane))
    SELECT title, n, CASE WHEN lane IN ('abstract', 'secondary_review') AND papers = 0 THEN 'N/A (no academic sources in case)' WHEN n = 0 THEN 'DEAD (0 findings)'
           WHEN n < 5 THEN 'weak (barely fired)' ELSE 'firing' END AS status FROM r""")
def _(t):
    return A.contribution_ledger(A.organ_mix(t.v_findings))


_TV = "CASE WHEN lower(trim(verdict)) IN ('keep', 'context', 'reject') THEN lower(trim(verdict)) ELSE 'keep' END"
_TS = "count(*) FILTER (v = 'keep') AS keep, count(*) FILTER (v = 'context') AS context, count(*) FILTER (v = 'reject') AS reject, count(*) AS total"


@query("D7_triage_stats", f"""
    WITH x AS (SELECT file, {_TV} AS v FROM v_verdicts) SELECT file, {_TS} FROM x GROUP BY file UNION ALL SELECT 'ALL', {_TS} FROM x""")
def _(t):
    return A.triage_stats(t.v_verdicts)


@query("D8_tallies", """
    SELECT report_id, status, count(*) AS n, count(*) FILTER (coalesce(cause, '') <> '') AS with_cause FROM v_profiles GROUP BY 1, 2""")
def _(t):
    return A.tallies(t.v_profiles)


@query("D11_coverage_audit", f"""
    WITH f AS (SELECT finding_id, doc_id IN (SELECT doc_id FROM labels) AS rd, {LANE.format('(none)')} AS lane FROM v_findings)
    SELECT lane, count(*) AS gathered, count(*) FILTER (NOT rd) AS unread, round_even(100.0::double * count(*) FILTER (NOT rd) / count(*), 1) AS pct_lost FROM f GROUP BY 1""")
def _(t):
    read = t.labels.select(F.concat(F.lit("find_"), F.col("doc_id").cast("string")).alias("finding_id"))
    return A.coverage_audit(t.v_findings, read)


@query("D11_strongest_unread", """
    WITH u AS (SELECT * FROM v_findings WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND confidence_tier IN ('Accepted', 'Moderately Accepted'))
    SELECT finding_id, confidence_tier, corroboration_count, (SELECT count(*) FROM u) AS n_total FROM u ORDER BY corroboration_count DESC, finding_id LIMIT 15""")
def _(t):
    read = t.labels.select(F.concat(F.lit("find_"), F.col("doc_id").cast("string")).alias("finding_id"))
    return A.strongest_unread(t.v_findings, read, 15)


_CITED = "SELECT doc_id, source_types, {a}('https://' || lang || '.example.org/' || cast(cast(floor(n_chars / 50) as bigint) as {s})) AS urls FROM (SELECT d.lang, f.* FROM v_findings f JOIN documents d ON d.doc_id = f.doc_id) x"


@query("D12_collect_sources", f"""
    WITH c AS (SELECT doc_id, source_types, unnest(urls) AS url FROM ({_CITED.format(a='list_value', s='varchar')}))
    SELECT url, min(doc_id) AS first_seen, arg_min(CASE WHEN source_types IS NULL OR len(source_types) = 0 THEN 'web' ELSE source_types[1] END, doc_id) AS source_type FROM c GROUP BY url""")
def _(t):
    return A.collect_sources(t.sql(_CITED.format(a="array", s="string")))


@query("D15_goal_progress", f"""
    WITH {HY}, h AS (SELECT y.query_id, y.doc_id, y.rank, coalesce(k.score, 0.0) AS score FROM hy y LEFT JOIN kn k ON k.query_id = y.query_id AND k.doc_id = y.doc_id AND k.rank <= 12 WHERE y.rank <= 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS r FROM h),
    s AS (SELECT count(*) AS n, count(*) FILTER (confidence_tier IN ('Accepted', 'Moderately Accepted') AND score >= 0.4) AS c
          FROM benchmark q LEFT JOIN b ON b.query_id = q.item_id AND r = 1 LEFT JOIN v_findings f ON f.doc_id = b.doc_id)
    SELECT c AS n_covered, n - c AS n_open, CASE WHEN c / n >= 0.66 THEN 'substantial' WHEN c / n >= 0.33 THEN 'partial' ELSE 'limited' END AS proximity,
           CASE WHEN c <= (SELECT count(*) FILTER (item_id % 2 = 0) FROM benchmark) THEN 1 ELSE 0 END AS plateauing FROM s""".replace("rank <= 20", "rank <= 12"))
def _(t):
    hits = L.hybrid(hybrid_queries(t), t.documents, t.v_probes, 3)
    crit = t.benchmark.select(F.col("item_id").alias("query_id"))
    prev = t.benchmark.select((F.col("item_id") % 2 == 0).alias("covered"))
    return A.goal_progress(crit, hits, t.v_findings, prev).select(
        "n_covered", "n_open", "proximity", F.col("plateauing").cast("int").alias("plateauing"))


@query("D16_saturation", """
    SELECT run_id, cycle, CASE WHEN kb_reuse = 1 THEN 'continue' WHEN novel + incremental + redundant = 0 THEN 'failed'
           WHEN novel / (novel + incremental + redundant) < 0.1 THEN 'saturated' ELSE 'continue' END AS state FROM v_cycle_log""")
def _(t):
    return A.saturation(t.v_cycle_log).select("run_id", "cycle", "state")


@query("D17_run_delta", """
    WITH s AS (SELECT branch_id, finding_id, n_chars % 4 <> 0 AS b, n_chars % 9 <> 0 AS a FROM v_findings),
    d AS (SELECT branch_id, count(*) FILTER (b) AS n_before, count(*) FILTER (a) AS n_after, count(*) FILTER (a AND NOT b) AS added, count(*) FILTER (b AND NOT a) AS removed FROM s WHERE a OR b GROUP BY 1),
    l AS (SELECT lang AS branch_id, count(*) AS asked, cast(sum(n_chars % 3) AS bigint) AS contested_marked, count(*) FILTER (n_chars % 8 = 0) AS reused FROM documents GROUP BY 1)
    SELECT * FROM d JOIN l USING (branch_id)""")
def _(t):
    before = t.v_findings.filter("n_chars % 4 <> 0")
    after = t.v_findings.filter("n_chars % 9 <> 0")
    log = t.documents.select(F.col("lang").alias("branch_id"), F.col("text").alias("question"), (F.col("n_chars") % 3).alias("n_contested"),
                             (F.col("n_chars") % 8 == 0).alias("kb_reuse"))
    return A.run_delta(before, after, log)


@query("D19_lean_card", """
    WITH c AS (SELECT model, cast(coalesce(sum(softening) FILTER (protocol = 'on'), 0) AS bigint) AS softening_on, cast(coalesce(sum(softening) FILTER (protocol = 'off'), 0) AS bigint) AS softening_off,
      cast(coalesce(sum(stripping) FILTER (protocol = 'on'), 0) AS bigint) AS stripping_on, cast(coalesce(sum(stripping) FILTER (protocol = 'off'), 0) AS bigint) AS stripping_off FROM v_scores GROUP BY 1)
    SELECT *, softening_off + stripping_off - softening_on - stripping_on AS helps FROM c""")
def _(t):
    return A.lean_card(t.v_scores)


_AB = "SELECT conv_id AS pair, CASE WHEN role = 'user' THEN 'old' ELSE 'new' END AS arm, 1 AS findings FROM conversations"


@query("D20_ab_compare", f"""
    WITH a AS ({_AB}) SELECT cast(pair AS varchar) AS pair, count(*) FILTER (arm = 'old') AS old_n, count(*) FILTER (arm = 'new') AS new_n FROM a GROUP BY pair
    UNION ALL SELECT 'TOTAL', count(*) FILTER (arm = 'old'), count(*) FILTER (arm = 'new') FROM a""")
def _(t):
    return A.ab_compare(t.sql(_AB))


@query("D21_retention", """
    SELECT report_id, count(*) FILTER (contains(lower(text), lower(term))) AS kept, count(*) FILTER (NOT contains(lower(text), lower(term))) AS dropped
    FROM (SELECT report_id, unnest([name, coalesce(cause, 'nothing'), status]) AS term FROM v_profiles) JOIN v_reports USING (report_id) GROUP BY 1""")
def _(t):
    terms = t.v_profiles.select("report_id", F.explode(F.array("name", F.coalesce("cause", F.lit("nothing")), "status")).alias("term"))
    return A.retention(t.v_reports, terms)


@query("D22_coverage_score", f"""
    WITH p AS (SELECT report_id, slot, lower(list_extract(string_split(name, ' '), -1)) AS sn, text, lower(text) AS low FROM v_profiles JOIN v_reports USING (report_id)),
    s AS (SELECT report_id, slot, contains(low, sn) AS named, text, list_slice([i for i in generate_series(1, length(low)) if substr(low, i, length(sn)) = sn], 1, 3) AS ps FROM p),
    g AS (SELECT report_id, named, coalesce(array_to_string([substr(text, greatest(i - 120, 1), i + 400 - greatest(i - 120, 1)) for i in ps], ' '), '') AS seg FROM s)
    SELECT report_id, count(*) FILTER (named) AS named, count(*) FILTER (named AND {sql_rx('seg', V.COVER_STATUS)}) AS status,
           count(*) FILTER (named AND {sql_rx('seg', V.COVER_CAUSE)}) AS cause, count(*) FILTER (named AND {sql_rx('seg', V.COVER_WHEN)}) AS dated FROM g GROUP BY 1""")
def _(t):
    return A.coverage_score(t.v_reports, t.v_profiles)


@query("D23_monoculture", f"""
    WITH h AS (SELECT branch_id || '/' || lane AS generator, lower(array_to_string(list_slice({sql_words('text')}, 1, 3), ' ')) AS head FROM v_questions WHERE len({sql_words('text')}) > 0)
    SELECT generator, count(*) AS n, count(DISTINCT head) AS openings, CASE WHEN count(*) >= 4 AND count(DISTINCT head) <= greatest(1, floor(count(*) / 4)) THEN 1 ELSE 0 END AS monoculture FROM h GROUP BY 1""")
def _(t):
    q = t.v_questions.withColumn("generator", F.concat_ws("/", "branch_id", "lane"))
    return A.monoculture(q, "generator").withColumn("monoculture", F.col("monoculture").cast("int"))


_QR = f"count(*) AS n, count(*) FILTER ({sql_bad('text')} = '') AS passed, cast(floor(sum(len({sql_words('text')})) / count(*)) AS bigint) AS avg_words FROM v_questions"


@query("D24_question_report", f"SELECT lane, {_QR} GROUP BY lane UNION ALL SELECT 'ALL', {_QR}")
def _(t):
    return A.question_report(t.v_questions)


@query("D25_coverage_rollup", """
    SELECT round_n, count(*) AS leads, cast(sum(covered) AS bigint) AS covered, cast(sum(findings) AS bigint) AS findings FROM v_coverage GROUP BY 1""")
def _(t):
    return A.coverage_rollup(t.v_coverage)
