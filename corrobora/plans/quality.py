"""Queries for transcript, document and report checks, and the function surfaces."""
from pyspark.sql import functions as F

from corrobora.functions import vocab as V
from corrobora.operators import quality as Q
from corrobora.operators.verdicts import with_verdicts
from corrobora.plans.catalog import query
from corrobora.plans.expressions import _ANGLES, sql_bad, sql_rx, sql_squash, sql_words
from corrobora.plans.scans import sql_list
from corrobora.session import spread

_REL = "CASE WHEN doc_id % 6 = 0 THEN 'no' WHEN doc_id % 6 = 1 THEN 'broken' WHEN doc_id % 6 = 2 THEN NULL ELSE 'yes' END"


@query("J1_validate_transcripts", f"""
    WITH x AS (SELECT url, len({sql_words('text')}) AS n, CASE WHEN duration_s > 0 THEN round_even(len({sql_words('text')}) / (duration_s / 60.0::double * 150), 3) END AS r, {_REL} AS rel FROM v_transcripts)
    SELECT url, cast(n AS int) AS n_words, CASE WHEN n >= 100 THEN r END AS wordcount_ratio,
      CASE WHEN n < 100 OR coalesce(r < 0.35, false) OR coalesce(rel = 'no', false) THEN 0 ELSE 1 END AS passed,
      CASE WHEN n < 100 THEN 'under_100_words' WHEN coalesce(r < 0.35, false) THEN 'far_under_duration' ELSE
        array_to_string(list_filter([CASE WHEN r < 0.5 THEN 'wordcount_suspect' END, CASE WHEN rel = 'no' THEN 'irrelevant' WHEN coalesce(rel <> 'yes', true) THEN 'relevance_gate_error_kept' END], lambda z: z IS NOT NULL), ',') END AS reasons FROM x""")
def _(t):
    rel = t.v_transcripts.select("url", F.expr(_REL).alias("relevance"))
    return Q.validate_transcripts(t.v_transcripts, rel).select(
        "url", "n_words", "wordcount_ratio", F.col("passed").cast("int").alias("passed"), F.array_join("reasons", ",").alias("reasons"))


LINT = f"""d AS (SELECT report_id, text FROM v_reports UNION ALL SELECT -doc_id - 1, text FROM documents),
    b AS (SELECT report_id, 'banned phrase' AS kind, p AS detail FROM (SELECT report_id, lower(text) AS low, unnest([{sql_list(V.BANNED_PHRASES)}]) AS p FROM d) WHERE contains(low, p)),
    q AS (SELECT report_id, 'rhetorical question' AS kind, left(trim(s), 70) AS detail FROM (SELECT report_id, unnest(regexp_extract_all(text, '[^.!?]*\\?')) AS s FROM d) WHERE length(trim(s)) > 12),
    o AS (SELECT report_id, 'mood opener' AS kind, left(f, 70) AS detail FROM (SELECT report_id, string_split(trim(text), '.')[1] AS f FROM d)
          WHERE f <> '' AND NOT (regexp_matches(substr(f, 4), '\\b[A-Z][a-z]{{2,}}|\\b\\d+\\b') OR {sql_rx('f', V.NUMBER_WORD_ANCHOR)}))"""


@query("J2_voice_lint", f"WITH {LINT} SELECT * FROM b UNION ALL SELECT * FROM q UNION ALL SELECT * FROM o")
def _(t):
    docs = t.v_reports.union(t.documents.select((-F.col("doc_id") - 1).alias("report_id"), "text"))
    return Q.voice_lint(docs, "report_id").select("report_id", "kind", F.col("display").alias("detail"))


@query("J3_count_fidelity", reason="needs look-around; checked by goldens")
def _(t):
    return Q.count_fidelity(t.v_reports, t.v_profiles)


@query("J4_profile_fidelity", f"""
    WITH p AS (SELECT report_id, name, lower(name) AS nm, lower(list_extract(string_split(name, ' '), -1)) AS sn, status, trim(coalesce(cause, '')) AS cause, lower(text) AS low,
        list_distinct(regexp_extract_all(status || ' ' || trim(coalesce(cause, '')), '[a-z]{{4,}}')) AS w FROM v_profiles JOIN v_reports USING (report_id)),
    c AS (SELECT *, [struct_pack(o := -len(list_filter(w, lambda z: contains(substr(low, i, 320), z))), i := i, s := substr(low, i, 320)) for i in generate_series(1, length(low)) if substr(low, i, length(nm)) = nm] AS fu,
                    [struct_pack(o := -len(list_filter(w, lambda z: contains(substr(low, i, 320), z))), i := i, s := substr(low, i, 320)) for i in generate_series(1, length(low)) if substr(low, i, length(sn)) = sn] AS sh FROM p),
    g AS (SELECT *, list_min(fu) AS bf, list_min(sh) AS bs FROM c),
    s AS (SELECT *, coalesce(CASE WHEN bf IS NULL THEN bs.s WHEN bf.o < 0 THEN bf.s WHEN bs.o < bf.o THEN bs.s ELSE bf.s END, '') AS seg,
          contains(low, nm) OR contains(low, sn) AS present, list_slice(regexp_extract_all(lower(cause), '[a-z]{{4,}}'), 1, 2) AS head FROM g)
    SELECT report_id, name, 'MISSING' AS kind, 'not in the report' AS detail FROM s WHERE NOT present
    UNION ALL SELECT report_id, name, 'LOST', 'status ' || status FROM s WHERE present AND status NOT IN ('', 'unknown') AND NOT contains(seg, status)
    UNION ALL SELECT report_id, name, 'LOST', 'cause ' || left(cause, 40) FROM s WHERE present AND len(head) > 0 AND len(list_filter(head, lambda h: contains(seg, h))) = 0
    UNION ALL SELECT report_id, name, 'INVENTED', 'implies death' FROM s WHERE present AND status = 'missing' AND regexp_matches(seg, '{V.IMPLIES_DEATH}')""")
def _(t):
    return Q.profile_fidelity(t.v_reports, t.v_profiles).withColumn("detail", F.col("display")).drop("display")


_ART = "SELECT c_custkey AS artifact_id, CASE WHEN c_custkey % 2 = 0 THEN 'questions' ELSE 'findings' END AS kind, c_mktsegment || ' building order case' AS case_text FROM customer"
_SMP = "SELECT o_custkey AS artifact_id, CASE WHEN o_orderkey % 17 = 0 THEN 'ok' WHEN o_custkey % 3 = 0 THEN 'Who placed this order ' || o_orderpriority || '?' ELSE o_orderstatus || ' order number ' || cast(o_orderkey as {s}) END AS text FROM orders"


@query("J5_challenge", f"""
    WITH a AS ({_ART}), s AS ({_SMP.format(s='varchar')}), j AS (SELECT a.artifact_id, kind, case_text, text, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS ws,
        list_distinct(regexp_extract_all(lower(case_text), '[a-z]{{4,}}')) AS cs, lower(array_to_string(list_slice({sql_words('text')}, 1, 3), ' ')) AS head FROM a JOIN s USING (artifact_id)),
    p AS (SELECT artifact_id, count(*) AS n, count(*) FILTER (kind = 'questions' AND {sql_bad('text')} <> '') + count(*) FILTER (kind = 'findings' AND len(ws) > 0 AND len(cs) > 0 AND NOT list_has_any(ws, cs))
        + count(*) FILTER (len({sql_words('text')}) < 3) + CASE WHEN any_value(kind) = 'questions' AND count(*) FILTER (head <> '') >= 4 AND count(DISTINCT nullif(head, '')) <= greatest(1, floor(count(*) FILTER (head <> '') / 4)) THEN 1 ELSE 0 END AS f FROM j GROUP BY 1)
    SELECT a.artifact_id, coalesce(n, 0) AS n_samples, cast(coalesce(f, 0) AS bigint) AS n_flags, CASE WHEN coalesce(n, 0) = 0 THEN 'escalate' WHEN f > 0 THEN 'fail' ELSE 'pass' END AS verdict
    FROM a LEFT JOIN p USING (artifact_id)""")
def _(t):
    return Q.challenge(t.sql(_ART), t.sql(_SMP.format(s="string")))


_SUG = """SELECT o_custkey AS case_id, o_orderkey AS pos, CASE WHEN o_orderkey % 4 = 0 THEN 'Who in Geneva filed it?' WHEN o_orderkey % 4 = 1 THEN 'Was Customer' || ' seen near Geneva?'
    WHEN o_orderkey % 4 = 2 THEN 'what happened on day ' || cast(o_orderkey % 9 as {s}) || '?' ELSE 'Is there any record?' END AS text FROM orders"""


@query("J6_grounded", f"""
    WITH c AS (SELECT c_custkey AS case_id, lower(c_name || ' ' || c_mktsegment) AS ct FROM customer), s AS (SELECT case_id, pos, {sql_squash('text')} AS q, ct FROM ({_SUG.format(s='varchar')}) JOIN c USING (case_id)),
    k AS (SELECT *, list_filter(regexp_extract_all(q, '\\b[A-Z][a-z]{{2,}}\\b'), lambda w: lower(w) NOT IN ({sql_list(V.STOP_CAPS)})) AS caps FROM s),
    o AS (SELECT case_id, lower(q) AS lq, min((pos, q)) AS m FROM k WHERE q <> '' AND {sql_bad('q')} = '' AND (len(caps) = 0 OR len(list_filter(caps, lambda w: contains(ct, lower(w)))) > 0) GROUP BY 1, 2),
    r AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY m) AS rank, m[2] AS q, count(*) OVER (PARTITION BY case_id) AS n_total FROM o) SELECT * FROM r WHERE rank <= 3""")
def _(t):
    cases = t.customer.select(F.col("c_custkey").alias("case_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("case_text"))
    return Q.grounded(t.sql(_SUG.format(s="string")), cases, 3)


@query("J7_with_verdicts", """
    WITH p AS (SELECT list_distinct(regexp_extract_all(lower(a.claim), '[a-z]{4,}')) AS x, list_distinct(regexp_extract_all(lower(b.claim), '[a-z]{4,}')) AS y,
        list_sort(list_distinct(regexp_extract_all(a.claim, '[0-9]+'))) AS nx, list_sort(list_distinct(regexp_extract_all(b.claim, '[0-9]+'))) AS ny
        FROM v_case_claims a JOIN v_case_claims b ON b.doc_id = a.doc_id + 1),
    s AS (SELECT len(list_intersect(x, y)) / greatest(1, least(len(x), len(y)))::double AS s, nx <> ny AS d FROM p)
    SELECT CASE WHEN s >= 0.6 AND d THEN 'contradicts' WHEN s >= 0.9 THEN 'same' WHEN s >= 0.6 THEN 'collaborative' ELSE 'distinct' END AS relation, count(*) AS n FROM s GROUP BY 1""")
def _(t):
    a = t.v_case_claims.select("doc_id", F.col("claim").alias("text_a"))
    b = t.v_case_claims.select((F.col("doc_id") - 1).alias("doc_id"), F.col("claim").alias("text_b"))
    return with_verdicts(a.join(b, "doc_id")).groupBy("relation").agg(F.count("*").alias("n"))


@query("J8_featurize", """
    SELECT doc_id, cast(1024 AS int) AS dim, CASE WHEN regexp_matches(lower(text), '[a-z0-9]') THEN 1.0::double ELSE 0.0::double END AS sq_norm FROM documents""")
def _(t):
    v = Q.featurize(t.documents, "doc_id")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return v.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 6).alias("sq_norm"))




J9_SQL = f"""
    WITH b AS (SELECT entity_id, {sql_squash('name')} AS n, left({sql_squash('context')}, 40) AS c FROM v_entity_ctx),
    base AS (SELECT entity_id, CASE WHEN c = '' THEN n ELSE n || ' ' || c END AS q FROM b),
    q AS (SELECT entity_id, 0 AS p, q FROM base UNION ALL SELECT entity_id, a.i, trim(replace(q || ' ' || a.a, '  ', ' ')) FROM base, (VALUES {_ANGLES}) a(i, a)),
    d AS (SELECT entity_id, q, p, row_number() OVER (PARTITION BY entity_id, lower(q) ORDER BY p) AS dup FROM q),
    r AS (SELECT entity_id, q, row_number() OVER (PARTITION BY entity_id ORDER BY p) - 1 AS pos FROM d WHERE dup = 1)
    SELECT entity_id, cast(pos AS int) AS pos, q AS query FROM r WHERE pos < 8"""


@query("J9_person_queries_lateral", J9_SQL)
def _(t):
    return Q.person_queries_lateral(t.v_entity_ctx, cap=8)


@query("J9_person_queries_function", J9_SQL)
def _(t):
    Q.register_person_queries(t.spark, cap=8)
    spread(t.v_entity_ctx.select("entity_id", "name", "context")).createOrReplaceTempView("people_asked_about")
    return t.spark.sql("SELECT entity_id, q.pos, q.query FROM people_asked_about p, LATERAL person_queries(p.name, p.context) q")
