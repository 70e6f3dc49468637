"""Queries over sources and sinks."""
from pyspark.sql import functions as F

from corrobora import schemas
from corrobora.functions import vocab as V
from corrobora.plans.catalog import query
from corrobora.session import scratch_path
from corrobora.sources import tables as S


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_any(expr: str, needles) -> str:
    """OR of substring tests, for the SQL twins."""
    return "(" + " OR ".join("contains({}, '{}')".format(expr, n.replace("'", "''")) for n in needles) + ")"


@query("A1_all_findings", """
    SELECT finding_id, branch_id, length(claim) AS n_chars, array_to_string(coalesce(source_types, []), ',') AS source_types,
           array_to_string(urls, ',') AS urls, coalesce(confidence_tier, 'Speculative') AS confidence_tier, corroboration_count
    FROM v_findings WHERE (node_kind IS NULL OR node_kind = 'finding') AND trim(claim) <> ''""")
def _(t):
    return S.all_findings(t.v_findings).select(
        "finding_id", "branch_id", F.length("claim").cast("long").alias("n_chars"),
        F.array_join("source_types", ",").alias("source_types"), F.array_join("urls", ",").alias("urls"),
        "confidence_tier", "corroboration_count")


@query("A2_upsert_raw", """
    WITH r AS (SELECT 'u' || user_id AS url, event_type AS branch_id, props AS raw_text, ts, event_id FROM events)
    SELECT url, branch_id, arg_max(raw_text, ts) AS raw_text, length(arg_max(raw_text, ts)) AS char_len FROM r GROUP BY url, branch_id""")
def _(t):
    rows = t.sql("SELECT 'u' || cast(user_id as string) AS url, event_type AS branch_id, 't' AS title, "
                 "'web' AS source_type, props AS raw_text, ts AS created_at, event_type FROM events")
    old, new = rows.filter("event_type = 'view'"), rows.filter("event_type <> 'view'")
    return S.upsert_raw(old, new).select("url", "branch_id", "raw_text", "char_len")


@query("A3_link_raw", """
    SELECT finding_id, u AS url, length(d.text) AS char_len
    FROM (SELECT finding_id, doc_id, unnest(urls) AS u FROM v_findings) f
    LEFT JOIN documents d ON d.doc_id = f.doc_id AND d.n_chars >= 900""")
def _(t):
    raw = t.v_findings.filter("n_chars >= 900").select(
        F.explode("urls").alias("url"), "branch_id", F.col("claim").alias("raw_text"),
        F.length("claim").cast("long").alias("char_len"))
    return S.link_raw(t.v_findings, raw).select("finding_id", "url", "char_len")


@query("A4_ledgers", "SELECT branch_id, count(*) AS n, count(*) * 0.5::double AS total FROM v_questions GROUP BY branch_id")
def _(t):
    path = scratch_path(t.spark, "ledger")
    rows = t.v_questions.select("text", "branch_id", F.lit(1).alias("cycle_n"),
                                F.create_map(F.lit("combined"), F.lit(0.5)).alias("scores"),
                                F.lit("asked").alias("outcome"))
    S.append_ledger(rows, path)
    return S.read_ledger(t.spark, path, schemas.QUESTION_LEDGER).groupBy("branch_id").agg(
        F.count("*").alias("n"), F.sum(F.element_at("scores", "combined")).alias("total"))


@query("A5_write_findings", """
    SELECT branch_id, count(*) AS n FROM v_findings GROUP BY branch_id UNION ALL SELECT 'TOTAL', count(*) FROM v_findings""")
def _(t):
    path = scratch_path(t.spark, "findings")
    cols = schemas.FINDINGS.fieldNames()
    S.write_findings(t.v_findings.select(cols), path)
    S.write_findings(t.v_findings.select(cols).filter("branch_id = 'fr'"), path)
    return S.branch_stats(S.read_findings(t.spark, path))


@query("A6_branch_stats", """
    SELECT branch_id, count(*) AS n FROM v_findings GROUP BY branch_id
    UNION ALL SELECT 'TOTAL', count(*) FROM v_findings""")
def _(t):
    return S.branch_stats(t.v_findings)


@query("A7_get_metas", """
    SELECT finding_id, corroboration_count FROM v_findings WHERE doc_id IN (SELECT doc_id FROM labels)""")
def _(t):
    ids = t.labels.select(F.concat(F.lit("find_"), F.col("doc_id").cast("string")).alias("finding_id"))
    return S.get_metas(t.v_findings, ids.unionByName(ids)).select("finding_id", "corroboration_count")


@query("A8_delete_nodes", """
    SELECT finding_id, branch_id FROM v_findings WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    ids = t.labels.select(F.concat(F.lit("find_"), F.col("doc_id").cast("string")).alias("finding_id"))
    return S.delete_nodes(t.v_findings, ids).select("finding_id", "branch_id")


_STRIPPED = "html"
for _tag in ("script", "style", "noscript"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
# the SQL twin decodes the entities these pages hold; the operator decodes the full set
for _ent, _char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _STRIPPED = (f"regexp_replace({_STRIPPED}, '(?s)<[^>]+>', ' ', 'g')" if _ent == "&middot;" else _STRIPPED)
    _STRIPPED = f"replace({_STRIPPED}, '{_ent}', '{_char}')"


@query("A9_html_to_text", f"""
    SELECT page_id, url, CASE WHEN length(s) >= 200 THEN s END AS text
    FROM (SELECT page_id, url, trim(regexp_replace({_STRIPPED}, '\\s+', ' ', 'g')) AS s FROM pages)""")
def _(t):
    return S.html_to_text(t.pages).select("page_id", "url", "text")


@query("A10_normalize_captions", r"""
    SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN text ELSE array_to_string([regexp_replace(x, '<[^>]+>', '', 'g') for x in
        [trim(l) for l in regexp_split_to_array('<b>' || text || '</b>', '\r\n|\n|\r')] if x <> '' AND x <> 'WEBVTT' AND NOT regexp_matches(x, '^\d+$') AND NOT contains(x, '-->')], ' ') END AS text
    FROM documents""".replace("\\\\", "\\"))
def _(t):
    raw = t.documents.select("doc_id", F.when(
        F.col("n_chars") % 2 == 0,
        F.to_json(F.struct(F.array(F.struct(F.col("text"))).alias("segments")))).otherwise(
        F.concat(F.lit("WEBVTT\n\n1\n00:00:01.000 --> 00:00:04.000\n<b>"), F.col("text"), F.lit("</b>\n2\n")))
        .alias("raw"))
    return S.normalize_captions(raw).select("doc_id", "text")


@query("A11_outbound_links", f"""
    WITH md AS (SELECT page_id, regexp_extract_all(text, '\\]\\((https?://[^\\s)]+)\\)', 1) AS a,
                       regexp_extract_all(text, '(?:^|[^(<"])(https?://[^\\s)>\\]"]+)', 1) AS b FROM v_pages_md),
    u AS (SELECT page_id, unnest(list_concat(a, b)) AS u0, generate_subscripts(list_concat(a, b), 1) AS p FROM md),
    d AS (SELECT page_id, rtrim(u0, '.,);]') AS url, min(p) AS p FROM u GROUP BY 1, 2),
    k AS (SELECT * FROM d WHERE NOT {sql_any('lower(url)', V.CHASE_NOISE)})
    SELECT page_id, url, cast(row_number() OVER (PARTITION BY page_id
           ORDER BY CASE WHEN {sql_any('lower(url)', V.SOURCE_HINTS)} THEN 0 ELSE 1 END, p) - 1 AS int) AS rank FROM k""")
def _(t):
    return S.outbound_links(t.v_pages_md)


@query("A12_description_links", f"SELECT page_id, 0 AS rank, url FROM pages WHERE NOT {sql_any('lower(url)', V.DESCRIPTION_NOISE)}")
def _(t):
    rows = t.pages.select("page_id", F.concat(
        F.lit('{"shortDescription":"Sources: '), F.regexp_replace("url", "&", r"\\u0026"), F.lit('\\nhttps://x.com/me","url":"https://www.youtube.com/redirect?event=1\\u0026q='),
        F.expr("url_encode(url)"), F.lit('\\u0026v=2"}'), F.col("html")).alias("page"))
    return S.description_links(rows, "page_id", "page")
