"""Queries for entity resolution and clustering."""
from pyspark.sql import functions as F

from corrobora.functions import vocab as V
from corrobora.operators import graph, people as P, similarity as S
from corrobora.plans.catalog import query
from corrobora.plans.linking import CANDS, MENT, SAME
from corrobora.plans.retrieval import COS
from corrobora.plans.scans import sql_list


@query("D18_mention_stats", f"""
    WITH m AS (SELECT source_types AS st, unnest(list_distinct(regexp_extract_all(claim, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z.''&-]+){{1,3}})\\b', 1))) AS name FROM v_case_claims)
    SELECT name, count(*) AS n, max(CASE WHEN st IS NULL OR len(st) = 0 OR list_has_any(st, [{sql_list(V.AUTHORITATIVE_TYPES)}]) THEN 1 ELSE 0 END) AS authoritative
    FROM m GROUP BY name""")
def _(t):
    return P.mention_stats(P.mentions(t.v_case_claims)).withColumn("authoritative", F.col("authoritative").cast("int"))


@query("G1_components", """
    WITH RECURSIVE e AS (SELECT DISTINCT vec_id AS a, least(vec_id + 10, (SELECT max(vec_id) FROM embeddings)) AS b FROM embeddings
      UNION SELECT DISTINCT doc_id, cast(toxic AS bigint) + quality * 2 FROM labels),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS v, a AS m FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.v)
    SELECT v AS node, min(m) AS component FROM r GROUP BY v""", )
def _(t):
    top = t.embeddings.agg(F.max("vec_id")).first()[0]
    edges = t.embeddings.select(F.col("vec_id").alias("a"), F.least(F.col("vec_id") + 10, F.lit(top)).alias("b")).union(
        t.labels.select("doc_id", F.col("toxic").cast("long") + F.col("quality") * 2))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    return graph.components(edges, nodes, "a", "b", "node")


def clusters_sql(source: str, t: float) -> str:
    return f"""e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM {source} a JOIN {source} b ON a.branch_id = b.branch_id AND {COS} >= {t}),
    r AS (SELECT x AS v, x AS m FROM e UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.v),
    comp AS (SELECT v AS vec_id, min(m) AS component FROM r GROUP BY v)"""


@query("G2_claim_clusters", f"WITH RECURSIVE {clusters_sql('v_vectors', 0.55)} SELECT vec_id, component FROM comp")
def _(t):
    return S.claim_clusters(t.v_vectors)


_T = "string_split(lower({}), ' ')"


@query("G3_same_entity", f"""
    SELECT entity_a, entity_b, CASE WHEN {SAME} THEN 1 ELSE 0 END AS same FROM v_links,
    LATERAL (SELECT {_T.format('entity_a')} AS t) a, LATERAL (SELECT {_T.format('entity_b')} AS t) b""")
def _(t):
    return t.v_links.select("entity_a", "entity_b", P.same_entity(F.col("entity_a"), F.col("entity_b")).cast("int").alias("same"))


RESOLVE = f"""ms AS (SELECT source_types AS st, unnest(list_distinct(regexp_extract_all(claim, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z.''&-]+){{1,3}})\\b', 1))) AS name FROM v_case_claims),
    st AS (SELECT name, string_split(lower(name), ' ') AS t, bool_or(st IS NULL OR len(st) = 0 OR list_has_any(st, [{sql_list(V.AUTHORITATIVE_TYPES)}])) AS au FROM ms GROUP BY name),
    e AS (SELECT a.name AS x, b.name AS y FROM st a JOIN st b ON {SAME}),
    r AS (SELECT x AS v, x AS m FROM e UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.v),
    comp AS (SELECT v AS name, min(m) AS c FROM r GROUP BY v),
    hd AS (SELECT c, name AS canonical, row_number() OVER (PARTITION BY c ORDER BY au DESC, len(t) DESC, length(name) DESC, name) AS rn,
                  bool_or(au) OVER (PARTITION BY c) AS au, count(*) OVER (PARTITION BY c) AS n_variants FROM st JOIN comp USING (name)),
    rs AS (SELECT comp.name AS variant, canonical, au, n_variants FROM comp JOIN hd ON hd.c = comp.c AND rn = 1)"""


@query("G4_resolve_entities", f"""
    WITH RECURSIVE {RESOLVE} SELECT variant, canonical, n_variants, CASE WHEN au THEN 0 ELSE 1 END AS suspect FROM rs""")
def _(t):
    return P.resolve_entities(P.mentions(t.v_case_claims)).select(
        "variant", "canonical", "n_variants", F.col("suspect").cast("int").alias("suspect"))


@query("G5_normalize_names", reason="ordered rewrites with back-references have no SQL twin; checked by goldens")
def _(t):
    return P.normalize_names(t.v_case_claims, P.resolve_entities(P.mentions(t.v_case_claims))).select("finding_id", "claim")


@query("G6_demote_spoken", """
    WITH l AS (SELECT finding_id, source_types AS st, CASE WHEN confidence_tier IN ('Accepted', 'Moderately Accepted') THEN 'well-supported'
               WHEN confidence_tier = 'Controversial' THEN 'contested' ELSE 'unverified' END AS label FROM v_findings)
    SELECT finding_id, CASE WHEN len(st) > 0 AND len(list_filter(st, lambda x: x NOT IN ('youtube', 'podcast'))) = 0 AND label IN ('well-supported', 'contested')
           THEN 'unverified' ELSE label END AS label FROM l""")
def _(t):
    from corrobora.functions.exprs import standard_label
    return P.demote_spoken(t.v_findings.withColumn("label", standard_label(F.col("confidence_tier")))).select("finding_id", "label")


_ROLE = "CASE WHEN length(name) % 4 = 0 THEN ' Official' WHEN length(name) % 4 = 1 THEN 'subject' WHEN length(name) % 4 = 2 THEN 'scientist' ELSE NULL END"


@query("G7_discover", f"""
    WITH RECURSIVE {CANDS}, ct AS (SELECT name, n, string_split(lower(name), ' ') AS t FROM cu),
    e AS (SELECT a.name AS x, b.name AS y FROM ct a JOIN ct b ON {SAME}),
    r AS (SELECT x AS v, x AS m FROM e UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.v),
    comp AS (SELECT v AS name, min(m) AS c FROM r GROUP BY v),
    mg AS (SELECT arg_min(name, (-length(name), name)) AS name, cast(sum(n) AS bigint) AS mentions FROM ct JOIN comp USING (name) GROUP BY c),
    j AS (SELECT name, mentions, lower(trim({_ROLE})) AS role FROM mg WHERE mentions >= 2)
    SELECT name, mentions, CASE WHEN role IS NULL THEN 'not_returned' WHEN role IN ({sql_list(V.NON_SUBJECT_ROLES)}) THEN role END AS reason,
           CASE WHEN role IS NULL OR role IN ({sql_list(V.NON_SUBJECT_ROLES)}) THEN 'rejected' ELSE 'candidate' END AS outcome FROM j""")
def _(t):
    m = P.mentions(t.v_case_claims)
    roles = m.select("name").distinct().select("name", F.expr(_ROLE).alias("role"))
    return P.discover(m, t.v_cards, roles)


@query("G5_gather", """
    WITH f AS (SELECT f.*, coalesce(t.confidence_tier, f.confidence_tier, 'Speculative') AS tier FROM v_findings f LEFT JOIN v_truth t USING (finding_id)
               WHERE (node_kind IS NULL OR node_kind = 'finding') AND trim(claim) <> '' AND f.doc_id NOT IN (SELECT item_id FROM benchmark)),
    l AS (SELECT *, CASE WHEN tier IN ('Accepted', 'Moderately Accepted') THEN 'well-supported' WHEN tier = 'Controversial' THEN 'contested' ELSE 'unverified' END AS l FROM f)
    SELECT finding_id, CASE WHEN len(source_types) > 0 AND len(list_filter(source_types, lambda x: x NOT IN ('youtube', 'podcast'))) = 0
             AND l IN ('well-supported', 'contested') THEN 'unverified' ELSE l END AS label,
           array_to_string(coalesce(source_types, []), ',') AS source_types, array_to_string(urls, ',') AS urls, corroboration_count::double AS corroboration FROM l""")
def _(t):
    from corrobora.operators.reading import gather
    out = t.benchmark.select(F.concat(F.lit("find_"), F.col("item_id").cast("string")).alias("finding_id"))
    # claims are compared with plain rewriting in tests/test_reading.py; SQL has no twin for that step
    return gather(t.v_findings, t.v_truth, out).select("finding_id", "label", F.array_join("source_types", ",").alias("source_types"),
                                                       F.array_join("urls", ",").alias("urls"), "corroboration")
