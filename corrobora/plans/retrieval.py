"""Queries for similarity, BM25 and fused retrieval."""
from pyspark.sql import functions as F

from corrobora.functions import vocab as V
from corrobora.operators import lexical as L, similarity as S
from corrobora.plans.catalog import query

COS = "round(list_cosine_similarity(a.embedding, b.embedding), 4)"


def probes(t):
    return t.v_probes.withColumnRenamed("vec_id", "probe_id")


@query("C5_normalize_vec", """
    SELECT vec_id, round(list_sum([x * x for x in embedding]), 6) AS sq_in, 1.0::double AS sq_out,
           round(embedding[1] / sqrt(list_sum([x * x for x in embedding])), 6) AS first_out FROM v_vectors""")
def _(t):
    out = S.normalize_vec(t.v_vectors.withColumn("raw", F.col("embedding")), 64)
    return out.select("vec_id", F.round(S.dot(F.col("raw"), F.col("raw")), 6).alias("sq_in"),
                      F.round(S.dot(F.col("embedding"), F.col("embedding")), 6).alias("sq_out"),
                      F.round(F.get("embedding", 0), 6).alias("first_out"))


def knn_sql(where: str = "true", a: str = "v_probes", b: str = "v_index", on: str = "a.branch_id = b.branch_id") -> str:
    return (f"SELECT a.vec_id AS probe_id, b.vec_id AS vec_id, {COS} AS score, row_number() OVER (PARTITION BY a.vec_id "
            f"ORDER BY {COS} DESC, b.vec_id) AS rank FROM {a} a JOIN {b} b ON {on} AND {where}")


@query("C6_knn_filtered", f"""
    WITH k AS ({knn_sql("b.node_kind = 'finding' AND b.confidence_tier = 'Accepted'")})
    SELECT probe_id, k.vec_id, score, rank, len(i.source_types) > 1 AS cross_source, corroboration_count
    FROM k JOIN v_index i ON i.vec_id = k.vec_id WHERE rank <= 5""")
def _(t):
    return S.query_index(probes(t), t.v_index, 5, kind="finding", tier="Accepted").select(
        "probe_id", "vec_id", "score", "rank", "cross_source", "corroboration_count")


@query("C7_sim_pairs", f"""
    WITH r AS (SELECT *, min(vec_id) OVER (PARTITION BY branch_id, embedding) AS rep FROM v_vectors)
    SELECT a.vec_id AS a_id, b.vec_id AS b_id, {COS} AS score FROM r a JOIN r b
    ON a.branch_id = b.branch_id AND a.vec_id < b.vec_id AND a.vec_id = a.rep AND b.vec_id = b.rep AND {COS} >= 0.6
    UNION ALL SELECT rep, vec_id, 1.0 FROM r WHERE vec_id <> rep""")
def _(t):
    return S.sim_pairs(t.v_vectors, 0.6)


@query("C8_score_novelty", f"""
    WITH k AS ({knn_sql()})
    SELECT p.vec_id AS probe_id, k.vec_id AS nearest_id, coalesce(score, 0.0) AS nearest_score,
           CASE WHEN score >= 0.6 THEN 'redundant' WHEN score >= 0.4 THEN 'incremental' ELSE 'novel' END AS novelty
    FROM v_probes p LEFT JOIN k ON k.probe_id = p.vec_id AND rank = 1""")
def _(t):
    return S.score_novelty(probes(t), t.v_index)


@query("C9_best_match", f"WITH k AS ({knn_sql()}) SELECT probe_id, vec_id, score FROM k WHERE rank = 1 AND score >= 0.55")
def _(t):
    return S.best_match(probes(t), t.v_index)


@query("C10_bridges", f"""
    WITH k AS ({knn_sql(on='true')}), h AS (SELECT * FROM k WHERE rank = 1 AND score >= 0.45)
    SELECT probe_id, vec_id, score, CASE WHEN score >= 0.6 THEN 'STRONG' WHEN score >= 0.5 THEN 'real' ELSE 'weak' END AS band,
           (SELECT count(*) FROM h) AS n_total FROM h ORDER BY score DESC, probe_id, vec_id LIMIT 12""")
def _(t):
    return S.bridges(probes(t), t.v_index, top=12)


@query("C11_bridge_all", f"""
    WITH p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, {COS} AS score, a.branch_id AS branch_a, b.branch_id AS branch_b
               FROM v_vectors a JOIN v_vectors b ON a.branch_id < b.branch_id),
    m AS (SELECT *, row_number() OVER (PARTITION BY a_id, branch_b ORDER BY score DESC, b_id) AS best FROM p),
    h AS (SELECT * FROM m WHERE best = 1 AND score >= 0.5),
    r AS (SELECT *, row_number() OVER (PARTITION BY branch_a, branch_b ORDER BY score DESC, a_id) AS rn FROM h)
    SELECT branch_a, branch_b, a_id, b_id, score, (SELECT count(*) FROM h) AS n_total FROM r WHERE rn <= 3 ORDER BY score DESC, a_id, b_id LIMIT 15""")
def _(t):
    return S.bridge_all(t.v_vectors, per_pair=3, top=15)


BM = """tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents),
    st AS (SELECT count(*) AS nd, avg(len(toks)) AS avgdl FROM tk),
    po AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM tk) GROUP BY 1, 2),
    idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT nd FROM st) - count(*) + 0.5::double) / (count(*) + 0.5::double)) AS idf FROM po GROUP BY 1)"""
BMS = BM + """, qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
    sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / (SELECT avgdl FROM st)))), 6) AS score
           FROM qt JOIN po USING (term) JOIN idf USING (term) GROUP BY 1, 2),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)"""


@query("C12_bm25_index", f"""
    WITH {BM} SELECT doc_id, count(*) AS terms, any_value(dl) AS dl, round(sum(tf * idf), 3) AS mass FROM po JOIN idf USING (term) GROUP BY doc_id""")
def _(t):
    return L.bm25_index(t.documents).groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.first("dl").alias("dl"), F.round(F.sum(F.col("tf") * F.col("idf")), 3).alias("mass"))


def bm_queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query("C13_bm25_search", f"WITH {BMS} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def _(t):
    return L.bm25_search(bm_queries(t), t.documents, 10)


HY = BMS + f""", kn AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {COS} AS score, row_number() OVER (PARTITION BY a.vec_id
        ORDER BY {COS} DESC, b.vec_id) AS rank FROM v_probes a JOIN v_probes b ON a.vec_id IN (SELECT item_id FROM benchmark)),
    fu AS (SELECT query_id, doc_id, round(sum(w / (60 + rank - 1)), 8) AS fused FROM (
        SELECT query_id, doc_id, 1.0::double AS w, rank FROM kn WHERE rank <= 20 UNION ALL
        SELECT query_id, doc_id, 2.0::double, rank FROM bm WHERE rank <= 20) GROUP BY 1, 2),
    hy AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM fu f)"""


def hybrid_queries(t):
    vec = t.v_probes.select(F.col("vec_id").alias("query_id"), "embedding")
    return bm_queries(t).join(vec, "query_id")


@query("C14_rrf", f"WITH {HY} SELECT query_id, doc_id, fused, rank FROM hy WHERE rank <= 5")
def _(t):
    q = hybrid_queries(t)
    dense = S.knn(q.withColumnRenamed("query_id", "probe_id"), t.v_probes, 20, scope=None).select(
        F.col("probe_id").alias("query_id"), F.col("vec_id").alias("doc_id"), "rank")
    return L.rrf([dense, L.bm25_search(q, t.documents, 20)], [1.0, 2.0], 5)


@query("C15_hybrid", f"""
    WITH {HY} SELECT h.query_id, h.doc_id, h.fused, h.rank, coalesce(k.score, 0.0) AS score FROM hy h
    LEFT JOIN kn k ON k.query_id = h.query_id AND k.doc_id = h.doc_id AND k.rank <= 20 WHERE h.rank <= 5""")
def _(t):
    return L.hybrid(hybrid_queries(t), t.documents, t.v_probes, 5)


W4 = "list_distinct(regexp_extract_all(lower(claim), '[a-z]{4,}'))"
KNOWN = f"""n AS (SELECT claim_id, claim, {W4} AS ws FROM v_incoming), e AS (SELECT claim_id, {W4} AS ws FROM v_existing),
    kn AS (SELECT DISTINCT n.claim_id FROM n JOIN e ON len(e.ws) > 0 AND len(n.ws) > 0
           AND len(list_intersect(n.ws, e.ws)) / greatest(1, least(len(n.ws), len(e.ws)))::double >= 0.6)"""


@query("C16_novel_claims", f"WITH {KNOWN} SELECT claim_id FROM n WHERE len(ws) >= 4 AND claim_id NOT IN (SELECT claim_id FROM kn)")
def _(t):
    return L.novel_claims(t.v_incoming, t.v_existing)


@query("C29_kb_lookup", f"""
    WITH k AS ({knn_sql("b.node_kind = 'finding'")}), c AS (
      SELECT probe_id, k.vec_id, score, corroboration_count, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, k.vec_id) AS r,
             round(epoch(timestamp '2025-01-01' - cast(left(created_at, 10) AS timestamp)) / 86400.0, 1) AS age_days
      FROM k JOIN v_index i ON i.vec_id = k.vec_id WHERE rank <= 5 AND score >= 0.5 AND confidence_tier = 'Accepted' AND corroboration_count >= 2
        AND len(urls) > 0 AND epoch(timestamp '2025-01-01' - cast(left(created_at, 10) AS timestamp)) / 86400.0 <= 2000
        AND probe_id IN (SELECT probe_id FROM v_judge WHERE answer = 'yes'))
    SELECT probe_id, vec_id, score, corroboration_count, age_days FROM c WHERE r = 1""")
def _(t):
    return S.kb_lookup(probes(t), t.v_index, t.v_judge, F.to_date(F.lit("2025-01-01")), max_age_days=2000)


@query("C30_consensus", f"""
    WITH k AS ({knn_sql('a.vec_id <> b.vec_id', 'v_vectors', 'v_vectors')}),
    c AS (SELECT probe_id, count(*) AS n FROM k WHERE rank <= 7 AND score >= 0.35 GROUP BY 1)
    SELECT v.vec_id AS probe_id, coalesce(n, 0) AS consensus_size,
           CASE WHEN coalesce(n, 0) >= 3 AND r.relation = 'contradicts' THEN 1 ELSE 0 END AS contradiction
    FROM v_vectors v LEFT JOIN c ON c.probe_id = v.vec_id LEFT JOIN v_relations r ON r.vec_id = v.vec_id""")
def _(t):
    claims = t.v_vectors.withColumnRenamed("vec_id", "probe_id")
    verdicts = t.v_relations.select(F.col("vec_id").alias("probe_id"), (F.col("relation") == "contradicts").alias("contradicts"))
    return S.consensus(claims, t.v_vectors, verdicts).withColumn("contradiction", F.col("contradiction").cast("int"))


@query("C31_relation_candidates", f"""
    WITH k AS ({knn_sql()})
    SELECT probe_id, vec_id, score, CASE WHEN score >= 0.9 THEN 'verbatim' WHEN score >= 0.6 THEN 'merge' ELSE 'nest' END AS band
    FROM k WHERE rank = 1 AND score >= 0.45""")
def _(t):
    return S.relation_candidates(probes(t), t.v_index)


@query("A13_export_edges", f"""
    WITH k AS ({knn_sql('a.vec_id <> b.vec_id', 'v_index', 'v_index')})
    SELECT probe_id, k.vec_id, score, rank, i.branch_id, i.confidence_tier, cast(len(i.urls) AS int) AS n_urls, i.corroboration_count
    FROM k JOIN v_index i ON i.vec_id = k.probe_id WHERE rank <= 3 AND score > 0""")
def _(t):
    return S.export_edges(t.v_index)


@query("D13_post_flight", f"""
    WITH k AS ({knn_sql('true', 'v_probes', 'v_index')}),
    c AS (SELECT probe_id FROM k WHERE rank = 1 AND score >= 0.35),
    f AS (SELECT vec_id AS probe_id, 'https://www.s' || (vec_id % 9) || '.example.org/x' AS url FROM v_probes
          UNION ALL SELECT vec_id, 'https://t' || branch_id || '.example.org/y' FROM v_probes)
    SELECT regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS domain, count(DISTINCT probe_id) AS findings,
           count(*) AS citations, count(DISTINCT CASE WHEN probe_id IN (SELECT probe_id FROM c) THEN probe_id END) AS connected FROM f GROUP BY 1""")
def _(t):
    p = probes(t)
    url = lambda a, b, c: F.concat(F.lit(a), b.cast("string"), F.lit(c))
    found = p.withColumn("urls", F.array(url("https://www.s", F.col("probe_id") % 9, ".example.org/x"),
                                         url("https://t", F.col("branch_id"), ".example.org/y")))
    return S.post_flight(found, t.v_index)


@query("D14_prefilter", f"""
    WITH k AS ({knn_sql("b.node_kind = 'finding'")}), g AS ({knn_sql("b.node_kind = 'gap'")}),
    f AS (SELECT probe_id, max(score) AS tf, count(*) FILTER (score >= 0.4) AS near FROM k WHERE rank <= 8 GROUP BY 1),
    gg AS (SELECT probe_id, max(score) AS tg FROM g WHERE rank <= 3 GROUP BY 1),
    x AS (SELECT vec_id AS probe_id, coalesce(tg, 0.0) AS disagreement, CASE WHEN coalesce(tf, 0) >= 0.42 THEN 0.15::double WHEN tf >= 0.24 THEN 1.0::double
                 WHEN tf >= 0.16 THEN 0.6::double ELSE 0.35::double END AS frontier, least(coalesce(near, 0) / 8.0::double, 1.0::double) AS load_bearing
          FROM v_probes p LEFT JOIN f ON f.probe_id = p.vec_id LEFT JOIN gg ON gg.probe_id = p.vec_id)
    SELECT probe_id, disagreement, frontier, load_bearing, round(0.25::double * disagreement + 0.35::double * frontier + 0.2::double * load_bearing
           + 0.2::double * (0.4::double + 0.6::double * load_bearing), 3) AS combined FROM x""")
def _(t):
    out = S.prefilter(probes(t), t.v_index)
    total = sum((w * F.col(c) for c, w in V.PREFILTER_WEIGHTS.items()), F.lit(0.0))
    return out.select("probe_id", "disagreement", "frontier", "load_bearing", F.round(total, 3).alias("combined"))
