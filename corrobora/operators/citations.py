"""Citation graph: best text of a work, reference expansion, forward citations."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from corrobora.operators.ordering import row_numbers
from corrobora.session import cut, one_row


def route_text(works: DataFrame) -> DataFrame:
    """Best url, and where readable text comes from: open copy, abstract, or nowhere (gated)."""
    primary = F.coalesce("doi", "landing_page_url", F.col("work_id").cast("string"))
    has_abstract = F.coalesce(F.col("abstract"), F.lit("")) != ""
    return (works.withColumn("primary_url", primary)
            .withColumn("url", F.coalesce("oa_url", "primary_url"))
            .withColumn("kind", F.when(F.col("oa_url").isNotNull(), "oa_fulltext")
                        .when(has_abstract, "abstract").otherwise("gated")))


def gated_leads(works: DataFrame) -> DataFrame:
    return route_text(works).filter("kind = 'gated'").select(
        "work_id", "branch_id", F.lit("gated").alias("gap_type"), F.lit("dim").alias("status"),
        F.concat(F.lit("LOCKED LEAD — "), F.col("primary_url")).alias("question"))


def references(works: DataFrame, max_refs: int | None = None) -> DataFrame:
    """(work_id, ref_id, pos) edges; the per-work limit is a parameter of the walk."""
    refs = F.col("referenced_works") if max_refs is None else F.slice("referenced_works", 1, max_refs)
    return works.select("work_id", F.posexplode(refs).alias("pos", "ref_id"))


def expand_refs(works: DataFrame, seeds: DataFrame, depth: int = 2, max_refs: int | None = None,
                max_total: int | None = None, off_topic: DataFrame | None = None) -> DataFrame:
    """Level-by-level walk along references: (work_id, level, kind, off_topic, n_refs, n_total).

    Gated works are reached but not descended from, off-topic ones likewise, and both are marked. ``n_refs`` counts all
    references of a work, so a walk with ``max_refs`` tells what it passed by. With ``max_total`` the
    nearest works are kept (level, then id) and ``n_total`` says how many were reached.
    """
    routed = cut(route_text(works).select("work_id", "kind"))
    edges = references(works, max_refs)
    stop = routed.filter("kind = 'gated'").select("work_id")
    if off_topic is not None:
        stop = stop.union(off_topic.select("work_id"))
    reached = None
    frontier = seeds.select("work_id").distinct()
    for level in range(1, depth + 1):
        nxt = edges.join(frontier, "work_id", "left_semi").select(F.col("ref_id").alias("work_id")).distinct()
        nxt = nxt.join(works.select("work_id"), "work_id", "left_semi")
        if reached is not None:
            nxt = nxt.join(reached, "work_id", "left_anti")
        nxt = cut(nxt.withColumn("level", F.lit(level)))
        reached = nxt if reached is None else reached.unionByName(nxt)
        frontier = nxt.select("work_id").join(stop, "work_id", "left_anti")
    out = reached.join(routed, "work_id").join(works.select("work_id", F.coalesce(F.size("referenced_works"), F.lit(0)).alias("n_refs")), "work_id")
    marked = F.lit(False)
    if off_topic is not None:
        out = out.join(off_topic.select("work_id").distinct().withColumn("_off", F.lit(True)), "work_id", "left")
        marked = F.coalesce("_off", F.lit(False))
    out = out.select("work_id", "level", "kind", marked.alias("off_topic"), "n_refs")
    total = out.agg(F.count("*").alias("n_total"))
    if max_total is not None:
        out = out.orderBy("level", "work_id").limit(max_total)
    return out.withColumn("n_total", one_row(total)["n_total"])


def cited_by(works: DataFrame, ids: DataFrame, since_year: int | None = None, k: int | None = None,
             max_refs: int | None = None) -> DataFrame:
    """Works that cite each id, most cited first; ``n_total`` counts them all."""
    edges = references(works, max_refs).join(ids.select(F.col("work_id").alias("ref_id")), "ref_id", "left_semi")
    citing = edges.select("ref_id", "work_id").distinct().join(
        works.select("work_id", "cited_count", "pub_year"), "work_id")
    if since_year is not None:
        citing = citing.filter(F.col("pub_year") >= since_year)
    rank = F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc("cited_count"), "work_id"))
    total = citing.groupBy("ref_id").agg(F.count("*").alias("n_total"))
    if k is None:
        ranked = row_numbers(citing.withColumn("_c", -F.col("cited_count")), ["ref_id"], ["_c", "work_id"], "rank").drop("_c")
    else:
        ranked = citing.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.join(total, "ref_id")
