"""Evidence weight, consolidation and tier movement as joins and rewrites.

Provenance lives in rows ``(finding_id, kind, value)``, not in arrays: a node a third of all claims merge
into stays a set of rows spread over the cluster.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corrobora.functions import exprs as X, vocab as V
from corrobora.operators import similarity as S
from corrobora.operators.graph import components
from corrobora.session import cut, dealt, small_side

_BIT = {fam: i for i, fam in enumerate(sorted(set(V.TYPE_FAMILY.values())))}


# --- weight ----------------------------------------------------------------------------------------
def family_bit(source_type: Column) -> Column:
    fam = X.family(source_type)
    bits = F.lit(0)
    for name, i in _BIT.items():
        bits = F.when(fam == name, 1 << i).otherwise(bits)
    return bits


def family_bits(source_type: Column) -> Column:
    """No bit for an unknown type: it neither adds a family nor counts as one."""
    return F.when(source_type.isNotNull(), family_bit(source_type)).otherwise(0)


def is_model(source_type: Column) -> Column:
    return F.coalesce(source_type == "llm", F.lit(False))


def evidence_tiers(assertions: DataFrame) -> DataFrame:
    """(claim_id, weight, n_families, contested, confidence_tier).

    Two combinable stages: distinct (claim, source, type), then sums and a bit-or per claim, so a claim
    holding a third of all assertions is reduced before it is brought together.
    """
    contra = (F.col("stance") == "contradict").cast("int")
    distinct = assertions.groupBy("claim_id", "source_id", "source_type").agg(F.max(contra).alias("c"))
    model = is_model(F.col("source_type"))
    per = distinct.groupBy("claim_id").agg(
        (F.count_if(~model) + F.max(model.cast("long"))).alias("weight"), F.bit_or(family_bits(F.col("source_type"))).alias("fam"),
        F.max(F.col("source_type").isNotNull()).alias("typed"), F.max("c").alias("c"))
    families = F.when(F.col("typed"), F.bit_count("fam"))
    return per.select("claim_id", "weight", families.alias("n_families"), F.coalesce(F.col("c") == 1, F.lit(False)).alias("contested"),
                      F.when(F.col("c") == 1, V.CONTESTED).otherwise(
                          X.gated_tier(F.col("weight"), families)).alias("confidence_tier"))


SKETCH_K = 14           # 2^14 buckets: a standard error of 0.8 % whatever the number of sources


def source_sketches(assertions: DataFrame, by: str = "claim_id", source: str = "source_id") -> DataFrame:
    """(by, sketch): distinct sources as a mergeable sketch of bounded size, for tables too large to count exactly. Sketches of
    two batches merge to what one over both would be; ``sketched_sources`` reads them."""
    return assertions.groupBy(by).agg(F.hll_sketch_agg(source, SKETCH_K).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: str | None = "claim_id") -> DataFrame:
    """One sketch for each group (or for all rows): batches, or a coarser key."""
    return sketches.groupBy(*([by] if by else [])).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_sources(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("n_sources", F.hll_sketch_estimate("sketch")).drop("sketch")


def label_counts(tiers: DataFrame) -> DataFrame:
    """Claims per public label; all four labels are always present."""
    dim = tiers.sparkSession.createDataFrame([(x,) for x in V.LABELS], "label string")
    n = tiers.groupBy(X.standard_label(F.col("confidence_tier")).alias("label")).agg(F.count("*").alias("n"))
    return dim.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cluster_outcomes(claims: DataFrame, stance: DataFrame) -> DataFrame:
    """Multi-source clusters split into gaps (sources disagree) and corroborations; unknown stance agrees.

    A row for each source and for each type of a cluster, then a row a cluster, each in tasks of bounded rows.
    """
    n_all, rows = claims.groupBy("source_label").agg(F.count("*").alias("n")).agg(F.count("source_label"), F.coalesce(F.sum("n"), F.lit(0))).first()
    label, kind = claims.schema["source_label"].dataType, claims.schema["source_type"].dataType
    each = claims.select("cluster_id", F.inline(F.array(
        F.struct(F.col("source_label").alias("label"), F.lit(None).cast(kind).alias("kind"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(None).cast(label).alias("label"), F.col("source_type").alias("kind"), F.lit(0).cast("long").alias("n")))))
    once = dealt(each, "cluster_id", "label", "kind", rows=2 * rows).groupBy("cluster_id", "label", "kind").agg(F.sum("n").alias("n"))
    per = dealt(once, "cluster_id", rows=2 * rows).groupBy("cluster_id").agg(
        F.count("label").alias("n_sources"), F.count("kind").alias("n_types"), F.sum("n").alias("n_claims")).filter("n_sources >= 2")
    s = X.within(F.col("stance"), ("agree", "contradict", "mixed"), "agree")
    gap = F.col("stance").isin("contradict", "mixed")
    return (per.join(stance, "cluster_id", "left").withColumn("stance", s)
            .withColumn("n_all", F.lit(n_all))
            .select("cluster_id", F.when(gap, "gap").otherwise("corroboration").alias("kind"), "n_sources", "n_types",
                    "n_claims", F.when(gap, F.bround(F.col("n_sources") / F.col("n_all"), 3)).alias("disagreement_score")))


# --- ingest decision -------------------------------------------------------------------------------
def ingest_candidates(new: DataFrame, index: DataFrame) -> DataFrame:
    """(claim_id, target_id, score, origin): nearest earlier claim of the batch and nearest indexed one.

    This is the table a judge labels; everything below the nesting floor never reaches it.
    """
    asked = new.withColumnRenamed("vec_id", "probe_id")
    twins = S.knn(asked, new, 1, floor=V.NEST_FLOOR, earlier=True).select(
        F.col("probe_id").alias("claim_id"), F.col("vec_id").alias("target_id"), "score", F.lit("batch").alias("origin"))
    near = S.knn(new.withColumnRenamed("vec_id", "probe_id"), index, 1, floor=V.NEST_FLOOR).select(
        F.col("probe_id").alias("claim_id"), F.col("vec_id").alias("target_id"), "score", F.lit("index").alias("origin"))
    return twins.unionByName(near)


def _action(score: Column, relation: Column, origin: Column) -> Column:
    band = X.relation_band(score)
    rel = F.when(band == "verbatim", "same").otherwise(relation)
    act = (F.when((rel == "same") & band.isin("verbatim", "merge"), "merged").when(rel == "collaborative", "nested")
           .when(rel == "contradicts", "kept_contested").otherwise("new"))
    # a twin in the batch only absorbs; anything else is left to the indexed neighbour
    return F.when((origin == "batch") & ~act.isin("merged", "nested"), F.lit(None)).otherwise(act)


def decide(new: DataFrame, candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """(claim_id, action, target_id, score, nearest_score): one decision per new claim, default new."""
    rel = X.within(F.col("relation"), V.RELATIONS, "distinct")
    judged = candidates.join(relations, ["claim_id", "target_id"], "left").withColumn(
        "action", _action(F.col("score"), rel, F.col("origin"))).filter("action IS NOT NULL")
    first = judged.groupBy("claim_id").agg(F.min_by(
        F.struct("action", "target_id", "score"), F.struct("origin", "target_id")).alias("d"))
    near = candidates.groupBy("claim_id").agg(F.max("score").alias("nearest_score"))
    absorbed = F.col("d.action").isin("merged", "nested", "kept_contested")
    return (new.select(F.col("vec_id").alias("claim_id")).join(first, "claim_id", "left").join(near, "claim_id", "left")
            .select("claim_id", F.coalesce("d.action", F.lit("new")).alias("action"),
                    F.when(absorbed, F.col("d.target_id")).alias("target_id"),
                    F.coalesce("d.score", F.lit(0.0)).alias("score"), F.coalesce("nearest_score", F.lit(0.0)).alias("nearest_score")))


def settle_targets(decisions: DataFrame) -> DataFrame:
    """Follow chains: a claim absorbed by an absorbed claim ends at the node that stays."""
    d = cut(decisions.filter(F.col("action").isin("merged", "nested")).select("claim_id", "action", "target_id"))
    ends = d.select(F.inline(F.array(F.struct(F.col("claim_id").alias("n")), F.struct(F.col("target_id").alias("n"))))).distinct()
    comp = components(d, ends, "claim_id", "target_id", "n")
    roots = comp.join(d.select(F.col("claim_id").alias("n")), "n", "left_anti").select(F.col("n").alias("root"), "component")
    return d.join(comp.select(F.col("n").alias("claim_id"), "component"), "claim_id").join(roots, "component").select(
        "claim_id", "action", F.col("root").alias("target_id"))


def ingest(nodes: DataFrame, prov: DataFrame, children: DataFrame, new: DataFrame, new_prov: DataFrame,
           decisions: DataFrame, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, provenance, children) after a batch: chains followed to the node that stays, then every new claim added,
    merged or nested. Running the same batch again changes nothing.

    nodes: finding_id, claim, corroboration_count, confidence_tier; new: claim_id, claim; the rest as elsewhere here.
    """
    settled = settle_targets(decisions)
    stays = (decisions.filter(F.col("action").isin("new", "kept_contested")).join(new.select("claim_id", "claim"), "claim_id")
             .join(nodes.select(F.col("finding_id").alias("claim_id")), "claim_id", "left_anti"))
    added = stays.select(F.col("claim_id").alias("finding_id"), "claim", F.lit(1).cast("long").alias("corroboration_count"),
                         F.when(F.col("action") == "kept_contested", V.CONTESTED).otherwise(X.tier_for_count(F.lit(1))).alias("confidence_tier"))
    every = cut(nodes.select(*added.columns).unionByName(added))
    known = prov.unionByName(new_prov.join(decisions.filter(F.col("action").isin("new", "kept_contested")).select(
        F.col("claim_id").alias("finding_id")), "finding_id", "left_semi")).distinct()
    pick = lambda a: settled.filter(F.col("action") == a).select("claim_id", "target_id")
    merged, known = apply_merge(every, known, pick("merged"), new_prov, **how)
    nested, kept = apply_nest(merged, children, pick("nested"), new)
    return nested.drop("nested"), known, kept


def consolidation_summary(decisions: DataFrame, by: str = "batch") -> DataFrame:
    act = lambda a: F.count_if(F.col("action") == a).alias(a)
    nov = lambda n: F.count_if(X.novelty_tier(F.col("nearest_score")) == n).alias(n)
    return decisions.groupBy(by).agg(
        F.count("*").alias("n_in"), act("new"), act("merged"), act("nested"), act("kept_contested"),
        nov("novel"), nov("incremental"), nov("redundant"),
        F.count_if(F.col("action").isin("new", "kept_contested")).alias("distinct_added"))


# --- rewrites --------------------------------------------------------------------------------------
def provenance(nodes: DataFrame) -> DataFrame:
    """(finding_id, kind, value) rows of the array columns; the sentinel and blanks are dropped."""
    parts = [nodes.select("finding_id", F.lit(kind).alias("kind"), F.explode(col).alias("value"))
             for kind, col in (("url", "urls"), ("type", "source_types"), ("source", "source_ids")) if col in nodes.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(~F.col("value").isin("_", "")).distinct()


def _sticky(current: Column, by_count: Column, sticky: bool) -> Column:
    return F.when(current == V.CONTESTED, current).otherwise(by_count) if sticky else by_count


def apply_merge(nodes: DataFrame, prov: DataFrame, merges: DataFrame, new_prov: DataFrame,
                count_mode: str = "distinct_sources", sticky_contested: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fold merged claims into their nodes: provenance united, count and tier recomputed.

    ``distinct_sources`` ignores a source repeating itself; ``merges`` counts every merge.
    """
    moved = new_prov.join(merges.select(F.col("claim_id").alias("finding_id"), "target_id"), "finding_id").select(
        F.col("target_id").alias("finding_id"), "kind", "value")
    united = prov.unionByName(moved).distinct()
    n_merges = merges.groupBy(F.col("target_id").alias("finding_id")).agg(F.count("*").alias("n_merged"))
    n_src = united.filter("kind = 'source'").groupBy("finding_id").agg(F.count("*").alias("n_src"))
    out = nodes.join(n_merges, "finding_id", "left").join(n_src, "finding_id", "left")
    by_merges = F.col("corroboration_count") + F.coalesce("n_merged", F.lit(0))
    count = by_merges if count_mode == "merges" else F.greatest("corroboration_count", F.coalesce("n_src", F.lit(0)))
    touched = F.col("n_merged").isNotNull()
    out = out.withColumn("_c", F.when(touched, count).otherwise(F.col("corroboration_count")).cast("long"))
    tier = _sticky(F.col("confidence_tier"), X.tier_for_count(F.col("_c")), sticky_contested)
    return (out.withColumn("confidence_tier", F.when(touched, tier).otherwise(F.col("confidence_tier")))
            .withColumn("corroboration_count", F.col("_c")).drop("_c", "n_merged", "n_src"), united)


def apply_nest(nodes: DataFrame, children: DataFrame, nests: DataFrame, new: DataFrame,
               sticky_contested: bool = True) -> tuple[DataFrame, DataFrame]:
    """Keep each collaborating claim's own wording as a child row; the parent's claim is its first child."""
    add = nests.select("claim_id", "target_id").join(new.select("claim_id", "claim"), "claim_id").select(
        F.col("target_id").alias("finding_id"), F.col("claim_id").alias("child_id"), "claim")
    parents = nodes.join(add.select("finding_id").distinct(), "finding_id", "left_semi")
    seeds = (parents.join(children.select("finding_id").distinct(), "finding_id", "left_anti")
             .select("finding_id", F.col("finding_id").alias("child_id"), "claim"))
    every = children.unionByName(seeds).unionByName(add).dropDuplicates(["finding_id", "child_id"])   # a replay adds nothing
    n = every.join(add.select("finding_id").distinct(), "finding_id", "left_semi").groupBy("finding_id").agg(F.count("*").alias("n"))
    tier = _sticky(F.col("confidence_tier"), X.tier_for_count(F.col("n")), sticky_contested)
    out = nodes.join(n, "finding_id", "left")
    return (out.withColumn("confidence_tier", F.when(F.col("n").isNotNull(), tier).otherwise(F.col("confidence_tier")))
            .withColumn("corroboration_count", F.coalesce("n", "corroboration_count").cast("long"))
            .withColumn("nested", F.col("n").isNotNull()).drop("n"), every)


def dedupe_verbatim(df: DataFrame, t: float = V.VERBATIM, dry_run: bool = True) -> DataFrame:
    """Near-verbatim clusters folded into their smallest id, counts summed.

    ``dry_run`` reports one row per cluster of two or more; otherwise the rewritten nodes are returned.
    """
    comp = S.claim_clusters(df, t)
    joined = df.join(comp, "vec_id")
    per = joined.groupBy("component").agg(F.count("*").alias("members"), F.sum("corroboration_count").cast("long").alias("total"))
    if dry_run:
        return per.filter("members > 1").select(F.col("component").alias("keeper"), "members", "total")
    keep = joined.filter("vec_id = component").join(per, "component")
    many = F.col("members") > 1
    tier = _sticky(F.col("confidence_tier"), X.tier_for_count(F.col("total")), True)
    return (keep.withColumn("confidence_tier", F.when(many, tier).otherwise(F.col("confidence_tier")))
            .withColumn("corroboration_count", F.col("total")).drop("component", "members", "total"))


def remap_provenance(prov: DataFrame, members: DataFrame) -> DataFrame:
    """Provenance of folded nodes moved to their keeper; ``members`` is (finding_id, component)."""
    return prov.join(members, "finding_id").select(F.col("component").alias("finding_id"), "kind", "value").distinct()


# --- tier movement ---------------------------------------------------------------------------------
def promote(index: DataFrame, outcomes: DataFrame, floor: float = V.SAME_MEANING) -> tuple[DataFrame, DataFrame]:
    """(nodes with moved tiers, audit rows) from cluster outcomes matched to their best node.

    ``outcomes`` carries probe_id, branch_id, embedding, weight, n_families and is_gap.
    """
    hit = S.best_match(outcomes, index, floor).join(outcomes.select("probe_id", "weight", "n_families", "is_gap"), "probe_id")
    target = X.tier_rank(X.gated_tier(F.col("weight"), F.col("n_families")))
    per = hit.groupBy("vec_id").agg(F.max(F.when(~F.col("is_gap"), target).otherwise(0)).alias("target_rank"),
                                    F.bool_or("is_gap").alias("contest"), F.max("score").alias("match"),
                                    F.count("*").alias("n_outcomes"))
    name = F.element_at(F.array(*[F.lit(k) for k in V.TIER_RANK]), F.col("target_rank") + 1)
    moved = index.join(per, "vec_id", "left").withColumn("from_tier", F.col("confidence_tier")).withColumn(
        "confidence_tier", F.when(F.col("contest").isNull(), F.col("from_tier")).otherwise(
            X.moved_tier(F.col("from_tier"), name, F.col("contest"))))
    audit = moved.filter("from_tier <> confidence_tier").select(
        "vec_id", "from_tier", F.col("confidence_tier").alias("to_tier"), F.round("match", 3).alias("match"), "n_outcomes")
    return moved.drop("target_rank", "contest", "match", "n_outcomes", "from_tier"), audit


def apply_controversy(nodes: DataFrame, disputes: DataFrame) -> DataFrame:
    """A dispute naming both sides and at least two known findings marks them contested.

    Which names are known is asked once for each name: a finding that most disputes name is not a group of rows. A dispute's
    names meet in tasks of bounded rows.
    """
    sided = disputes.filter((F.trim(F.coalesce("side_a", F.lit(""))) != "") & (F.trim(F.coalesce("side_b", F.lit(""))) != ""))
    each = sided.select("dispute_id", F.explode(F.array_distinct("finding_ids")).alias("finding_id"))
    rows = sided.agg(F.coalesce(F.sum(F.greatest(F.size("finding_ids"), F.lit(0))), F.lit(0))).first()[0]
    known = each.select("finding_id").distinct().join(nodes.select("finding_id"), "finding_id", "left_semi")
    named = dealt(each.join(small_side(known), "finding_id", "left_semi"), "dispute_id", rows=4 * rows).distinct()      # names weigh, and are sorted
    valid = named.groupBy("dispute_id").agg(F.count("*").alias("n")).filter("n >= 2")
    hit = named.join(valid, "dispute_id", "left_semi").select("finding_id").distinct().withColumn("_c", F.lit(True))
    return nodes.join(hit, "finding_id", "left").withColumn(
        "confidence_tier", F.when(F.col("_c"), V.CONTESTED).otherwise(F.col("confidence_tier"))).drop("_c")


def retract(claims: DataFrame, contradictions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept claims, credibility events, failure rows) once lone claims contradicting consensus are removed."""
    bad = contradictions.filter("contradiction").select("probe_id").distinct()
    gone = claims.join(bad, "probe_id", "left_semi")
    events = gone.select(X.domain_of(F.col("url")).alias("domain"), F.col("probe_id").alias("event_id"), F.lit(-1).alias("delta"),
                         F.lit("contradicts multi-source consensus").alias("reason"))
    failures = gone.select(F.col("probe_id").cast("string").alias("question"), F.lit("post-flight").alias("where_failed"),
                           F.lit("retracted").alias("status"), F.col("branch_id").cast("string").alias("branch_id"))
    return claims.join(bad, "probe_id", "left_anti"), events, failures


def disagreement_input(findings: DataFrame, leans: DataFrame) -> DataFrame:
    """Per branch: contested rows against shared ground, with the lean defaulted; honest when empty."""
    label = X.standard_label(F.col("confidence_tier"))
    per = findings.groupBy("branch_id").agg(F.count_if(label == "contested").alias("n_contested"),
                                            F.count_if(label == "well-supported").alias("n_supported"))
    toward = F.trim(F.coalesce("toward", F.lit("")))
    contested = F.col("n_contested") > 0
    return per.join(leans, "branch_id", "left").select(
        "branch_id", "n_contested", "n_supported", contested.alias("contested"),
        F.when(contested, F.when(toward == "", "balanced").otherwise(toward)).alias("toward"),
        F.when(contested, X.within(F.col("magnitude"), V.LEDGER_MAGNITUDES, "slight")).alias("magnitude"))
