"""Time the registered queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "A1_all_findings", "A2_upsert_raw", "A9_html_to_text", "A11_outbound_links", "B16_target_domains", "B20_person_queries",
    "B22_tokenizers", "C2_case_files", "C3_screen", "C6_knn_filtered", "C7_sim_pairs", "C8_score_novelty", "C13_bm25_search",
    "C15_hybrid", "C16_novel_claims", "C18_shared_org", "C26_expand_refs", "D1_cluster_outcomes", "D2_evidence_labels",
    "D9_findings_per_entity", "D11_coverage_audit", "D19_lean_card", "D22_coverage_score", "E2_budget_cut", "E5_rotate_angles",
    "G1_components", "G2_claim_clusters", "G4_resolve_entities", "H1_decide", "H2_apply_merge", "H4_dedupe_verbatim",
    "I2_tier_stream", "I4_credibility_fold", "I5_stalls", "J2_voice_lint", "J3_count_fidelity", "J4_profile_fidelity")

#: joins whose growth with ten times the rows is reported
GROWTH = ("C6_knn_filtered", "C7_sim_pairs", "C16_novel_claims", "G1_components", "G2_claim_clusters", "H1_decide")


def session():
    from pyspark.sql import SparkSession
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main(names=None):
    from corrobora.plans.catalog import load_all
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    entries, spark, times = load_all(), session(), {}
    entries["A6_branch_stats"].run(spark, sf_dir).collect()      # start the engine outside the timings
    for name in names or HEADLINE:
        t0 = time.perf_counter()
        try:
            entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as ex:
            times[name] = None
            print(name, str(ex)[:300], file=sys.stderr)
        if "-v" in sys.argv:
            print(name, times[name], file=sys.stderr, flush=True)
    growth = {}
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    for name in GROWTH if names is None and os.path.isdir(small) and small != sf_dir.rstrip("/") else ():
        if times.get(name):
            entries[name].run(spark, small).write.format("noop").mode("overwrite").save()        # as warm as the large run was
            t0 = time.perf_counter()
            entries[name].run(spark, small).write.format("noop").mode("overwrite").save()
            growth[name] = round(times[name] / max(0.001, time.perf_counter() - t0), 2)
    total = round(sum(v for v in times.values() if v), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "growth_from_sf0.01": growth,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    if "--all" in sys.argv:
        from corrobora.plans.catalog import load_all
        main(list(load_all()))
    else:
        main()
