"""Expected outcomes on small literal inputs with invented names."""
from pyspark.sql import functions as F

from corrobora.functions import exprs as X
from corrobora.operators import accounting, evidence, people, quality, ranking
from corrobora.sources import tables


def one(spark, expr, **lits):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k)
                                 for k, v in lits.items()], "id")
    return df.select(expr.alias("x")).first()["x"]


def test_evidence_weight(spark):
    w = lambda ts: one(spark, X.independent_evidence(F.col("t")), t=ts)
    assert (w(["llm"] * 3), w(["llm", "web", "youtube"]), w(["web", "web"])) == (1, 3, 2)


def test_tiers_and_labels(spark):
    assert [one(spark, X.tier_for_count(F.col("n")), n=n) for n in (3, 2, 1)] == ["Accepted", "Moderately Accepted", "Speculative"]
    label = lambda t: one(spark, X.standard_label(F.col("t")), t=t)
    assert (label("Accepted"), label("Controversial"), label("what"), label(None)) == ("well-supported", "contested", "unverified", "unverified")


def test_triangulation(spark):
    t = lambda ts: one(spark, X.is_triangulated(F.col("t")), t=ts)
    assert not t(["llm", "llm"]) and t(["llm", "youtube"])
    assert one(spark, X.is_triangulated(F.lit(None).cast("array<string>")))


def test_tier_moves_only_up_and_contest_sticks(spark):
    m = lambda cur, to, c: one(spark, X.moved_tier(F.col("a"), F.col("b"), F.lit(c)), a=cur, b=to)
    assert m("Accepted", "Speculative", False) == "Accepted"
    assert m("Speculative", "Accepted", False) == "Accepted"
    assert m("Controversial", "Accepted", False) == "Controversial"
    assert m("Accepted", "Accepted", True) == "Controversial"


def test_bands(spark):
    f = lambda s: one(spark, X.frontier(F.col("s")), s=s)
    assert f(0.5) <= 0.15 and f(0.3) >= 0.9 and f(0.05) <= 0.4


def test_recency(spark):
    asof = F.to_date(F.lit("2026-01-01"))
    ok = lambda d: one(spark, X.within_recency(F.col("d"), 2, asof), d=d)
    assert ok("2025-06-01T00:00:00Z") and not ok("2019-06-01T00:00:00Z") and ok("soon") and ok(None) is True
    y = lambda s: one(spark, X.years_for_freshness(F.col("s")), s=s)
    assert (y("Rapid"), y("annually"), y("stable")) == (2, 5, None)


def test_sensitive_gate(spark):
    s = lambda t: one(spark, X.sensitive_topic(F.col("t")), t=t)
    assert not s("a unique case") and s("IQ scores differ")


def test_questions(spark):
    bad = lambda q: one(spark, X.bad_question(F.col("q")), q=q)
    assert bad("Who found the body?") == "" and bad("  ") == "empty"
    assert bad("Is there any record of it?").startswith("asks whether") and bad("Who? What?").startswith("compound")
    assert bad("w " * 16) == "too long (16 words)"
    assert one(spark, X.strip_instructions(F.col("q")), q="Verify the identity, current status. Sources: Mara Voss") == "Mara Voss"


def test_names(spark):
    n = one(spark, X.proper_names(F.col("t")), t="Today mara spoke. Mara Elin Voss met Tomas Okafor and Ilya Brandt; Oslo waited.")
    assert set(n) == {"Mara Elin Voss", "Tomas Okafor", "Ilya Brandt"}
    p = lambda s: one(spark, X.plausible_person(F.col("s")), s=s)
    assert p("Mara Voss") and not p("Alder National Laboratory") and not p("Mara Voss's") and not p("Mara Voss Voss") and not p("The Voss")


def test_collapse_repeats(spark):
    assert one(spark, X.collapse_repeats(F.col("t")), t="Tarn Observatory Observatory opened") == "Tarn Observatory opened"


def test_abstract_from_inverted_index(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string,array<int>>")
    assert df.select(X.rebuild_abstract(F.col("m"))).first()[0] == "a b a"


def test_content_ids_are_stable_and_distinct(spark, rows):
    df = rows("b string, c string", ("x", "1"), ("x", "2"), ("x", "1"))
    ids = [r[0] for r in df.select(X.finding_id(F.col("b"), F.col("c"), F.lit(None))).collect()]
    assert ids[0] == ids[2] != ids[1] and len(ids[0]) == len("find_") + 12


def test_resolution(spark, rows):
    m = rows("name string, authoritative boolean", ("Mara Voss", True), ("Mara Elin Voss", True), ("Mara Elin", False),
             ("Mara Jonas Voss", False), ("Pavel Ivers", False))
    got = {r["variant"]: r for r in people.resolve_entities(m).collect()}
    assert {got[v]["canonical"] for v in ("Mara Voss", "Mara Elin", "Mara Jonas Voss")} == {"Mara Elin Voss"}
    assert got["Pavel Ivers"]["suspect"] and not got["Mara Voss"]["suspect"]


def test_bridging_name_unites_clusters(spark, rows):
    # order-free: the late row ties both, where a greedy pass would keep them apart
    m = rows("name string, authoritative boolean", ("Ana B C", True), ("Ana D C", True), ("Ana B", True), ("Ana D", True))
    assert len({r["canonical"] for r in people.resolve_entities(m).collect()}) == 1


def test_rewrite_and_demotion(spark, rows):
    f = rows("finding_id string, claim string, source_types array<string>, label string",
             ("a", "Mara Voss left.", ["web"], "well-supported"), ("b", "Mara Elin Voss spoke.", ["podcast"], "well-supported"),
             ("c", "United States Border Patrol and United States", ["web"], "contested"))
    r = people.resolve_entities(people.mentions(f))
    got = {x["finding_id"]: x["claim"] for x in people.normalize_names(f, r).collect()}
    assert got["a"] == "Mara Elin Voss left." or got["a"] == "Mara Voss left."
    assert got["c"] == "United States Border Patrol and United States"
    lab = {x["finding_id"]: x["label"] for x in people.demote_spoken(f).collect()}
    assert lab == {"a": "well-supported", "b": "unverified", "c": "contested"}


def test_safe_pairs(spark):
    s = lambda v, c: one(spark, people.safe_pair(F.col("v"), F.col("c")), v=v, c=c)
    assert not s("United States", "United States Border Patrol") and s("Elin Voss", "Mara Elin Voss")
    assert not s("Mara Elin Voss", "Mara Voss".replace("Mara ", "")) and s("Mara Vos", "Mara Elin Voss")


def test_namesake(spark):
    w = lambda c: one(spark, people.wrong_person(F.col("c"), F.col("n")), c=c, n="Mara Elin Voss")
    assert "different given name" in w("Police spoke with Ilya Voss on Monday.")
    assert w("Voss was seen in May.") == "" and w("The widow of Ilya Voss spoke.") == "" and w("Detective Voss spoke.") == ""
    assert "place/institution" in w("The Voss County office closed.") and w("Mara met Ilya Voss.") == ""


def test_year_conflict(spark, rows):
    f = rows("finding_id string, claim string", ("1", "Mara Voss died in 2011 after the 1994 budget."), ("2", "Mara Voss vanished in 2019."),
             ("3", "Mara Voss, a wine consultant, spoke."), ("4", "Mara Voss read the 1950 report."))
    cards = rows("name string, role string, employer string, place string, born int, died int", ("Mara Voss", "plasma physicist", "Tarn", "", None, 2020))
    kept, bad = people.screen(f, cards)
    assert {r["finding_id"] for r in bad.collect()} == {"1"}
    assert {r["finding_id"]: r["verdict"] for r in kept.collect()} == {"2": "ok", "3": "weak", "4": "ok"}
    blank = cards.select("name", F.lit("").alias("role"), F.lit("").alias("employer"), "place", "born", F.lit(None).cast("int").alias("died"))
    assert people.screen(f, blank)[1].count() == 0


def test_case_files_lose_nothing(spark, rows):
    f = rows("finding_id string, claim string", ("1", "Mara Voss and Tomas Okafor"), ("2", "nobody"))
    got = sorted(tuple(r) for r in people.case_files(f, rows("name string", ("Mara Voss",), ("Tomas Okafor",))).collect())
    assert got == [("1", "Mara Voss"), ("1", "Tomas Okafor"), ("2", "_unassigned")]


def report(rows, text):
    return rows("report_id int, text string", (1, text))


def test_count_fidelity_and_hedges(spark, rows):
    p = rows("report_id int, name string, status string, cause string", (1, "A B", "missing", ""), (1, "C D", "missing", ""), (1, "E F", "deceased", ""))
    bad = lambda t: [(r["status"], r["said"]) for r in quality.count_fidelity(report(rows, t), p).collect()]
    assert bad("Eight people are missing.") == [("missing", "eight")]
    assert bad("At least 10 missing were counted. Nine of the thirteen are deceased.") in ([], [("deceased", "nine")])
    assert bad("two people are missing and one is deceased") == []


def test_profile_fidelity(spark, rows):
    p = rows("report_id int, name string, status string, cause string", (1, "Mara Voss", "missing", ""), (1, "Tomas Okafor", "deceased", "gunshot wound"),
             (1, "Vera Quill", "missing", None))
    got = {(r["name"], r["kind"]) for r in quality.profile_fidelity(report(rows, "Mara Voss was found dead and is missing. Tomas Okafor is deceased."), p).collect()}
    assert got == {("Mara Voss", "INVENTED"), ("Tomas Okafor", "LOST"), ("Vera Quill", "MISSING")}


def test_style(spark, rows):
    d = rows("report_id int, text string", (1, "Thirteen individuals vanished."), (2, "the hum of the morning. Is the nation facing forces yet unknown?"))
    got = sorted((r["report_id"], r["kind"]) for r in quality.voice_lint(d, "report_id").collect())
    assert got == [(2, "banned phrase"), (2, "mood opener"), (2, "rhetorical question")]


def test_html_and_captions(spark, rows):
    h = rows("html string", ("<p>caf&eacute; &amp; more</p><script>x</script>" + "<b>word </b>" * 60,))
    t = h.select(tables.html_text(F.col("html"))).first()[0]
    assert t.startswith("café & more word") and "x<" not in t and h.select(tables.html_text(F.lit("<p>hi</p>"))).first()[0] is None
    c = rows("raw string", ("WEBVTT\n\n1\n00:01 --> 00:02\n <b>hello</b> \n2\nthere",), ('[{"text":"a"},{"text":"b"}]',), ('{"body":[{"text":"c"}]}',), (None,))
    assert [r["text"] for r in tables.normalize_captions(c).collect()] == ["hello there", "a b", "c", ""]


def test_budget_cut_reports_what_it_left(spark, rows):
    f = rows("finding_id string, label string, corroboration_count int, claim string", ("a", "x", 1, "aaaa"), ("b", "x", 3, "bbbb"), ("c", "x", 2, "cccc"))
    got = sorted((r["finding_id"], r["n_kept"], r["n_total"]) for r in ranking.budget_cut(f, 16).collect())
    assert got == [("b", 2, 3), ("c", 2, 3)]


def test_merge_counts_sources_not_repeats(spark, rows):
    nodes = rows("finding_id string, claim string, confidence_tier string, corroboration_count int, urls array<string>, source_types array<string>, source_ids array<string>",
                 ("n", "c", "Speculative", 1, ["u0"], ["web"], ["s0"]), ("k", "c", "Controversial", 1, [], ["web"], ["s9"]))
    merges = rows("claim_id string, target_id string", ("m1", "n"), ("m2", "n"), ("m3", "k"))
    prov = rows("finding_id string, kind string, value string", ("m1", "source", "s0"), ("m2", "source", "s1"), ("m1", "url", "u1"), ("m3", "source", "s1"))
    out, united = evidence.apply_merge(nodes, evidence.provenance(nodes), merges, prov)
    got = {r["finding_id"]: (r["corroboration_count"], r["confidence_tier"]) for r in out.collect()}
    assert got == {"n": (2, "Moderately Accepted"), "k": (2, "Controversial")}
    again, _ = evidence.apply_merge(out, united, merges, prov)
    assert {r["finding_id"]: r["corroboration_count"] for r in again.collect()} == {"n": 2, "k": 2}     # replay changes nothing
    by_merges, _ = evidence.apply_merge(nodes, evidence.provenance(nodes), merges, prov, count_mode="merges", sticky_contested=False)
    assert {r["finding_id"]: r["corroboration_count"] for r in by_merges.collect()} == {"n": 3, "k": 2}


def test_upper_median(spark, rows):
    c = rows("name string, n bigint", ("a", 1), ("b", 4), ("c", 10), ("d", 20))
    got = people.thin_entities(c).collect()
    assert {(r["name"], r["median"], r["floor"]) for r in got} == {("a", 10, 5), ("b", 10, 5)}


def test_saturation_empty_round_is_failure(spark, rows):
    log = rows("novel int, incremental int, redundant int, kb_reuse int", (0, 0, 0, 0), (0, 5, 15, 0), (5, 1, 1, 0), (0, 0, 0, 1))
    assert [r["state"] for r in accounting.saturation(log).collect()] == ["failed", "saturated", "continue", "continue"]
