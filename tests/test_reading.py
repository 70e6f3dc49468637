"""Reading findings for a report, mergeable source sketches, and the SQL table function."""
import re

from pyspark.sql import functions as F
from test_plans import plan

from corrobora.operators import evidence, quality, reading

SCHEMA = ("finding_id string, branch_id string, claim string, source_types array<string>, urls array<string>, corroboration_count int, "
          "confidence_tier string, node_kind string")


def finding(i, claim, types=("web",), tier="Accepted", kind="finding", urls=("https://a.example.org/1", "_", "", None), n=2, branch="main"):
    return (i, branch, claim, list(types) if types is not None else None, list(urls) if urls is not None else None, n, tier, kind)


def test_gather_applies_every_rule_and_cuts_nothing(rows):
    f = rows(SCHEMA,
             finding("1", "  Monica Reza worked at the laboratory. ", ("primary_source",)),
             finding("2", "Monica Jacinto Reza invented an alloy.", n=0),
             finding("3", "Anthony Schiavo vanished near the laboratory.", ("podcast",), n=None),
             finding("4", "   "), finding("5", None), finding("6", "A gap.", kind="gap"), finding("7", "Excluded."),
             finding("8", "Nobody agrees on it.", ("web", "youtube"), tier="Speculative"), finding("9", "Sources are unknown.", None, kind=None, urls=None),
             finding("10", "Elsewhere.", branch="other"))
    truth = rows("finding_id string, confidence_tier string", ("8", "Controversial"), ("9", None), ("unknown", "Accepted"))
    names = rows("variant string, canonical string", ("Monica Reza", "Monica Jacinto Reza"), ("Reza", "Monica Jacinto Reza"), ("Schiavo", "Schiavo Group"))
    out = rows("finding_id string", ("7",), ("7",), ("none",), (None,))
    got = {r["finding_id"]: r for r in reading.gather(f, truth, out, branch="main").collect()}
    assert set(got) == {"1", "2", "3", "8", "9"}
    assert {i: r["label"] for i, r in got.items()} == {
        "1": "well-supported", "2": "well-supported", "3": "unverified", "8": "contested", "9": "well-supported"}
    assert got["1"]["urls"] == ["https://a.example.org/1"] and got["9"]["urls"] == []
    assert {i: r["corroboration"] for i, r in got.items()} == {"1": 2.0, "2": 1.0, "3": 1.0, "8": 2.0, "9": 2.0}
    named = {r["finding_id"]: r["claim"] for r in reading.gather(f, truth, out, resolved=names).collect()}
    assert named["1"] == named["1"].strip() and named["3"] == "Anthony Schiavo vanished near the laboratory."
    assert "10" in named and reading.gather(f.limit(0), truth, out).count() == 0


def test_gathered_claims_equal_plain_rewriting(rows):
    names = [("Ana Bel", "Ana Cruz Bel"), ("Dov Eln", "Mr Dov Eln"), ("Fay", "Fay Group")]
    claims = ["Ana Bel met Dov Eln and Ana Bel.", "Fay stays.", "Ana Belle stays.", "Dov Eln", "nobody"] * 7
    f = rows(SCHEMA, *[finding(str(i), c) for i, c in enumerate(claims)])
    truth = rows("finding_id string, confidence_tier string", ("0", "Accepted"))
    got = {r["finding_id"]: r["claim"] for r in reading.gather(f, truth, resolved=rows("variant string, canonical string", *names)).collect()}
    for i, c in enumerate(claims):
        for variant, canonical in sorted(names, key=lambda p: -len(p[0])):
            if variant not in canonical or canonical.endswith(variant):       # words may come in front or between, none behind
                c = re.sub(rf"\b{re.escape(variant)}\b", canonical, c)
        assert got[str(i)] == c


def test_sketches_of_batches_merge_to_the_whole(spark):
    a = spark.range(300_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("claim_id"),
                                    F.when(F.col("id") % 17 > 0, F.concat(F.lit("s"), F.col("id") % 90_000)).alias("source_id"))
    read = lambda d: {r["claim_id"]: r["n_sources"] for r in evidence.sketched_sources(d).collect()}
    whole = read(evidence.source_sketches(a))
    parts = [evidence.source_sketches(a.filter(F.crc32("source_id") % 5 == i)) for i in range(5)] + [evidence.source_sketches(a.filter("source_id IS NULL"))]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    merged = read(evidence.merge_sketches(union))
    exact = {r["claim_id"]: r["n"] for r in a.groupBy("claim_id").agg(F.count_distinct("source_id").alias("n")).collect()}
    assert set(whole) == set(merged) == set(exact)
    assert all(abs(d[k] - exact[k]) <= 0.03 * exact[k] for d in (whole, merged) for k in exact)
    assert evidence.source_sketches(a.limit(0)).count() == 0


def test_person_queries_as_a_table_function(spark, rows):
    quality.register_person_queries(spark, name="asked_of")
    e = rows("entity_id int, name string, context string", (1, " Mara  Voss ", "a physicist's case"), (2, "", "x"), (3, None, None), (4, "Ilya O'Neil", None))
    e.createOrReplaceTempView("asked_people")
    got = spark.sql("SELECT entity_id, q.pos, q.query FROM asked_people p, LATERAL asked_of(p.name, p.context) q")
    want = quality.person_queries_lateral(e)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 4
    text = plan(got)
    assert "EvalPython" not in text and "UDTF" not in text and "NestedLoop" not in text and "Cartesian" not in text
    assert [r["pos"] for r in spark.sql("SELECT * FROM asked_of('Mara', '')").collect()][:2] == [0, 1]
