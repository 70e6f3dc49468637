"""Cases that the given tables do not hold: copies, nulls, replays, long lists."""
import math

import numpy as np
from pyspark.sql import functions as F

from corrobora.functions import vocab as V
from corrobora.operators import citations, evidence, lexical, links, ranking, similarity
from corrobora.plans.evidence import ingested
from corrobora.plans.views import Tables
from corrobora.sources import tables
from corrobora.streaming import ledgers, streams

VEC = "vec_id long, branch_id string, embedding array<double>"


def turned(cos):
    return [cos, math.sqrt(1 - cos * cos)]


def test_pairs_name_classes_of_equal_vectors(rows):
    df = rows(VEC, (1, "A", [1.0, 0.0]), (2, "A", [2.0, 0.0]), (4, "A", [2.0, 0.0]), (3, "A", turned(0.8)))
    got = {(r["a_id"], r["b_id"]): r["score"] for r in similarity.sim_pairs(df, 0.7).collect()}
    assert got.pop((2, 4)) == 1.0
    assert got == {(1, 2): 1.0, (1, 3): 0.8, (2, 3): 0.8}       # (4, 3) follows from 4 being in 2's class
    comp = {r["component"] for r in similarity.claim_clusters(df, 0.7).collect()}
    assert comp == {1}


def test_bridges_keep_copies_and_rank_rows(rows):
    df = rows(VEC, (1, "A", [1.0, 0.0]), (2, "C", [1.0, 0.0]), (3, "A", turned(0.8)), (5, "C", turned(0.999)), (6, "A", [0.0, -1.0]))
    got = {(r["a_id"], r["b_id"]): (r["score"], r["n_total"]) for r in similarity.bridge_all(df, 0.5).collect()}
    assert got == {(1, 2): (1.0, 2), (3, 5): (round(0.8 * 0.999 + 0.6 * math.sqrt(1 - 0.999 ** 2), 4), 2)}      # one best partner a row
    assert similarity.bridge_all(df, 0.5, per_pair=1, top=1).first()["n_total"] == 2


def test_blocks_of_any_size_and_earlier_only(rows, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(60, 3)), 1)
    df = rows(VEC, *[(i, "A", x.tolist()) for i, x in enumerate(v)])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.rint((unit @ unit.T) * 1e4) / 1e4
    got = {(r["probe_id"], r["rank"]): (r["vec_id"], r["score"]) for r in similarity.knn(
        df.withColumnRenamed("vec_id", "probe_id"), df, 3, earlier=True, block=16).collect()}
    for i in range(60):
        want = sorted((-cos[i, j], j) for j in range(i))[:3]
        assert [got.get((i, r + 1)) for r in range(len(want))] == [(j, -s) for s, j in want]
    a, b = similarity._spanning(np.array([5, 7, 1]), np.array([7, 9, 2]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 2), (5, 7), (5, 9)]


def test_own_copies_leave_before_the_top_k(rows):
    docs = [(i, "the same old words") for i in range(4)] + [(10 + i, f"the same old words again {i}") for i in range(6)]
    d = rows("doc_id long, text string", *docs)
    vec = d.select(F.col("doc_id").alias("vec_id"), F.lit("x").alias("branch_id"), F.array(F.lit(1.0), F.col("doc_id") * 0.01).alias("embedding"))
    q = d.filter("doc_id = 0").select(F.col("doc_id").alias("query_id"), "text").join(vec.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    got = [r["doc_id"] for r in links.verify_evidence(q, d, vec, k=5).collect()]
    assert len(got) == 5 and all(i >= 10 for i in got)
    claims = d.join(vec.withColumnRenamed("vec_id", "doc_id"), "doc_id").withColumnRenamed("doc_id", "probe_id")
    none = rows("probe_id long, contradicts boolean")
    n = {r["probe_id"]: r["consensus_size"] for r in similarity.consensus(claims, claims.withColumnRenamed("probe_id", "vec_id"), none, text="text").collect()}
    assert n[0] == 6 and n[10] == 7


def test_batch_and_stream_tiers_agree_on_nulls(rows):
    a = rows("claim_id long, source_id string, source_type string, stance string",
             (1, "a", None, "agree"), (1, "b", None, "agree"), (1, "c", None, "agree"), (2, "a", "web", None), (2, "b", "news", None), (2, "c", "paper", None),
             (3, "a", "llm", None), (3, "a", "web", "agree"), (3, "a", "web", None), (4, "a", "web", "contradict"), (5, None, None, None))
    batch = {r["claim_id"]: (r["confidence_tier"], r["contested"]) for r in evidence.evidence_tiers(a).collect()}
    stream = {r["claim_id"]: r["confidence_tier"] for r in streams.tier_stream(a).collect()}
    assert {k: t for k, (t, _) in batch.items()} == stream
    assert {k: c for k, (_, c) in batch.items()} == {1: False, 2: False, 3: False, 4: True, 5: False}
    assert batch[1][0] == "Accepted"


def test_escaped_links_and_plain_caption_lists(rows):
    page = r'{"shortDescription":"see https:\/\/a.org\/q?x=1&y=2 \"and\"\nhttps://b.org/z"}'
    got = [r["url"] for r in tables.description_links(rows("page_id long, page string", (1, page)), "page_id", "page").collect()]
    assert got == ["https://a.org/q?x=1&y=2", "https://b.org/z"]
    raw = rows("doc_id long, raw string", (1, '["one", "two"]'), (2, '[{"text":"three"}]'), (3, "plain"))
    assert [r["text"] for r in tables.normalize_captions(raw).orderBy("doc_id").collect()] == ["one two", "three", "plain"]


def test_nesting_again_changes_nothing(rows):
    nodes = rows("finding_id string, claim string, corroboration_count long, confidence_tier string", ("f", "c", 1, "Speculative"))
    none = rows("finding_id string, child_id string, claim string")
    nests, new = rows("claim_id string, target_id string", ("n", "f")), rows("claim_id string, claim string", ("n", "other"))
    once, kids = evidence.apply_nest(nodes, none, nests, new)
    again, kids2 = evidence.apply_nest(once.drop("nested"), kids, nests, new)
    assert once.drop("nested").collect() == again.drop("nested").collect() and kids.count() == kids2.count() == 2


def test_ingesting_a_batch_again_changes_nothing(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    once = ingested(t)
    again = ingested(t, once)
    for a, b in zip(once, again):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_nothing_is_cut_unless_asked(rows):
    h = rows("hyp_id long, verdict string, disconfirming array<string>", (1, "survives", ["x"] * 6), (2, "refuted", ["x"] * 60), (3, "survives", []))
    assert {r["hyp_id"]: (r["n_disconfirming"], r["rank"]) for r in ranking.ach_table(h).collect()} == {3: (0, 1), 1: (6, 2), 2: (60, 3)}
    works = rows("work_id long, referenced_works array<long>, oa_url string, doi string, landing_page_url string, abstract string, cited_count long, pub_year int",
                 *[(i, list(range(1, 31)) if i == 0 else [0], "u", None, None, None, i, 2000) for i in range(31)])
    seeds = works.filter("work_id = 0").select("work_id")
    walk = citations.expand_refs(works, seeds, depth=1).collect()
    assert len(walk) == 30 and {r["n_total"] for r in walk} == {30}
    off = citations.expand_refs(works, seeds, depth=2, off_topic=works.filter("work_id = 5").select("work_id")).collect()
    assert {r["work_id"] for r in off if r["off_topic"]} == {5}
    cited = citations.cited_by(works, seeds).collect()
    assert len(cited) == 30 and {r["n_total"] for r in cited} == {30}
    assert {r["n_total"] for r in citations.cited_by(works, seeds, k=2).collect()} == {30}


def test_free_rows_and_null_moves(rows):
    f = rows("finding_id string, label string, claim string, corroboration_count long", ("a", "x", "", 1), ("b", "x", "four", 2))
    assert ranking.budget_cut(f, 4, overhead=0).count() == 2
    e = rows("domain string, ts timestamp, event_id long, delta int, reason string", ("d", None, 1, None, None), ("d", None, 2, 1, "up"))
    r = ledgers.credibility_fold(e).first()
    assert r["n"] == 2 and abs(r["score"] - V.CRED_DEFAULT - V.CRED_STEP) < 1e-9


def test_own_text_never_counts_in_word_search(rows):
    d = rows("doc_id long, text string", (1, " Same WORDS "), (2, "same words too"))
    q = rows("query_id long, text string", (9, "same words"))
    assert [r["doc_id"] for r in lexical.bm25_search(q, d, 5, skip_own_text=True).collect()] == [2]
