"""Large-group paths against brute force: skewed keys, exact copies, tiny tiles, many keys, empty input."""
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from corrobora.operators import citations, graph, lexical, matching, ordering, similarity
from corrobora.streaming import ledgers, pacing


def vectors(rng, n, dim=8, copies=()):
    v = rng.normal(size=(n, dim))
    for i, j in copies:
        v[j] = v[i]
    return v


def frame(spark, v, ident="vec_id", scope=None):
    return spark.createDataFrame([(i, scope[i] if scope else 0, [float(x) for x in r]) for i, r in enumerate(v)], f"{ident} long, branch_id int, embedding array<double>")


def cosine(a, b):
    a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    return np.round(a @ b.T, 4)


def test_pairs_equal_brute_force_with_tiny_tiles_and_copies(spark):
    rng = np.random.default_rng(1)
    v = vectors(rng, 120, copies=[(3, i) for i in range(60, 100)])      # a third of all rows are one vector
    got = {(r["a_id"], r["b_id"]) for r in similarity.sim_pairs(frame(spark, v), 0.5, block=7).collect()}
    s = cosine(v, v)
    head = [i for i in range(120) if not 60 <= i < 100]
    want = {(a, b) for a in head for b in head if a < b and s[a, b] >= 0.5} | {(3, i) for i in range(60, 100)}
    assert got == want


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    v = vectors(rng, 90, dim=4, copies=[(0, i) for i in range(50, 80)])
    got = {r["vec_id"]: r["component"] for r in similarity.claim_clusters(frame(spark, v), 0.9, block=8).collect()}
    s, label = cosine(v, v), list(range(90))
    changed = True
    while changed:
        changed = False
        for a in range(90):
            for b in range(90):
                if s[a, b] >= 0.9 and label[b] > label[a]:
                    label[b], changed = label[a], True
    assert [got[i] for i in range(90)] == label


def test_knn_equals_brute_force_per_branch(spark):
    rng = np.random.default_rng(3)
    v, q = vectors(rng, 150, copies=[(1, i) for i in range(100, 140)]), vectors(rng, 12)
    scope = [0 if i < 110 else i % 3 for i in range(150)]
    got = {}
    for r in similarity.knn(frame(spark, q, "probe_id", [0] * 12), frame(spark, v, scope=scope), 4, block=9).collect():
        got.setdefault(r["probe_id"], {})[r["rank"]] = r["vec_id"]
    s = cosine(q, v)
    for i in range(12):
        want = sorted((j for j in range(150) if scope[j] == 0), key=lambda j: (-s[i, j], j))[:4]
        assert [got[i][k + 1] for k in range(4)] == want


def test_knn_on_empty_index(spark):
    v = frame(spark, vectors(np.random.default_rng(0), 3))
    assert similarity.knn(v.withColumnRenamed("vec_id", "probe_id"), v.limit(0), 2).count() == 0
    assert similarity.sim_pairs(v.limit(0), 0.5).count() == 0


def test_wrong_dimension_fails(spark):
    import pytest
    with pytest.raises(Exception, match="expected 9 dimensions"):
        similarity.normalize_vec(frame(spark, vectors(np.random.default_rng(0), 2)), 9).collect()


def test_components_on_chain_star_and_isolated(spark):
    e = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(500, 500)]
    edges = spark.createDataFrame(e, "a long, b long").repartition(5)
    nodes = spark.createDataFrame([(i,) for i in [*range(0, 60), *range(100, 161), 500, 600]], "n long")
    got = {r["n"]: r["component"] for r in graph.components(edges, nodes, "a", "b", "n").collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[i] == 100 for i in range(100, 161)) and got[500] == 500 and got[600] == 600


def test_contains_join_paths_agree(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    texts = spark.createDataFrame([(i, word(60)) for i in range(80)] + [(99, None)], "id int, t string")
    keys = spark.createDataFrame([(word(rnd.randint(1, 10)),) for _ in range(70)] + [(None,), ("",)], "k string")
    run = lambda n: sorted(tuple(r) for r in matching.contains_join(texts, "id", F.col("t"), keys, "k", inline_limit=n).collect())
    want = sorted({(r["id"], k["k"]) for r in texts.collect() for k in keys.collect() if r["t"] and k["k"] and k["k"] in r["t"]})
    assert run(512) == want and run(3) == want


def test_contains_join_with_many_keys_of_all_lengths(spark):
    """Thousands of keys of 3 to 20 characters, beyond plain letters, by the automaton and by the anchor filter."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdé\U0001F600 ") for _ in range(n))
    texts = [(i, word(150)) for i in range(200)] + [(900, None), (901, ""), (902, word(20_000))]
    keys = {word(rnd.randint(3, 20)) for _ in range(1500)} | {t[5:5 + rnd.randint(3, 20)] for _, t in texts[:200]}
    df = spark.createDataFrame(texts, "id int, t string").repartition(3)
    ks = spark.createDataFrame([(k,) for k in sorted(keys)] * 2, "k string")
    want = sorted((i, k) for i, t in texts if t for k in keys if k in t)
    for limit in (10_000, 100):
        assert sorted(map(tuple, matching.contains_join(df, "id", F.col("t"), ks, "k", inline_limit=limit).collect())) == want
    assert matching.contains_join(df, "id", F.col("t"), ks.limit(0), "k").count() == 0


def test_sub_names_meet_without_subsets(spark):
    """Names of forty tokens, and random ones: components equal those of the plain relation between all pairs."""
    from corrobora.operators import people
    rnd = random.Random(9)
    names = {" ".join(rnd.choice("abcde") + rnd.choice("xy") for _ in range(rnd.randint(1, 5))) for _ in range(120)}
    long = ["zed"] + [f"t{i}" for i in range(39)]
    names |= {" ".join(long), "zed t7 t30", "Zed t30 T7", "zed", "other t7 t30"}
    names = sorted(names)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["component"] for r in graph.components(people.same_entity_edges(df), df, "name", "other", "name").collect()}
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in names:
        for b in names:
            ta, tb = a.lower().split(), b.lower().split()
            if ta[0] == tb[0] and (ta[-1] == tb[-1] or set(ta) <= set(tb) or set(tb) <= set(ta)):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {n: root(n) for n in names}


def test_known_claims_equal_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["w" + "".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(40)]
    claim = lambda: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 30)))
    new, old = [(i, claim()) for i in range(60)], [(i, claim()) for i in range(60)]
    old += [(100 + i, old[0][1]) for i in range(40)]
    df = lambda d: spark.createDataFrame(d, "claim_id int, claim string")
    got = {r["claim_id"]: r["known"] for r in lexical.known_claims(df(new), df(old)).collect()}
    for i, c in new:
        a = set(c.split())
        want = any(a and b and len(a & b) / min(len(a), len(b)) >= 0.6 for b in (set(x.split()) for _, x in old))
        assert got[i] == want, i


def test_word_sets_meet_in_small_blocks_and_no_pair_is_a_row(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    sets = lambda n, top: [(f"s{i}".encode(), rnd.sample(vocab, rnd.randint(1, top))) for i in range(n)]
    new, old = sets(80, 100), sets(60, 100) + sets(20, 3)
    df = lambda d: spark.createDataFrame(d, "set_id binary, ws array<string>").select(
        "set_id", F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    met = lexical._known_sets(df(new), df(old), 0.6, block=700)
    got = [bytes(r["set_id"]) for r in met.collect()]
    enough = lambda a, b: len(set(a) & set(b)) >= 0.6 * min(len(a), len(b)) - 1e-9
    assert sorted(got) == sorted(i for i, a in new if any(enough(a, b) for _, b in old))
    assert 0 < len(got) < len(new) and "e_set" not in met._jdf.queryExecution().toString()


def test_bm25_repeats_count_and_exact_terms_rank_first(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha alpha gamma"), (3, "delta")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "gamma"), (2, "alpha"), (3, "alpha alpha")], "query_id int, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.bm25_search(q, docs, 5).collect()}
    assert set(k for k in got if k[0] == 1) == {(1, 2)} and abs(got[(3, 2)] - 2 * got[(2, 2)]) < 1e-5


def skewed(spark, n=900):
    rnd = random.Random(6)
    data = [("hot" if i % 3 else f"k{i % 7}", rnd.randint(0, 10**6), i, rnd.choice([-1, 1])) for i in range(n)]
    return data, spark.createDataFrame(data, "g string, o int, i int, v int").repartition(6)


def test_chunked_positions_and_sums(spark):
    data, df = skewed(spark)
    want, run, prev = {}, {}, {}
    for g in {d[0] for d in data}:
        total, last = 0, None
        for p, d in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2]))):
            total += d[3]
            want[d[2]], run[d[2]], prev[d[2]], last = p + 1, total, last, d[1]
    col = lambda d, c: {r["i"]: r[c] for r in d.collect()}
    assert col(ordering.row_numbers(df, ["g"], ["o", "i"], "n"), "n") == want
    assert col(ordering.running_sum(df, ["g"], ["o", "i"], "v", "s"), "s") == run
    assert col(ordering.previous(df, ["g"], ["o", "i"], "o", "p"), "p") == prev


def test_credibility_fold_equals_sequential_clamp(spark):
    data, df = skewed(spark)
    ev = df.select(F.col("g").alias("domain"), F.lpad(F.col("o").cast("string"), 8, "0").alias("ts"), F.col("i").alias("event_id"),
                   F.when(F.col("i") < 600, 1).otherwise(F.col("v")).alias("delta"), F.col("v").cast("string").alias("reason"))
    got = {r["domain"]: (r["score"], r["n"]) for r in ledgers.credibility_fold(ev).collect()}
    for g in {d[0] for d in data}:
        s, n = 0.5, 0
        for d in sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2])):
            s, n = round(max(0.05, min(0.95, s + 0.05 * (1 if d[2] < 600 else d[3]))), 3), n + 1
        assert got[g] == (s, n)


def test_lateral_nudge(spark):
    s = spark.createDataFrame([("a", 0.95), ("b", 0.5), ("c", 0.5)], "domain string, score double")
    v = spark.createDataFrame([("a", "credible"), ("b", "low"), ("c", "mixed")], "domain string, verdict string")
    assert {r["domain"]: r["score"] for r in ledgers.lateral_nudge(s, v).collect()} == {"a": 0.95, "b": 0.45, "c": 0.5}


def test_pacing_in_flight(spark):
    log = spark.createDataFrame([("exa", i, t, d) for i, (t, d) in enumerate([("2024-01-01 00:00:00", 10.0), ("2024-01-01 00:00:01", 10.0), ("2024-01-01 00:00:01.1", 1.0), ("2024-01-01 00:00:11", 1.0)])],
                                "provider string, event_id int, ts string, duration_s double").withColumn("ts", F.to_timestamp("ts"))
    r = pacing.pacing_audit(log).first()
    assert (r["requests"], r["too_close"], r["max_in_flight"], r["over_limit"]) == (4, 1, 3, 0)


def test_expansion_stops_at_gated_and_reports_total(spark):
    w = spark.createDataFrame([(1, [2, 3], "oa", None), (2, [4], None, None), (3, [5], None, "text"), (4, [], "oa", None), (5, [1], "oa", None)],
                              "work_id int, referenced_works array<int>, oa_url string, abstract string").withColumn("doi", F.lit("d")).withColumn("landing_page_url", F.lit(None).cast("string"))
    seeds = spark.createDataFrame([(1,)], "work_id int")
    got = {r["work_id"]: r["level"] for r in citations.expand_refs(w, seeds, depth=3).collect()}
    assert got == {2: 1, 3: 1, 5: 2, 1: 3}       # 4 hides behind the gated work 2
    cut = citations.expand_refs(w, seeds, depth=3, max_total=2).collect()
    assert len(cut) == 2 and all(r["n_total"] == 4 for r in cut)


def test_results_do_not_depend_on_partitioning(spark):
    from corrobora.operators.evidence import evidence_tiers
    from corrobora.plans.views import Tables
    a = Tables(spark, "/root/testdata/sf0.001").v_assertions
    one = sorted(map(tuple, evidence_tiers(a.coalesce(1)).collect()))
    many = sorted(map(tuple, evidence_tiers(a.unionByName(a).orderBy(F.rand(7)).repartition(9)).collect()))
    assert one == many      # shuffled and duplicated input changes nothing


def test_homes_are_shipped_by_the_visits_of_their_cell(spark, monkeypatch):
    """Twenty clean clusters: rows shipped grow with the rows, not with their square; cells without visits ship nothing."""
    from corrobora.operators import similarity as S
    seen, tiles = [], S._tiles

    def counted(*args):
        out = tiles(*args)
        seen.append({r["side"]: r["count"] for r in out.groupBy("side").count().collect()})
        return out
    monkeypatch.setattr(S, "_tiles", counted)
    rng = np.random.default_rng(2)
    centres = np.linalg.qr(rng.normal(size=(32, 20)))[0].T
    sent = []
    for n in (2_000, 4_000):
        data = [(i, "b", (centres[i % 20] + rng.normal(size=32) * 0.01).tolist()) for i in range(n)]
        df = spark.createDataFrame(data, "vec_id long, branch_id string, embedding array<double>").repartition(4)
        S.sim_pairs(df, 0.999, block=100).count()
        S.knn(df.withColumnRenamed("vec_id", "probe_id"), df, 2, floor=0.9, block=100).count()
        few = df.filter("vec_id % 20 = 3").withColumnRenamed("vec_id", "probe_id")
        assert S.knn(few, df, 2, floor=0.9, block=100).count() == 2 * few.count()
        sent.append([sum(x.values()) for x in seen])
        seen.clear()
    assert all(b <= 2.6 * a for a, b in zip(sent[0][:2], sent[1][:2])), sent
    assert sent[1][2] <= 4_000 / 2, sent


def test_a_task_reads_its_vectors_from_batches(spark):
    rows = [("b", 0, [1.0, 2.0]), ("x", 1, [3.0, 4.0]), ("a", 0, [5.0, 6.0])]
    vec = pa.array([v for _, _, v in rows], pa.list_(pa.float64()))
    table = pa.table({"id": [i for i, _, _ in rows], "side": [s for _, s, _ in rows], "vec": vec})
    hid, hm, _, vid, vm, _ = similarity._sides(table.to_batches(max_chunksize=1))
    assert list(hid) == ["a", "b"] and hm.tolist() == [[5.0, 6.0], [1.0, 2.0]] and list(vid) == ["x"] and vm.tolist() == [[3.0, 4.0]]
    assert similarity._sides(table.filter(pc.equal(table["side"], 1)).to_batches()) is None
