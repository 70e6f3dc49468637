"""What a task holds or ships doesn't grow with the table; results against brute force."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora import session
from corrobora.operators import evidence, similarity as S
from corrobora.plans.catalog import load_all

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k, least, gap", [(1, 3000, 0), (3, -10**9, 0), (3, -10**9, 1), (8, 0, 5)])
def test_best_in_steps_equals_all_products(monkeypatch, k, least, gap):
    monkeypatch.setattr(S, "STEP", 16)
    rng = np.random.default_rng(k)
    h = S._unit_rows(rng.normal(size=(150, 12)))
    h[40:70] = h[3]                                          # ties, more than k
    v = np.concatenate([h[:30], S._unit_rows(rng.normal(size=(25, 12)))])
    allowed = lambda row, home: (row + home) % 7 >= gap
    got = {}
    for i, row, home, score in S._best(v, h, k, least, allowed):
        for r, c, s in zip(row, home, score):
            got.setdefault(int(i + r), []).append((int(c), int(s)))
    s = np.rint(v @ h.T * 1e4).astype(int)
    for r in range(len(v)):
        want = sorted(((c, s[r, c]) for c in range(len(h)) if s[r, c] >= least and allowed(r, c)), key=lambda x: (-x[1], x[0]))[:k]
        assert got.get(r, []) == want


def test_cells_are_those_of_a_scope(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, i % 10, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(200, 4)))], "id long, scope int, embedding array<double>")
    pivots, _ = S._pivots(df, 10)
    assert len(pivots.value) == 2                            # of 20 rows each; blocks of all rows would be 14


def test_bridges_between_branches_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    v, branch = rng.normal(size=(60, 5)), [i % 4 for i in range(60)]
    df = spark.createDataFrame([(i, branch[i], [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, branch_id int, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 4)
    want = set()
    for a in range(60):
        for b in range(branch[a] + 1, 4):
            best = min((x for x in range(60) if branch[x] == b), key=lambda x: (-s[a, x], x))
            if s[a, best] >= 0.5:
                want.add((a, best, s[a, best]))
    assert {(r["a_id"], r["b_id"], r["score"]) for r in S.bridge_all(df).collect()} == want


def exchanges(df):
    return [int(n) for n in re.findall(r"REPARTITION_BY_NUM|hashpartitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString()) if n]


def test_tasks_of_clusters_and_disputes_follow_the_rows(spark, monkeypatch):
    for name, steps in (("D1_cluster_outcomes", 3), ("H6_apply_controversy", 1)):
        df = load_all()[name].run(spark, SF)
        before = sorted(map(tuple, df.collect()), key=repr)
        monkeypatch.setattr(session, "TASK_ROWS", 100)
        df = load_all()[name].run(spark, SF)
        assert len([n for n in exchanges(df) if n > 20]) >= steps
        assert sorted(map(tuple, df.collect()), key=repr) == before
        monkeypatch.setattr(session, "TASK_ROWS", 1_000_000)


def test_clusters_with_missing_labels_and_types(rows):
    claims = rows("cluster_id int, source_label string, source_type string", (1, "a", "x"), (1, "a", "y"), (1, None, "x"), (1, "b", None), (2, "a", "x"), (2, None, None), (3, "c", "x"), (3, "d", "x"), (3, "d", "x"))
    out = evidence.cluster_outcomes(claims, rows("cluster_id int, stance string", (3, "mixed"))).orderBy("cluster_id").collect()
    assert [tuple(r) for r in out] == [(1, "corroboration", 2, 2, 4, None), (3, "gap", 2, 1, 3, 0.5)]


def test_a_dispute_in_several_rows_and_repeated_names(rows):
    nodes = rows("finding_id string, confidence_tier string", *[(f"f{i}", "Accepted") for i in range(5)])
    d = rows("dispute_id int, finding_ids array<string>, side_a string, side_b string", (1, ["f0", "f0", "zz"], "a", "b"), (2, ["f1"], "a", "b"), (2, ["f2", None], "a", "b"),
             (3, ["f3", "f4"], " ", "b"), (4, None, "a", "b"), (5, ["f0"], "a", "b"), (5, ["f0"], "a", "b"))
    got = {r["finding_id"] for r in evidence.apply_controversy(nodes, d).filter(F.col("confidence_tier") == "Controversial").collect()}
    assert got == {"f1", "f2"}
