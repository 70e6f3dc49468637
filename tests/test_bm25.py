"""BM25 by bounded walks against plain scoring of every document."""
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corrobora.operators import lexical


def plain(queries, docs, k, skip=False):
    """{query: [(doc, score)]} with every document scored."""
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    said = lambda t: (t or "").strip(" ").lower()
    toks = {d: words(t) for d, t in docs}
    avgdl = sum(map(len, toks.values())) / max(1, len(toks))
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in queries:
        scores = {}
        for d, t in docs:
            if skip and said(t) == said(text):
                continue
            s = 0.0
            for w in words(text):
                tf = toks[d].count(w)
                if tf:
                    s += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (
                        tf + 1.5 * (0.25 + 0.75 * len(toks[d]) / avgdl))
            if round(s, 6) > 0:
                scores[d] = round(s, 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        if best:
            out[q] = best
    return out


def some_texts(rng, n, words=300):
    weights = 1 / np.arange(1, words + 1)
    draw = lambda: " ".join(f"W{w}" for w in rng.choice(words, rng.integers(0, 40), p=weights / weights.sum()))
    return [draw() for _ in range(n)]


def search(spark, queries, docs, k, **more):
    q = spark.createDataFrame(queries, "query_id long, text string")
    d = spark.createDataFrame(docs, "doc_id string, text string")
    out = {}
    for r in lexical.bm25_search(q, d, k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6)


def test_many_blocks_and_query_groups_equal_plain_scoring(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 300)
    monkeypatch.setattr(lexical, "GROUP_TERMS", 60)
    rng = np.random.default_rng(3)
    texts = some_texts(rng, 120)
    docs = [(f"d{i:03}", t) for i, t in enumerate(texts + texts[:20] + [None, "", "W0"])]   # copies tie
    queries = list(enumerate(some_texts(rng, 25) + [None, "", "unheard of", "W0 W0 w0", texts[5]]))
    close(search(spark, queries, docs, 4), plain(queries, docs, 4))
    close(search(spark, queries, docs, 4, skip_own_text=True), plain(queries, docs, 4, skip=True))


def test_empty_sides_have_no_hits(spark):
    assert search(spark, [], [("a", "x")], 3) == {}
    assert search(spark, [(1, "x")], [], 3) == {}


def block(rng, n_docs, n_terms):
    rows = [(d, t, float(rng.uniform(0.2, 2.4))) for d in range(n_docs) for t in range(n_terms) if rng.random() < 1 / (1 + t)]
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "said": pa.array([0] * len(rows), pa.int64()),
                     "term": [f"t{r[1]}" for r in rows], "part": [r[2] for r in rows]})


def test_bounds_leave_postings_unread_and_lose_no_document():
    rng = np.random.default_rng(8)
    postings = block(rng, 3_000, 30)
    asks = pa.table({"query_id": pa.array([1] * 30, pa.int64()), "own": pa.array([1] * 30, pa.int64()),
                     "term": [f"t{t}" for t in range(30)], "w": [math.log(1 + (t + 1)) ** 3 for t in range(30)]})
    tally = []
    got = lexical.best_of_block(postings, asks, 5, False, tally)
    w = dict(zip(asks["term"].to_pylist(), asks["w"].to_pylist()))
    score = {}
    for r in postings.to_pylist():
        score[r["doc_id"]] = score.get(r["doc_id"], 0.0) + w[r["term"]] * r["part"]
    want = sorted(((round(s, 6), d) for d, s in score.items()), key=lambda x: (-x[0], x[1]))[:5]
    assert [(r["doc_id"], r["score"]) for r in got.to_pylist()] == [(d, s) for s, d in want]
    added, met = tally[0]
    assert met == len(postings) and added < met / 2


def test_null_ids_keep_their_place(spark):
    q = spark.createDataFrame([(None, "alpha"), (2, "alpha")], "query_id long, text string")
    d = spark.createDataFrame([(None, "alpha beta"), (7, "alpha beta"), (8, "gamma")], "doc_id long, text string")
    got = lexical.bm25_search(q, d, 5).select("query_id", "doc_id", "rank").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, None, 1), (None, 7, 2), (2, None, 1), (2, 7, 2)], key=str)
    assert lexical.bm25_search(q.withColumnRenamed("query_id", "q"), d, 1, query_id="q").filter(F.col("rank") > 1).count() == 0
