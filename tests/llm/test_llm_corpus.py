"""Operators on whole tables against brute force: decontamination, mixing, language model, neighbours, pages, pipeline."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corrobora.llm import decontaminate, language, mixing, nearest, pages, tokens
from corrobora.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ---------------------------------------------------------------- decontamination

def plain_tiles(doc, item, least):
    """Greedy string tiling by trying every pair of places."""
    md, mi, out = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = least - 1, []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not md[d + n] and not mi[i + n]:
                    n += 1
                if n > best:
                    best, found = n, [(d, i)]
                elif n == best and n >= least:
                    found.append((d, i))
        if best < least:
            return out
        for d, i in found:
            if not any(md[d:d + best]) and not any(mi[i:i + best]):
                md[d:d + best] = mi[i:i + best] = [True] * best
                out.append((d, i, best))


def test_tiling_equals_plain_tiling():
    rng = random.Random(3)
    for _ in range(300):
        words = "abcd"[:rng.randrange(2, 5)]
        doc, item = rng.choices(words, k=rng.randrange(25)), rng.choices(words, k=rng.randrange(1, 18))
        least = rng.randrange(2, 5)
        got, want = decontaminate.tiles(doc, item, least), plain_tiles(doc, item, least)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want), (doc, item)
        assert all(doc[d:d + n] == item[i:i + n] for d, i, n in got)


def plain_contaminated(docs, items, seed=5, coverage=0.5):
    out = []
    for d, t in docs:
        words = re.findall(r"\w+", (t or "").lower())
        grams = Counter(tuple(words[i:i + k]) for k in range(1, seed + 1) for i in range(len(words) - k + 1))
        for i, x in items:
            item = re.findall(r"\w+", (x or "").lower())
            k = min(seed, len(item))
            if item and any(tuple(item[j:j + k]) in grams for j in range(len(item) - k + 1)):
                got = plain_tiles(words, item, k)
                if sum(n for *_, n in got) >= coverage * len(item):
                    out.append((d, i, round(sum(n for *_, n in got) / len(item), 6), len(got)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["item_id"], round(r["coverage"], 6), r["n_tiles"]) for r in df.collect()), key=repr)


def test_decontamination_query_equals_plain_tiling(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = result(QUERIES["op1_decontamination"](spark, SF))
    assert got == plain_contaminated(docs, items) and len(got) >= 3


def test_reordered_passages_short_items_and_odd_rows(rows):
    rng = random.Random(8)
    item = [f"w{i}" for i in range(40)]
    turned = item[20:40] + ["filler"] * 5 + item[:20]
    cut = item[:8] + ["x"] + item[20:28]
    data = [(1, " ".join(turned)), (2, " ".join(item[:18])), (3, "The Short, one! stands here"), (4, None), (5, ""), (None, " ".join(item)),
            (6, " ".join(rng.choices("lorem ipsum dolor".split(), k=3_000) + item)), (7, " ".join(cut)), (1, " ".join(turned)), (8, "a a a a a a a a a b")]
    items = [(10, " ".join(item)), (11, "short one"), (12, None), (13, ""), (10, " ".join(item)), (14, "a a a a a a " + " ".join(f"z{i}" for i in range(6))), (None, "the short one")]
    df = rows("doc_id long, text string", *data).withColumns({c: F.lit(1) for c in ("item_id", "key", "words", "hashes", "h")})
    bench = rows("item_id long, text string", *items).withColumn("doc_id", F.lit(3))
    got = result(decontaminate.contaminated(df, bench))
    assert got == plain_contaminated(data, items)
    assert {g[0] for g in got if g[1] == 10} == {1, 6, None} and (1, 10, 1.0, 2) in got
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [2, 4, 5, 7]
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing

def plain_rates(members, steps, most=mixing.MOST):
    p, r = np.array([m[1] for m in members]), np.ones(len(members))
    for step in steps:
        r = np.clip(r - p @ np.array(step), 0, most)
    return r


def test_rates_meet_targets_and_equal_plain_descent(spark):
    rng = np.random.default_rng(1)
    members = [(int(rng.integers(1, 500)), rng.dirichlet([0.3, 0.2, 0.2]).tolist()) for _ in range(400)]
    df = spark.createDataFrame(members, "__tokens long, __p array<double>")
    have = sum(np.array(p) * t for t, p in members)
    weights = [0.9, 0.06, 0.04]
    steps = mixing.fit_rates(df, 3, weights, anchor=0, tolerance=1e-7, rounds=200)
    rate = [r["r"] for r in df.select(mixing.moved(F.lit(1.0), F.col("__p"), steps).alias("r")).collect()]
    goal = np.minimum(np.array(weights) * have[0] / 0.9, have)
    assert np.allclose(rate, plain_rates(members, steps), atol=1e-9) and min(rate) >= 0
    met = sum(r * t * np.array(p) for r, (t, p) in zip(rate, members))
    assert np.allclose(met, goal, rtol=0.02)


def test_a_rare_domain_reaches_its_share(spark):
    rng = np.random.default_rng(2)
    members = [(int(rng.integers(50, 500)), [0.995, 0.005] if i % 250 else [0.1, 0.9]) for i in range(2_000)]
    df = spark.createDataFrame(members, "__tokens long, __p array<double>")
    steps = mixing.fit_rates(df, 2, [0.95, 0.05], anchor=0)
    got = {r["domain"]: r for r in mixing.reached(df, ["clean", "rare"], [0.95, 0.05], 0, steps).collect()}
    have = sum(np.array(p) * t for t, p in members)
    assert have[1] < 0.02 * have.sum() and math.isclose(got["rare"]["target"], have[0] / 0.95 * 0.05)
    assert all(abs(r["expected"] - r["target"]) < 0.01 * r["target"] for r in got.values())


def test_mixing_query_keeps_clean_and_lowers_the_rest(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op5_mixing"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    share = lambda keep: np.mean([got[r["doc_id"]]["copies"] > 0 for r in labels if keep(r)])
    assert share(lambda r: r["quality"] == 1 and r["toxic"] == 0) > 0.97
    assert share(lambda r: r["toxic"] == 1) < 0.25 and share(lambda r: r["quality"] == 0) < 0.1
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.TARGETS) - 1) < 1e-9 for r in got.values())


def test_mixing_odd_rows(rows):
    data = [(1, "good words here"), (2, None), (3, ""), (3, "again"), (None, "no id"), (4, "w " * 40_000), (5, "bad bad bad"), (5, "bad bad bad")]
    df = rows("doc_id long, text string", *data).withColumns({c: F.lit("x") for c in ("h", "d", "domain", "rate", "copies")})
    labelled = rows("doc_id long, domain string", (1, "clean"), (5, "toxic"), (5, "toxic"), (2, None), (None, "clean"), (99, "low"))
    assert mixing.mixing_rates(df, labelled).count() == len(data)
    out = mixing.mixed(df, labelled)
    assert out.columns == df.columns and set(map(repr, out.collect())) <= set(map(repr, df.collect()))
    none = mixing.mixing_rates(df, labelled.limit(0)).collect()
    assert len(none) == len(data) and all(r["rate"] == 1 and r["copies"] == 1 for r in none)
    assert mixing.mixed(df, labelled.limit(0)).count() == len(data) and mixing.mixing_rates(df.limit(0), labelled).count() == 0


def test_copies_follow_rates(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 5 * 0.3).alias("rate"))
    got = {round(r["rate"], 1): r["m"] for r in df.groupBy("rate").agg(F.avg(mixing.copies(F.col("rate"), F.col("id"))).alias("m")).collect()}
    assert all(abs(m - r) < 0.03 for r, m in got.items())


# ---------------------------------------------------------------- language model

def plain_tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def held(doc_id, fold=5):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % fold == 1


def plain_base(data):
    counts = Counter(w for d, t in data if not held(d) for w in plain_tokens(t))
    n, v, out = sum(counts.values()), len(counts), []
    for d, t in data:
        words = plain_tokens(t)
        out.append((d, held(d), len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 6)))
    return sorted(out, key=repr)


def base_of(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()), key=repr)


def test_base_scores_and_a_better_model(spark, docs):
    df = QUERIES["op7_class_model"](spark, SF).cache()
    assert base_of(df) == plain_base(docs)
    got = [r for r in df.collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert all(abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-6 * r["perplexity"] for r in got)


def test_class_model_sums_to_one_and_small_blocks_change_nothing(spark, rows):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choices([f"w{j}" for j in range(30)], [1 / (j + 1) for j in range(30)], k=rng.randrange(30)))) for i in range(120)]
    df = rows("doc_id long, text string", *data)
    one = language.class_model_scores(df, frequent=40, classes=5).collect()
    many = language.class_model_scores(df.repartition(3), block=200, frequent=40, classes=5).collect()
    key = lambda rs: sorted((r["doc_id"], round(r["score"], 6), round(r["base_score"], 6)) for r in rs)
    assert key(one) == key(many)
    counts = Counter(w for d, t in data if not held(d) for w in plain_tokens(t))
    n = sum(counts.values())
    top = sorted(w.encode() for w, c in counts.items() if w and c >= n / 40)
    ready = language.with_counts(language.blocks_of(df, 5, 1), n / 40)
    number = {w: i for i, w in enumerate(top)}
    model = language.fit(language.transitions(ready, number), number, n, len(counts), 5)
    state = {w: 0 if w is None else 1 + number[w.encode()] if w.encode() in number else 1 + len(top) + c.bit_length() - 1 for w, c in counts.items()}
    for last in {0, *state.values()}:
        p = sum(10 ** (model.log_next[model.of[last], model.of[s]] + math.log10(counts[w]) - model.log_all[model.of[s]]) for w, s in state.items())
        assert abs(p + 10 ** model.log_next[model.of[last], model.of[-1]] - 1) < 1e-9


def test_exchange_finds_the_classes_of_a_made_up_language():
    rng = np.random.default_rng(0)
    of = np.arange(30) % 3                              # class 0 is followed by 1, 1 by 2, 2 by 0
    w = np.zeros((31, 31), np.int64)
    for a in range(30):
        for b in range(30):
            w[a + 1, b + 1] = rng.poisson(60 if of[b] == (of[a] + 1) % 3 else 2)
    got = language.exchange(w, np.arange(31) > 0, classes=3)[1:]
    assert len({(x, y) for x, y in zip(of, got)}) == 3


def test_gains_equal_the_change_of_the_likelihood():
    rng, n, c = np.random.default_rng(3), 12, 4
    w = rng.poisson(3, (n, n))
    of = np.r_[np.arange(8) % c, [4, 4, 5, 5]]

    def worth(of):
        g = np.zeros((6, 6))
        np.add.at(g, (of[:, None], of[None, :]), w)
        phi = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return phi(g) - phi(g.sum(0)) - phi(g.sum(1)), g
    member, others = np.eye(6)[of], w - np.diag(np.diag(w))
    got = language.gains(worth(of)[1], others @ member, others.T @ member, np.diag(w).astype(float), of, c)
    for s in range(n):
        moved = [worth(np.where(np.arange(n) == s, k, of))[0] for k in range(c)]
        assert np.allclose(got[s] - got[s, 0], np.array(moved) - moved[0])


def test_words_beyond_the_frequent_ones_join_classes_by_context(rows):
    """Frequent words a*, b*, c* follow each other in turn; rare words x* stand for an a*, y* for a b*, equally often."""
    rng, data = random.Random(6), []
    for i in range(1_200):
        words = []
        for _ in range(5):
            words += [f"a{rng.randrange(4)}" if rng.random() < 0.8 else f"x{rng.randrange(60)}",
                      f"b{rng.randrange(4)}" if rng.random() < 0.8 else f"y{rng.randrange(60)}", f"c{rng.randrange(4)}"]
        data.append((i, " ".join(words)))
    df = rows("doc_id long, text string", *data)
    kind = lambda rs: sum(r["score"] for r in rs if r["held_out"])
    banded = kind(language.class_model_scores(df, frequent=60, classes=3, some=1 << 40).collect())
    one = language.class_model_scores(df, frequent=60, classes=3).collect()
    tokens = sum(r["n_tokens"] for r in one if r["held_out"])
    assert kind(one) - banded > 0.05 * tokens           # log10, a token
    many = language.class_model_scores(df.repartition(3), block=3_000, frequent=60, classes=3).collect()
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in one) == sorted((r["doc_id"], round(r["score"], 6)) for r in many)
    flat = rows("doc_id long, text string", *[(i, " ".join(f"{'pqr'[j % 3]}{rng.randrange(400)}" for j in range(60))) for i in range(600)])
    got = language.class_model_scores(flat, frequent=50, classes=3).collect()       # no word makes up 1 / 50
    assert kind(got) > sum(r["base_score"] for r in got if r["held_out"]) + 0.2 * sum(r["n_tokens"] for r in got if r["held_out"])


def test_language_model_odd_rows(rows):
    data = [(1, "A b a b"), (2, None), (3, ""), (3, " \t\n\x0b "), (None, "a"), (None, None), (6, "x " * 50_000), (7, "Ünï cödé word \x1f sep")]
    df = rows("doc_id long, text string", *data).withColumns({c: F.lit(0) for c in ("held", "block", "words", "score")})
    assert base_of(language.class_model_scores(df)) == plain_base(data)
    assert language.class_model_scores(df.limit(0)).count() == 0
    only_held = [(i, "a b") for i in range(40) if held(i)]
    got = language.class_model_scores(rows("doc_id long, text string", *only_held)).collect()
    assert base_of(language.class_model_scores(rows("doc_id long, text string", *only_held))) == plain_base(only_held)
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in got)


# ---------------------------------------------------------------- neighbours

def plain_nearest(vectors, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(v, float) - np.array(x, float)) ** 2).sum())), i) for i, x in vectors if i != q and len(x) == len(v))
        out.setdefault(q, []).append(d[:k])
    return out


def test_recall_of_the_query(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        want = plain_nearest(vectors, [v for v in vectors if v[0] % 100 == 0], 10)
        got = {}
        for r in QUERIES["op8_nearest"](spark, sf).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        hits = [len({i for _, i in got[q]} & {i for _, i in w[0]}) / len(w[0]) for q, w in want.items()]
        assert np.mean(hits) >= 0.9 and set(got) == set(want)
        by_id = dict(vectors)
        for q, found in got.items():
            assert found == sorted(found) and len(found) == 10
            assert all(abs(s - math.dist(by_id[q], by_id[i])) < 1e-9 for s, i in found)


def test_neighbours_of_copies_odd_vectors_and_few_rows(rows):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, [inf, 1.0]),
            (10, []), (None, [1.0, 1.0]), (11, [1.0, 2.0, 3.0]), (200, [1.0, 1.0, 1.0]), (300, [0.0]), (0, [1.0, 0.0]), (12, [0.5, 0.5])]
    df = rows("vec_id long, embedding array<float>", *data).withColumns({c: F.lit(1) for c in ("id", "v", "dim", "block", "n", "rank")})
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in nearest.nearest(df, df["vec_id"] % 100 == 0, 3).orderBy("query_id", "rank").collect()]
    half, root = round(math.sqrt(0.5), 6), round(math.sqrt(2), 6)
    assert got == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 12, half), (100, 1, 12, half), (100, 2, 0, root), (100, 3, 0, root), (200, 1, 11, round(math.sqrt(5), 6))]
    assert nearest.nearest(df.limit(0), F.lit(True)).count() == 0
    many = rows("vec_id long, embedding array<float>", *[(i, [1.0, 2.0]) for i in range(500)])
    same = nearest.nearest(many, many["vec_id"] == 7, 10, block=64).orderBy("rank").collect()
    assert [r["vec_id"] for r in same] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10] and all(r["score"] == 0 for r in same)


# ---------------------------------------------------------------- pages

def test_page_text_of_articles(spark):
    import html as H
    got = {r["page_id"]: r for r in QUERIES["op10_page_text"](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in parts if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var a="</p><p>no";</script></head><body class=home>
<header class="site-header"><div>no logo</div><ul class=menu><li><a href=/>no home</a><li><a href=/a>no about</a></ul></header>
<div id="cookie-notice"><p>no cookies here</p></div><div class="layout"><div class="{main}"><h1>Title &amp; more</h1>
<p>First&nbsp;paragraph   of the
text, long enough to be <b>an article's</b> own.<p>Second one with a <a href=x>link</a> in it, going on for a while.
<ul><li>item one<li>item two</ul><div class="ad"><p>no buy this now</p></div><style>p{{}}</style><p>Third &lt;kept&gt; line<br>and its end.</p>
<section id="comments"><p>no I like this page very much and say so at length</p></section></div>
<aside class="sidebar"><p>no related things</p></aside></div><form><p>no subscribe</p><input></form><footer><p>no &copy; 2020</footer></body></html>"""


def test_page_text_without_an_article_element():
    model = pages.fit(list(pages.written_pages()))
    want = ("Title & more\nFirst paragraph of the text, long enough to be an article's own.\nSecond one with a link in it, going on for a while.\n"
            "item one\nitem two\nThird <kept> line and its end.")
    for main in ("post-content", "entry", "article-body"):
        assert pages.main_text(PAGE.format(main=main), model) == want


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    model = pages.Model(rng.normal(size=pages.FEATURES), rng.normal(size=(3, 2, 2)))
    for _ in range(20):
        n = int(rng.integers(1, 8))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        kinds, feats = rng.integers(0, 3, n).tolist(), [rng.integers(0, pages.FEATURES, 3).tolist() for _ in range(n)]
        total, one = 0.0, np.zeros(n)
        for bits in np.ndindex(*[2] * n):
            s = sum(model.own[f].sum() for f, b in zip(feats, bits) if b) + sum(model.pair[kinds[i], bits[parent[i]], bits[i]] for i in range(1, n))
            total += math.exp(s)
            one += math.exp(s) * np.array(bits)
        assert np.allclose(model.marginals(parent, kinds, feats)[0], one / total)


def test_pages_odd_rows(rows):
    data = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "</div></p>" * 50 + "<b>"), (5, "u", "<div>" * 3_000 + "deep"), (6, "u", "<!-- open <p>"),
            (7, "u", "<article><p>" + "word " * 100_000 + "</article>"), (7, "u", "<article><p>twice</article>"), (8, "u", '<a href="<p>'), (9, "u", "1 < 2 & 3 &amp; <")]
    df = rows("page_id long, url string, html string", *data).withColumns({c: F.lit(1) for c in ("text", "n_chars", "i")})
    got = pages.extract(df).collect()
    assert len(got) == len(data) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] in (1, 2, 7)}
    assert by[1] == by[2] == "" and {len(r["text"]) for r in got if r["page_id"] == 7} == {len("word " * 100_000) - 1, 5}
    assert pages.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "token_output":
            rows = out.orderBy("start").collect()
            texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
            enc = tokens.encoder(tokenizer_path()).of_text
            want = [(d, [*enc.encode(t, add_special_tokens=False).ids, 0]) for d, t in texts]
            assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want]
            break
        assert out.columns == docs.columns and out.schema == docs.schema
        before = {r["doc_id"] for r in docs.collect()}
        docs = corpus_pipeline.keep(out, f"t-{name}")
        seen[name] = (before, {r["doc_id"] for r in docs.collect()})
        assert seen[name][1] < before or name == "mixing"
    good = [d for d, r in labels.items() if r["quality"] == 1]
    assert np.mean([d in seen["quality"][1] for d in good]) > 0.97
    assert np.mean([d in seen["quality"][1] for d, r in labels.items() if r["quality"] == 0]) < 0.2
    assert QUERIES["pipeline"](spark, sf).count() > 0
