"""Mixing sources to target weights by soft membership. DataFrame operations only.

A classifier trained on a labelled table predicts, for every document, how likely it belongs to each domain: tokens whose
share surely differs between a domain and the rest are found, and logistic weights are fitted by Newton's steps to how
many of them a text has. Projected-gradient
least squares then fits a rate r >= 0 for every document so that the expected token totals of the domains,
``sum(r * tokens * posterior)``, meet their targets. Steps are scaled by 1 / tokens, so a document's rate follows from
its posteriors alone and a step needs only one residual for each domain; all sums run over the whole table.

A rate says how often a document enters the mixture: its whole part, and one more with the chance of the rest, drawn by
a hash of the id. Rates within ``SLACK`` of a whole number count as that number.

Defined cases: a null or empty text has no tokens, some posteriors and adds nothing to any
total; null labels train nothing; a domain without labelled rows or tokens keeps its documents' rates; rows with equal
ids are drawn alike; without any labelled row every document has the same posteriors and rate 1.
"""
from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.common import keep, renamed

BUCKETS = 8_192         # places of the token table
SAMPLE = 20_000         # labelled rows that are learned from, at most
SURE = 6.0              # root of the likelihood ratio by which a token's share must exceed that of the rest
SLACK = 0.05
ROUNDS = 60
PATIENCE = 6            # steps without a gain before the best is taken
MOST = math.inf         # rates have no upper end: the targets' total bounds the tokens of the mixture
_BREAK = r"[\x20\x09-\x0D]+|(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}\x20\x09-\x0D])"


def tokens(text: Column) -> Column:
    """Words, and what is stuck to their ends as a token of its own."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK, -1), lambda w: w != "")


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def constant(values, kind: str) -> Column:
    """A list as one literal."""
    return F.from_json(F.lit(json.dumps(values)), kind)


# ---------------------------------------------------------------- posteriors

def place(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS).cast("long")).cast("int")


def sure_tokens(rows: DataFrame, domains: list) -> dict[str, list]:
    """rows: d, h (hashes of the different tokens). For each of BUCKETS places the surest token that falls there (its hash),
    the domain it speaks for, and how strongly: the log ratio of its share of the domain's tokens to that of the rest."""
    total = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.sum(F.size("h")).alias("n")).collect()}
    out = {"keys": [0] * BUCKETS, "speaks": [-1] * BUCKETS, "strength": [0.0] * BUCKETS}
    seen = (rows.select("d", F.explode("h").alias("h")).groupBy("h")
            .agg(*[F.count_if(F.col("d") == d).cast("double").alias(f"n{i}") for i, d in enumerate(domains)]))
    all_n, each, everything = sum((F.col(f"n{i}") for i in range(1, len(domains))), F.col("n0")), [], float(sum(total.values()) or 1)
    for i, d in enumerate(domains):
        own, rest, size = F.col(f"n{i}"), all_n - F.col(f"n{i}"), float(total.get(d) or 1)
        others = max(1.0, everything - size)
        gain = lambda n, part: F.when(n > 0, n * F.log(n * everything / (all_n * part))).otherwise(0.0)
        strength = F.log((own + 0.5) / size) - F.log((rest + 0.5) / others)
        g = F.when(own * others > rest * size, F.sqrt(F.greatest(F.lit(0.0), 2 * (gain(own, size) + gain(rest, others))))).otherwise(0.0)
        each.append(F.struct(g.alias("g"), F.lit(i).alias("i"), strength.alias("w")))
    best = F.array_max(F.array(*each))
    top = (seen.filter(all_n >= 4).select("h", place(F.col("h")).alias("b"), best.alias("x")).filter(F.col("x.g") > SURE)
           .groupBy("b").agg(F.max(F.struct("x.g", "h", "x.i", "x.w")).alias("x")))
    for r in top.collect():                                           # at most BUCKETS rows
        out["keys"][r["b"]], out["speaks"][r["b"]], out["strength"][r["b"]] = r["x"]["h"], r["x"]["i"], round(r["x"]["w"], 4)
    return out


def described(docs: DataFrame, sure: dict[str, list], n_domains: int, text_col: str = "text") -> DataFrame:
    """docs with __tokens (their number) and __x (features: how long, how varied, and how strongly the strongest of the
    different tokens, and all of them for their number, speak for each domain)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    words = docs.select(*own, hashes(tokens(docs[text_col])).alias("__h"))
    known, said, strength = constant(sure["keys"], "array<bigint>"), constant(sure["speaks"], "array<int>"), constant(sure["strength"], "array<double>")
    heard = F.transform(F.array_distinct(F.filter("__h", lambda h: F.get(known, place(h)) == h)),
                        lambda h: F.struct(F.get(said, place(h)).alias("i"), F.get(strength, place(h)).alias("w")))
    out = words.select(*own, F.size("__h").cast("long").alias("__tokens"), F.size(F.array_distinct("__h")).cast("double").alias("__n"), heard.alias("__s"))
    said_for = lambda i: F.transform(F.filter("__s", lambda s: s["i"] == i), lambda s: s["w"])
    each = []
    for i in range(n_domains):
        w = said_for(i)
        each += [F.coalesce(F.array_max(w), F.lit(0.0)), F.least(F.lit(5.0), 10 * F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / F.greatest("__n", F.lit(1.0)))]
    return out.select(*own, "__tokens", F.array(F.lit(1.0), F.log1p("__n"), F.col("__n") / F.greatest("__tokens", F.lit(1)), *each).alias("__x"))


def solve(a: list[list[float]], y: list[float]) -> list[float]:
    """Gaussian elimination with pivoting."""
    rows = [[*r, v] for r, v in zip(a, y)]
    for i in range(len(rows)):
        rows[i:] = sorted(rows[i:], key=lambda r: -abs(r[i]))
        for r in rows[i + 1:]:
            f = r[i] / rows[i][i]
            r[i:] = [x - f * z for x, z in zip(r[i:], rows[i][i:])]
    out = [0.0] * len(rows)
    for i in reversed(range(len(rows))):
        out[i] = (rows[i][-1] - sum(rows[i][j] * out[j] for j in range(i + 1, len(rows)))) / rows[i][i]
    return out


def dot(x: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, constant(weights, "array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)


def logistic(rows: DataFrame, domains: list, n_features: int, rounds: int = 12, ridge: float = 0.3) -> list[list[float]]:
    """One-against-rest logistic weights by Newton's steps; each step is one aggregate over rows (d, __x)."""
    betas, f = [[0.0] * n_features for _ in domains], range(n_features)
    sums = [f"sum((y{i} - p{i}) * x[{j}]) AS g{i}_{j}" for i in range(len(domains)) for j in f]
    sums += [f"sum(p{i} * (1 - p{i}) * x[{j}] * x[{k}]) AS h{i}_{j}_{k}" for i in range(len(domains)) for j in f for k in f if j <= k]
    for _ in range(rounds):
        wide = rows.select(F.col("__x").alias("x"), *[(1 / (1 + F.exp(-dot(F.col("__x"), b)))).alias(f"p{i}") for i, b in enumerate(betas)],
                           *[F.when(F.col("d") == d, 1.0).otherwise(0.0).alias(f"y{i}") for i, d in enumerate(domains)])
        got = wide.selectExpr(*sums).first()
        moved_by = 0.0
        for i in range(len(domains)):
            grad = [(got[f"g{i}_{j}"] or 0.0) - ridge * betas[i][j] for j in f]
            hess = [[(got[f"h{i}_{min(j, k)}_{max(j, k)}"] or 0.0) + ridge * (j == k) for k in f] for j in f]
            step = solve(hess, grad)
            betas[i] = [b + s for b, s in zip(betas[i], step)]
            moved_by = max(moved_by, *map(abs, step))
        if moved_by < 1e-3:
            break
    return betas


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """labelled: doc_id, domain. The model: sure tokens, and logistic weights over what they say about a text."""
    known = labelled.filter("doc_id is not null and domain is not null").select(F.col("doc_id").cast("long").alias("__id"), F.col("domain").alias("__domain")).dropDuplicates(["__id"])
    chosen = F.broadcast(known.orderBy(F.xxhash64("__id", F.lit(3)), "__id").limit(sample))
    own = keep(docs.join(chosen, docs[id_col] == F.col("__id")).select(F.col("__domain").alias("d"), docs[text_col].alias("text")), "labelled")
    domains = sorted(r["d"] for r in own.select("d").distinct().collect())
    if not domains:
        return {"domains": [], "sure": {}, "betas": []}
    sure = sure_tokens(own.select("d", F.array_distinct(hashes(tokens(F.col("text")))).alias("h")), domains)
    rows = keep(described(own, sure, len(domains)).select("d", "__x"), "labelled-features")
    return {"domains": domains, "sure": sure, "betas": logistic(rows, domains, 3 + 2 * len(domains))}


def posteriors(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with __tokens (their number) and __p (array of posteriors, in the order of the model's domains)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    if not model["domains"]:
        return docs.select(*own, F.size(tokens(docs[text_col])).cast("long").alias("__tokens"), F.array().cast("array<double>").alias("__p"))
    rows = described(docs, model["sure"], len(model["domains"]), text_col)
    each = F.array(*[1 / (1 + F.exp(-dot(F.col("__x"), b))) for b in model["betas"]])
    out = rows.select(*own, "__tokens", each.alias("__e"))
    whole = F.greatest(F.aggregate("__e", F.lit(0.0), lambda a, y: a + y), F.lit(1e-30))
    return out.select(*own, "__tokens", F.transform("__e", lambda x: x / whole).alias("__p"))


# ---------------------------------------------------------------- rates

def moved(rate: Column, p: Column, steps: list[list[float]]) -> Column:
    """rate after projected gradient steps, each given by one number for each domain."""
    if not steps:
        return rate
    return F.aggregate(constant(steps, "array<array<double>>"), rate, lambda r, g: F.greatest(
        F.lit(0.0), r - F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def goals(have: list[float], weights: list[float], anchor: int | None) -> list[float]:
    """Expected tokens that each domain shall have. A domain without any has no documents to repeat: the others' shares
    stand to each other as their weights."""
    w = [x if h > 0 else 0.0 for x, h in zip(weights, have)]
    share = [x / (sum(w) or 1.0) for x in w]
    total = sum(have) if anchor is None or not share[anchor] else have[anchor] / share[anchor]
    return [x * total for x in share]


def fit_rates(members: DataFrame, n_domains: int, weights: list[float], anchor: int | None = None, rounds: int = ROUNDS,
              tolerance: float = 1e-4) -> list[list[float]]:
    """Gradient steps from rate 1. members: __tokens, __p. weights: the domains' target shares; the total is what lets
    the anchor domain keep its expected tokens (without one: the tokens there are). A domain of few tokens is repeated until
    it has its share; ``reached`` tells targets and what the rates come to."""
    k = range(n_domains)
    if not n_domains:
        return []
    t, p = F.col("__tokens").cast("double"), [F.get("__p", i) for i in range(n_domains)]
    sums = members.agg(*[F.sum(t * p[i]).alias(f"s{i}") for i in k]).first()
    have = [sums[f"s{i}"] or 0.0 for i in k]
    goal = goals(have, weights, anchor)
    rows, pending, steps = members.select("__tokens", "__p", F.lit(1.0).alias("__r")), [], []
    best, kept, last, damp, inside = math.inf, 0, math.inf, 1.0, F.col("__r") > 0
    for _ in range(rounds):
        rate = moved(F.col("__r"), F.col("__p"), pending)
        now = rows.select(rate.alias("__r"), "__tokens", "__p").agg(
            *[F.sum(F.col("__r") * t * p[i]).alias(f"s{i}") for i in k],
            *[F.sum(F.when(inside, t * p[i] * p[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i in k for j in k if i <= j]).first()
        off = [(now[f"s{i}"] or 0.0) - goal[i] for i in k]
        # residuals are weighed by the inverse Gram matrix of the documents whose rates are free to move, so the squared error
        # is as steep in every direction; a step that made it worse is followed by shorter ones
        gram = [[now[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in k] for i in k]
        ease = 1e-6 * max([have[i] for i in k] + [1e-9])
        error = math.sqrt(sum((off[i] / max(have[i], goal[i], 1.0)) ** 2 for i in k))
        if error < 0.99 * best:
            best, kept = error, len(steps)
        if error < tolerance or len(steps) - kept >= PATIENCE:
            break                                                     # met, or as near as rates can come
        damp = damp / 2 if error >= last else min(1.0, damp * 1.5)
        last = error
        step = [damp * x for x in solve([[g + ease * (i == j) for j, g in enumerate(row)] for i, row in enumerate(gram)], off)]
        steps.append(step)
        pending.append(step)
        if len(pending) == 12:
            rows, pending = keep(rows.select("__tokens", "__p", rate.alias("__r")), "rates"), []
    return steps[:kept]


def reached(members: DataFrame, domains: list, weights: list[float], anchor: int | None, steps: list[list[float]]) -> DataFrame:
    """domain, its expected tokens, target, the expected tokens at the fitted rates: one row for each domain."""
    if not domains:
        return members.sparkSession.createDataFrame([], "domain string, have double, target double, expected double")
    t, rate = F.col("__tokens").cast("double"), moved(F.lit(1.0), F.col("__p"), steps)
    got = members.select("__tokens", "__p", rate.alias("__r")).agg(
        *[F.sum(t * F.get("__p", i)).alias(f"s{i}") for i in range(len(domains))],
        *[F.sum(F.col("__r") * t * F.get("__p", i)).alias(f"r{i}") for i in range(len(domains))]).first()
    have = [got[f"s{i}"] or 0.0 for i in range(len(domains))]
    return members.sparkSession.createDataFrame(
        [(d, have[i], g, got[f"r{i}"] or 0.0) for i, (d, g) in enumerate(zip(domains, goals(have, weights, anchor)))],
        "domain string, have double, target double, expected double")


def copies(rate: Column, key: Column) -> Column:
    near = F.round(rate)
    draw = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 20).cast("long")) / F.lit(float(1 << 20))
    return F.when(F.abs(rate - near) <= SLACK, near).otherwise(F.floor(rate + draw)).cast("int")


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain of a table of quality and toxicity labels."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


#: target shares of tokens; the clean domain keeps its expected tokens
TARGETS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}
ANCHOR = "clean"


def _fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], anchor: str | None):
    docs = docs.select("doc_id", "text")
    model = train(docs, labelled)
    domains = model["domains"]
    members = keep(posteriors(docs, model).select("doc_id", "__tokens", "__p"), "posteriors")
    steps = fit_rates(members, len(domains), [targets.get(d, 0.0) for d in domains], domains.index(anchor) if anchor in domains else None)
    return model, members, steps


def _rate(steps: list[list[float]]) -> Column:
    """A document without tokens adds to no domain, so it isn't repeated."""
    rate = moved(F.lit(1.0), F.col("__p"), steps)
    return F.when(F.col("__tokens") == 0, F.least(F.lit(1.0), rate)).otherwise(rate)


def mixing_report(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, anchor: str | None = ANCHOR) -> DataFrame:
    """domain, have, target, expected (tokens) of the mixture."""
    model, members, steps = _fitted(docs, labelled, targets, anchor)
    domains = model["domains"]
    return reached(members, domains, [targets.get(d, 0.0) for d in domains], domains.index(anchor) if anchor in domains else None, steps)


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, anchor: str | None = ANCHOR) -> DataFrame:
    """doc_id, n_tokens, a posterior for each target domain, rate, copies: one row for every row of docs."""
    model, members, steps = _fitted(docs, labelled, targets, anchor)
    at = {d: i for i, d in enumerate(model["domains"])}
    out = members.withColumn("rate", _rate(steps))
    return out.select("doc_id", F.col("__tokens").alias("n_tokens"),
                      *[(F.get("__p", at[d]) if d in at else F.lit(None).cast("double")).alias(f"p_{d}") for d in sorted(targets)],
                      "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, anchor: str | None = ANCHOR) -> DataFrame:
    """The documents of the mixture, each as often as its rate says."""
    docs, named = renamed(docs, "doc_id", "text")
    model, _, steps = _fitted(docs, labelled, targets, anchor)
    cols = docs.columns
    own = posteriors(docs, model).withColumn("__n", copies(_rate(steps), F.col("doc_id")))
    return named(own.select(*cols, F.explode(F.array_repeat(F.lit(1), F.col("__n"))).alias("__copy")).select(*cols))
