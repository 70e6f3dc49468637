"""SimHash near-duplicates, probed by a generalised pigeonhole.

A fingerprint has a bit where more than half of the shingle hashes have it. To find all fingerprints within
``tau`` bits of each other, correlated bits are grouped into partitions. If the partitions' own thresholds t_i
satisfy ``sum(t_i + 1) = tau + 1``, two fingerprints within tau bits agree within t_i in at least one partition i
(t_i = -1: the partition isn't probed). The t_i are allotted by dynamic programming on estimated candidate counts.
Candidates meet in buckets (partition, value), are verified on all 64 bits, and leave each bucket as a spanning
forest, so a bucket returns fewer links than it has members. Very large buckets are cut into tiles.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a null id keeps its fingerprint
and takes the component of equal fingerprints (null if none has an id); repeated rows and equal ids stay as rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corrobora.llm.common import keep, renamed, slices, texts_of, utf8
from corrobora.operators.graph import components

BITS = 64
SEED = 42
TILE = 16_384           # rows of a bucket that are compared in one task
ROW_COST = 400          # a row in a bucket costs as much as so many comparisons
HISTOGRAM_BITS = 16     # widest value whose counts are gathered: at most 65,536 rows for each group of bits


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()          # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D, nothing else
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n - k + 1].tolist(), ends[k - 1:].tolist())),
                       np.uint64, n - k + 1)


def fingerprint(text: bytes, k: int = 4) -> int:
    h = shingle_hashes(text, k)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at:at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), text_hash (what xxhash64 of the text gives)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = utf8(b.column(1))
            fps = np.fromiter((fingerprint(t, k) for t in texts), np.uint64, b.num_rows)
            own = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array(own.view(np.int64))], names=["doc_id", "fp", "text_hash"])
    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, text_hash long")


# ---------------------------------------------------------------- partitions and thresholds

def bit_correlations(fps: DataFrame) -> np.ndarray:
    """|correlation| of every two bits, from counts over all fingerprints (64 x 64 sums)."""
    def run(batches):
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in slices(batches, 8_192):
            bits = unpack(np.asarray(b.column(0)).view(np.uint64)).astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
            n += b.num_rows
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i, -1].astype(np.int32)), pa.array(np.r_[j, -1].astype(np.int32)),
             pa.array(np.r_[both[i, j], n].astype(np.int64))], names=["i", "j", "n"])
    both, n = np.zeros((BITS, BITS)), 0
    for r in fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    if not n:
        return np.eye(BITS)
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))


def unpack(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of (nearly) equal size; a group grows by the bit most correlated with it."""
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = len(left) // (m - g)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            nxt = max(sorted(left), key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.discard(nxt)
        groups.append(sorted(group))
    return groups


def near_shares(counts: dict[int, int], width: int, most: int) -> np.ndarray:
    """Share of all ordered pairs whose values differ in exactly 0..most bits, from the values' counts."""
    c = np.zeros(1 << width)
    for v, n in counts.items():
        c[v] += n
    total = max(1.0, c.sum()) ** 2
    by_weight = walsh(walsh(c) ** 2) / len(c)       # pairs by xor
    weight = np.bitwise_count(np.arange(len(c), dtype=np.uint32))
    return np.array([by_weight[weight == d].sum() for d in range(most + 1)]) / total


def walsh(a: np.ndarray) -> np.ndarray:
    a, h = a.astype(np.float64).copy(), 1
    while h < len(a):
        a = a.reshape(-1, 2, h)
        a = np.stack([a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]], axis=1).reshape(-1)
        h *= 2
    return a


def allot(costs: list[list[float]], tau: int) -> list[int]:
    """costs[i][t + 1]: of threshold t in partition i, from -1. The cheapest t_i with sum(t_i + 1) = tau + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t1, more in enumerate(row):
                if used + t1 <= tau + 1 and ((new := cost + more) < step.get(used + t1, (math.inf, []))[0]):
                    step[used + t1] = (new, [*ts, t1 - 1])
        best = step
    return best[tau + 1][1]


def plan(fps: DataFrame, n: int, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition that is probed. The number of partitions is the cheapest of those whose
    values are wide enough to tell n fingerprints apart."""
    corr = bit_correlations(fps)
    best = (math.inf, [])
    for m in range(2, tau + 2):
        if BITS / m < min(32.0, math.log2(n + 1) - 2) and m > 2:
            continue
        groups = group_bits(corr, m)
        chunks = [(g, c) for g, bits in enumerate(groups) for c in range(-(-len(bits) // HISTOGRAM_BITS))]
        parts = [groups[g][c * HISTOGRAM_BITS:(c + 1) * HISTOGRAM_BITS] for g, c in chunks]
        hist = histograms(fps, parts)
        costs, most = [], tau
        for g, bits in enumerate(groups):
            share = np.array([1.0] + [0.0] * most)
            for at, (own, _) in enumerate(chunks):
                if own == g:
                    share = np.convolve(share, near_shares(hist[at], len(parts[at]), most))[:most + 1]
            keys = [sum(math.comb(len(bits), d) for d in range(t + 1)) / (1 if t == 0 else 2) for t in range(most + 1)]
            costs.append([0.0] + [share[:t + 1].sum() * n * n / 2 + ROW_COST * n * keys[t] for t in range(most + 1)])
        ts = allot(costs, tau)
        total = sum(c[t + 1] for c, t in zip(costs, ts))
        if total < best[0]:
            best = (total, [(bits, t) for bits, t in zip(groups, ts) if t >= 0])
    return best[1]


def value(fp, bits: list[int]):
    """The named bits of fp, packed."""
    out = F.lit(0).cast("long")
    for at, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), at))
    return out


def histograms(fps: DataFrame, parts: list[list[int]]) -> list[dict[int, int]]:
    """Counts of the values of each group of bits, at most 2^16 for each group."""
    out: list[dict[int, int]] = [{} for _ in parts]
    rows = fps.select(F.posexplode(F.array(*[value(F.col("fp"), p) for p in parts])).alias("part", "v"))
    got = rows.groupBy("part", "v").count().toArrow()
    for p, v, n in zip(*(got.column(c).to_pylist() for c in ("part", "v", "count"))):
        out[p][v] = n
    return out


# ---------------------------------------------------------------- probe and verify

def masks(width: int, t: int) -> list[int]:
    from itertools import combinations
    return [sum(1 << b for b in c) for d in range(1, t + 1) for c in combinations(range(width), d)]


def forest(fps: np.ndarray, tau: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links (tau or fewer differing bits) among fps: each node is compared with those
    not yet reached, so a tight group costs little more than its size."""
    child, parent = [], []
    left = np.arange(len(fps))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            part, front = front[:64], front[64:]
            near = np.bitwise_count(fps[part][:, None] ^ fps[left][None, :]) <= tau
            hit = near.any(axis=0)
            if hit.any():
                new = left[hit]
                child.append(new)
                parent.append(part[near.argmax(axis=0)[hit]])
                left, front = left[~hit], np.concatenate([front, new])
    return child, parent


def links_in_buckets(tau: int):
    """Sorted rows (part, key, t1, t2, fp, rep) -> links (a, b) of reps."""
    def found(keys, fps, reps):
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) > 1 else np.empty(0, np.int64)
        start, end = np.r_[0, cuts], np.r_[cuts, len(fps)]
        size = end - start
        a, b = [], []
        small = np.repeat(size, size)
        end_of = np.repeat(end, size)
        at = np.arange(len(fps))
        for step in range(1, 32):                         # small buckets, all at once
            i = at[(small <= 32) & (at + step < end_of)]
            if not len(i):
                break
            i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= tau]
            a.append(reps[i])
            b.append(reps[i + step])
        for s, e in zip(start[size > 32], end[size > 32]):
            child, parent = forest(fps[s:e], tau)
            a += [reps[s:e][x] for x in child]
            b += [reps[s:e][x] for x in parent]
        a, b = np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])
        u = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["a", "b"])

    def run(batches):
        held, last = [], None
        for b in batches:
            cols = [np.asarray(b.column(c)) for c in range(b.num_columns)]
            keys = np.stack([c.astype(np.int64) for c in cols[:4]], 1)
            if not len(keys):
                continue
            held.append((keys, cols[4].view(np.uint64), cols[5]))
            if len(keys) and last is not None and (keys[-1] == last).all():
                continue                                  # still the same bucket
            keys, fps, reps = (np.concatenate(x) for x in zip(*held))
            last = keys[-1]
            open_at = np.flatnonzero((keys != last).any(axis=1))
            cut = open_at[-1] + 1 if len(open_at) else 0
            if cut:
                yield found(keys[:cut], fps[:cut], reps[:cut])
            held = [(keys[cut:], fps[cut:], reps[cut:])]
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held)))
    return run


def _buckets(part: int, bits: list[int], t: int):
    """(part, key) of a fingerprint: its own value, and the greater ones within t bits (the smaller ones look for it)."""
    v = value(F.col("fp"), bits)
    own = F.array(v)
    if t:
        near = F.transform(F.array(*[F.lit(x).cast("long") for x in masks(len(bits), t)]), lambda m: v.bitwiseXOR(m))
        own = F.concat(own, F.filter(near, lambda x: x > v))
    return F.transform(own, lambda x: F.struct(F.lit(part).alias("part"), x.alias("key")))


def near_links(reps: DataFrame, tau: int = 4, tile: int = TILE, probed: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints within tau bits. ``reps``: fp (distinct), rep (its smallest id);
    ``probed``: partitions and their thresholds, planned if not given."""
    if probed is None:
        n = reps.count()
        probed = plan(reps, n, tau) if n > 1 else []
    keys = [_buckets(part, bits, t) for part, (bits, t) in enumerate(probed)]
    if not keys:
        return reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    rows = reps.select("fp", "rep", F.inline(F.concat(*keys)))
    large = (rows.groupBy("part", "key").agg(F.count("*").alias("size")).filter(F.col("size") > tile)
             .withColumnRenamed("part", "p").withColumnRenamed("key", "k"))
    large = keep(large, "buckets")
    chunks = F.ceil(F.coalesce("size", F.lit(1)) / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    tiled = (rows.join(large, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")), "left")
             .select("part", "key", "fp", "rep", mine.alias("mine"), other.alias("other")))
    dealt = tiled.select("part", "key", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "fp", "rep")
    return (dealt.repartition("part", "key", "t1", "t2").sortWithinPartitions("part", "key", "t1", "t2", "rep")
            .mapInArrow(links_in_buckets(tau), "a long, b long"))


def near_duplicates(docs: DataFrame, tau: int = 4, k: int = 4, id_col: str = "doc_id", text_col: str = "text",
                    tile: int = TILE) -> DataFrame:
    """doc_id, fp, text_hash, component_id: one row for every row of docs."""
    fps = keep(fingerprints(docs, k, id_col, text_col), "fingerprints")
    reps = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "reps")
    links = keep(near_links(reps, tau, tile), "links")
    nodes = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).distinct()
    linked = components(links, nodes, "a", "b", "rep")
    home = reps.join(linked, "rep", "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(home, F.col("fp") == F.col("of"), "left").select("doc_id", "fp", "text_hash", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents whose id names their component: one of each group of near copies. Where an id stands in several
    rows, one of those in the component stays; rows without an id all stay, as nothing names them."""
    docs, named = renamed(docs, "doc_id", "text")
    found = keep(near_duplicates(docs, **how), "components")
    names = F.col("doc_id") == F.col("component_id")
    kept = keep(found.groupBy(F.col("doc_id").alias("__id")).agg(F.count_if(names).alias("__named"), F.count("*").alias("__rows"), F.min(F.when(names, F.col("text_hash"))).alias("__hash"))
                .filter("__named > 0"), "kept")
    # kept ids grow with the documents: both sides are shuffled at every size, never broadcast
    cols, own = docs.columns, docs.join(kept.hint("merge"), docs["doc_id"] == kept["__id"])
    out = own.filter("__rows = 1").select(*[docs[c] for c in cols])
    if not kept.filter("__rows > 1").isEmpty():
        text = F.coalesce(docs["text"], F.lit(""))
        same = own.filter((F.col("__rows") > 1) & (F.xxhash64(text) == F.col("__hash"))).groupBy("__id").agg(
            F.min_by(F.struct(*[docs[c] for c in cols]), text).alias("__row"))
        out = out.unionByName(same.select("__row.*"))
    return named(out.unionByName(docs.filter(docs["doc_id"].isNull())))
