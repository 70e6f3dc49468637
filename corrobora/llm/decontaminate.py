"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared seeds (runs of ``seed`` tokens). A tile is a match of at least ``seed``
tokens, so tiles lie where consecutive seeds are known; only those stretches of a document travel on. A bit array of
fixed size tells which seeds some item may have, the join on the seed itself decides. For every candidate pair, running
Karp-Rabin tiling marks the longest matches that don't overlap, longest first, until none of ``seed`` tokens is left;
passages may stand in any order. An item is in a document if tiles cover at least ``coverage`` of its tokens.

Tokens are runs of letters, digits and underscores, lower-cased. Defined cases: null and empty texts have no tokens;
an item of fewer than ``seed`` tokens is found as a whole (its only seed is all of it); an item without tokens is never
found; rows with null ids are found like others, with null as id; repeated items are each found; ties between matches
of one length go to the first in the document, then in the item.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corrobora.llm.common import keep, slices, texts_of
from corrobora.session import ship

SEED = 5
COVERAGE = 0.5
FILTER_BITS = 24        # the bit array of seeds is 2 MB, whatever the benchmark
SALT = 16               # an item's candidates are spread over so many keys
GAP = "\x00"            # parts stretches of a document that aren't neighbours

_words = re.compile(r"\w+").findall


def tokens(text: str) -> list[str]:
    return _words(text.lower())


def _hash(words: tuple[str, ...] | list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def seeds_of(words: list[str], seed: int) -> list[int]:
    if not words:
        return []
    return [_hash(words[i:i + seed]) for i in range(max(1, len(words) - seed + 1))]


# ---------------------------------------------------------------- tiling

_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _running(words: list[int]) -> list[int]:
    """Hashes of all beginnings; that of any window follows from two of them."""
    out = [0]
    for w in words:
        out.append((out[-1] * _BASE + w) % _PRIME)
    return out


def tiles(doc: list[str], item: list[str], least: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of greedy string tiling, longest matches first.

    A round finds all matches of ``size`` free tokens and more by running hashes and marks them from the longest down, equal
    ones by their places; of a match that another has covered in part, the free stretches take their turn by their own
    length. What is shorter than ``size`` is left to the next round; the size halves down to ``least``.
    """
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    known_d, known_i = [0 if w == GAP else number.get(w, 0) for w in doc], [number[w] for w in item]
    hash_d, hash_i = _running(known_d), _running(known_i)
    marked_d, marked_i, out = [not w for w in known_d], [False] * len(item), []       # words the item lacks are never free
    size = max(least, min(len(doc), len(item)))
    while size >= least:
        power, at = pow(_BASE, size, _PRIME), defaultdict(list)
        for i in _open(marked_i, size):
            at[(hash_i[i + size] - hash_i[i] * power) % _PRIME].append(i)
        heap = []
        for d in _open(marked_d, size) if at else ():
            for i in at.get((hash_d[d + size] - hash_d[d] * power) % _PRIME, ()):
                if known_d[d:d + size] == known_i[i:i + size]:
                    n = size
                    while d + n < len(doc) and i + n < len(item) and known_d[d + n] == known_i[i + n] and not marked_d[d + n] and not marked_i[i + n]:
                        n += 1
                    heap.append((-n, d, i))
        heapify(heap)
        while heap:
            n, d, i = heappop(heap)
            covered = [marked_d[d + t] or marked_i[i + t] for t in range(-n)]
            if not any(covered):
                marked_d[d:d - n] = marked_i[i:i - n] = [True] * -n
                out.append((d, i, -n))
                continue
            start = None
            for t, c in enumerate([*covered, True]):
                if c:
                    if start is not None and t - start >= size:
                        heappush(heap, (start - t, d + start, i + start))
                    start = None
                elif start is None:
                    start = t
        size = size // 2 if size // 2 > least else least if size > least else 0
    return out


def _open(marked: list[bool], size: int) -> Iterator[int]:
    """Starts of runs of ``size`` unmarked tokens."""
    run = 0
    for at, m in enumerate(marked):
        run = 0 if m else run + 1
        if run >= size:
            yield at - size + 1


# ---------------------------------------------------------------- the operator

def _item_seeds(items: DataFrame, seed: int) -> DataFrame:
    ship(items.sparkSession)

    def run(batches):
        for b in slices(batches):
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = tokens(text)
                hashes = [_signed(h) for h in seeds_of(words, seed)]
                if hashes:
                    yield pa.RecordBatch.from_pydict({
                        "item": pa.array([item_id], pa.int64()), "words": pa.array([words], pa.list_(pa.string())),
                        "short": pa.array([len(words) if len(words) < seed else 0], pa.int32()),
                        "hashes": pa.array([hashes], pa.list_(pa.int64()))})
    return items.mapInArrow(run, "item long, words array<string>, short int, hashes array<long>")


def _seed_filter(seeds: DataFrame) -> tuple[bytes, list[int]]:
    """A bit array of fixed size of all seeds, and the sizes under ``seed`` that some item has."""
    low = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long"))
    # 64 bits a row: at most 2^18 rows come to the driver
    got = (seeds.select(F.explode("hashes").alias("h")).select(F.shiftrightunsigned(low, 6).alias("w"), low.bitwiseAND(F.lit(63).cast("long")).cast("int").alias("b"))
           .distinct().groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("bits")).toArrow())
    array = np.zeros(1 << FILTER_BITS - 6, np.int64)
    array[np.asarray(got.column("w").to_numpy(), np.int64)] = got.column("bits").to_numpy()
    short = sorted(r["short"] for r in seeds.filter("short > 0").select("short").distinct().collect())
    return array.view(np.uint8).tobytes(), short


def _document_seeds(docs: DataFrame, seed: int, bits: bytes, short: list[int]) -> DataFrame:
    """doc_id, its known seeds, and the stretches they cover, parted by GAP. Documents without any go."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        mask = np.uint64((1 << FILTER_BITS) - 1)
        for b in slices(batches):
            out = {"key": [], "doc": [], "words": [], "hashes": []}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = tokens(text)
                n = len(words)
                if not n:
                    continue
                keep_at, hashes = np.zeros(n + 1, np.int64), []
                for size in [*short, seed]:
                    if size > n:
                        continue
                    h = _rolling(words, size)
                    hit = np.flatnonzero(known[(h & mask).astype(np.int64)])
                    if len(hit):
                        hashes.append(h[hit])
                        np.add.at(keep_at, hit, 1)
                        np.add.at(keep_at, hit + size, -1)
                if not hashes:
                    continue
                inside = np.flatnonzero(np.cumsum(keep_at[:-1]) > 0)
                stretch, last = [], None
                for at in inside.tolist():
                    if last is not None and at != last + 1:
                        stretch.append(GAP)
                    stretch.append(words[at])
                    last = at
                out["key"].append(_signed(xxhash.xxh3_64_intdigest(text, 1)))
                out["doc"].append(doc_id)
                out["words"].append(stretch)
                out["hashes"].append(np.unique(np.concatenate(hashes)).view(np.int64).tolist())
            if out["doc"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["key"], pa.int64()), pa.array(out["doc"], pa.int64()), pa.array(out["words"], pa.list_(pa.string())),
                     pa.array(out["hashes"], pa.list_(pa.int64()))], names=["key", "doc", "words", "hashes"])
    return docs.mapInArrow(run, "key long, doc long, words array<string>, hashes array<long>")


def _rolling(words: list[str], size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words: those of seeds_of, cut from one string."""
    joined = " ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(joined[a:b]) for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())),
                       np.uint64, len(words) - size + 1)


def contaminated(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE, doc_id: str = "doc_id",
                 item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, n_tokens (of the item): the items that documents hold."""
    own = keep(_item_seeds(items.select(items[item_id].cast("long").alias("item"), F.coalesce(items[text_col], F.lit("")).alias("text")), seed), "item-seeds")
    bits, short = _seed_filter(own)
    found = keep(_document_seeds(texts_of(docs, doc_id, text_col), seed, bits, short), "document-seeds")
    # a document row is known by its id and text; an item by its id and words
    of_item = (own.select("item", F.xxhash64("words").alias("item_key"), F.size("words").alias("size"), F.explode("hashes").alias("h"))
               .groupBy("item", "item_key", "h", "size").agg(F.count("*").alias("times")))
    # each place of a shared seed covers ``seed`` tokens of the item at most
    reach = F.col("places") * F.least(F.lit(seed), F.col("size")) >= F.col("size") * coverage
    shared = (found.select("key", "doc", F.explode("hashes").alias("h")).distinct().join(of_item, "h")
              .groupBy("key", "doc", "item", "item_key", "size").agg(F.sum("times").alias("places"))
              .filter(reach).select("key", "doc", "item", "item_key"))
    pairs = keep(shared, "pairs")
    texts = found.groupBy("key", "doc").agg(F.first("words").alias("words"), F.count("*").alias("times"))
    with_doc = pairs.alias("p").join(texts.alias("t"), (F.col("p.key") == F.col("t.key")) & F.col("p.doc").eqNullSafe(F.col("t.doc"))).select(
        F.col("p.doc").alias("doc"), "item", "item_key", F.col("words").alias("doc_words"), "times", F.pmod("p.key", F.lit(SALT)).alias("salt"))
    salted = own.groupBy("item", F.xxhash64("words").alias("item_key")).agg(F.first("words").alias("item_words"), F.count("*").alias("item_times"))
    salted = salted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    both = with_doc.alias("d").join(salted.alias("s"), (F.col("d.item_key") == F.col("s.item_key")) & (F.col("d.salt") == F.col("s.salt"))
                                    & F.col("d.item").eqNullSafe(F.col("s.item")))

    def run(batches):
        for b in slices(batches, 500):
            rows = []
            for r in b.to_pylist():
                words = r["item_words"]
                got = tiles(r["doc_words"], words, min(seed, len(words)))
                share = sum(n for _, _, n in got) / len(words)
                if share >= coverage:
                    rows += [(r["doc"], r["item"], share, len(got), len(words))] * (r["times"] * r["item_times"])
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                                             names=["doc_id", "item_id", "coverage", "n_tiles", "n_tokens"])
    return both.select("doc", "d.item", "doc_words", "item_words", "times", "item_times").mapInArrow(
        run, "doc_id long, item_id long, coverage double, n_tiles long, n_tokens long")


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents that hold no item. Rows without an id are told apart by nothing, so all of them stay."""
    bad = keep(contaminated(docs, items, **how).select(F.col("doc_id").alias("__bad")).filter("__bad is not null").distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
