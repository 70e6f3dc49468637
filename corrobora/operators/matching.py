"""Substring joins without a cross join: many keys are looked for in one walk over a text."""
from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corrobora.session import cut, ship

KEYS_SHARED, CHARS_SHARED = 100_000, 1 << 21      # keys and their characters that one automaton may hold
FILTER_BITS = 1 << 26                             # bits of the anchor filter beyond that: 8 MB whatever the keys
GRAMS = (8, 4, 3, 2, 1)                           # a key is anchored by its rarest gram of the first size it has
_automaton: tuple = (None, None)                  # one for each Python worker: the last set of keys met


def contains_join(texts: DataFrame, text_id: str, text: Column, keys: DataFrame, key: str,
                  inline_limit: int = KEYS_SHARED) -> DataFrame:
    """``(text_id, key)`` pairs where the text holds the key as a substring. Exact; ``text_id`` is unique.
    Null and empty keys match nothing, a null text is an empty one.

    Keys up to ``inline_limit`` (both their number and their characters are checked) are broadcast and every
    task walks its texts once with an automaton of all keys: nothing is shuffled and only hits leave a row.
    Beyond that a filter of fixed size, built from one gram for each key, is tested at every place of a text; the
    places that pass are joined with the keys by hash and verified.
    """
    want = keys.select(F.col(key).alias("k")).filter("k IS NOT NULL AND k <> ''").distinct()
    body = texts.select(text_id, F.coalesce(text, F.lit("")).alias("_text"))
    ship(texts.sparkSession)
    want = cut(want)
    size = want.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("k")), F.lit(0)).alias("chars")).first()
    if not size["n"]:
        return body.select(text_id, F.lit("").alias(key)).limit(0)
    if size["n"] <= inline_limit and size["chars"] <= CHARS_SHARED:
        return _walk(body, text_id, sorted(r["k"] for r in want.collect()), key)
    return _anchor_join(body, text_id, want, key)


def _emit(batches, kind, find):
    """``find(text)`` for every row of (id, text) batches, as (id, value) batches of bounded length."""
    for b in batches:
        at, out = [], []
        for i in range(b.num_rows):
            found = find(b.column(1)[i].as_py())
            at.extend([i] * len(found))
            out.extend(found)
            if len(out) >= 1 << 16 or i == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, kind)], names=["id", "v"])
                at, out = [], []


def _machine(held):
    global _automaton
    if _automaton[0] != held.id:
        a = ahocorasick.Automaton()
        for k in held.value["keys"]:
            a.add_word(k, k)
        a.make_automaton()
        _automaton = (held.id, a)
    return _automaton[1]


class _Held:
    """A broadcast value with a name of its own, so that a reused worker knows whether it has built it already."""

    def __init__(self, spark, value):
        self.shared = spark.sparkContext.broadcast(value)
        self.id = self.shared._jbroadcast.id()

    def __getstate__(self):
        return {"shared": self.shared, "id": self.id}

    @property
    def value(self):
        return self.shared.value


def _ids(body: DataFrame, text_id: str, value: str) -> str:
    return f"id {body.schema[text_id].dataType.simpleString()}, v {value}"


def _walk(body: DataFrame, text_id: str, found: list[str], key: str) -> DataFrame:
    held = _Held(body.sparkSession, {"keys": found})

    def walk(batches):
        machine = _machine(held)
        return _emit(batches, pa.string(), lambda t: list({k for _, k in machine.iter(t)}))
    return body.mapInArrow(walk, _ids(body, text_id, "string")).toDF(text_id, key)


def gram_hashes(text: str, n: int) -> np.ndarray:
    """One 64-bit number for each run of ``n`` code points of a text."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(c) < n:
        return np.empty(0, np.uint64)
    h = np.full(len(c) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j:len(c) - n + 1 + j] + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def _anchor_join(body: DataFrame, text_id: str, want: DataFrame, key: str) -> DataFrame:
    spark = body.sparkSession
    size = F.coalesce(*[F.when(F.length("k") >= n, F.lit(n)) for n in GRAMS])
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("k") - size + 1), lambda i: F.substr("k", i, size)))
    own = want.select("k", F.explode(grams).alias("g"))
    rarity = own.groupBy("g").agg(F.count("*").alias("n"))
    anchor = own.join(rarity, "g").groupBy("k").agg(F.min_by("g", F.struct("n", "g")).alias("g"))

    def hashed(batches):
        return _emit(batches, pa.int64(), lambda g: gram_hashes(g, len(g)).view(np.int64))
    anchors = cut(anchor.mapInArrow(hashed, "k string, h long"))
    bits = anchors.select(F.pmod("h", F.lit(FILTER_BITS)).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits"))
    sizes = sorted(r["n"] for r in want.select(size.alias("n")).distinct().collect())       # of five: those that some key has
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    set_bits = bits.toArrow()                      # at most FILTER_BITS / 64 rows
    filled[set_bits["at"].to_numpy()] = set_bits["bits"].to_numpy()
    held = _Held(spark, filled.view(np.uint64))

    def passing(batches):
        flags = held.value

        def find(text):
            h = np.concatenate([gram_hashes(text, n) for n in sizes])
            place = h & np.uint64(FILTER_BITS - 1)
            return np.unique(h[(flags[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]).view(np.int64)
        return _emit(batches, pa.int64(), find)
    met = body.mapInArrow(passing, _ids(body, text_id, "long")).toDF(text_id, "h")
    cand = met.join(anchors, "h").select(text_id, "k").distinct()
    return (cand.join(body, text_id).filter(F.contains("_text", F.col("k")))
            .select(text_id, F.col("k").alias(key)))
