"""Words that are one edit apart, by scanning sorted lists with reused rows of the edit matrix.

Two words one edit apart agree outside one third of the shorter word (its length counts for both), so every word joins
six groups: for its length and the next smaller one, and for each third, by all that lies outside it. Inside a group the
words are sorted once. Each word then runs down the list: of the next word's edit matrix the rows of the prefix shared
with the word before are already there (three cells wide, as one edit is all that counts), and once a row holds nothing
below two, the whole range of words that share this prefix is skipped. A pair is reported by the one group whose third
holds the place where the two words part.

A group of more than GROUP words is dealt out anew by thirds of its third, until it fits: a stretch of one letter cannot
have more than 90 + 90 * 90 words.

Defined cases: a null text has no words, a null id counts as the empty text in the checksum; repeated rows count as often
as they stand; equal counts go to the word that comes first in code-point order; no documents give no rows.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.common import keep, slices, texts_of, utf8

LEAST = 7               # code points of a word
OFTEN = 2               # occurrences of a word
TIMES = 10              # a form is so many times as frequent
EVERY = 31              # of so many runs, by checksum, one loses a letter
GROUP = 10_000          # words sorted at once
HELD = 400_000          # different words a task counts before it hands them on
_RUNS = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)


# ---------------------------------------------------------------- vocabulary

def words_of(doc_id: int | None, text: bytes, every: int = EVERY) -> Counter:
    """Words of a text and their counts; bytes.lower() lowers A-Z and nothing else."""
    runs, start = Counter(_RUNS.findall(text.lower().decode("utf-8", "replace"))), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, often: int = OFTEN, every: int = EVERY) -> DataFrame:
    """(word, n) of all words that occur often enough; tasks count first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in slices(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text"))):
                held.update(words_of(doc_id, text, every))
                if len(held) >= HELD:
                    yield done()
        yield done()

    counted = texts_of(docs).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


# ---------------------------------------------------------------- scan of one sorted list

def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def near_pairs(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """(i, j, common prefix) for all i < j of a sorted list of different words that are exactly one edit apart."""
    n = len(words)
    lcp = [0] + [shared(words[i - 1], words[i]) for i in range(1, n)] + [-1]
    lower = [n] * (n + 1)                                   # the next place whose common prefix is shorter
    for i in range(n - 1, -1, -1):
        k = i + 1
        while lcp[k] >= lcp[i]:
            k = lower[k]
        lower[i] = k
    for i, q in enumerate(words):
        size = len(q)
        # rows[d]: distances of the first d letters to the first d - 1, d, d + 1 letters of q; q itself comes first
        rows = [(1, 0, 1)] * (size + 1)
        known, together, j = size, size, i + 1
        while j < n:
            w = words[j]
            known, together = min(known, lcp[j]), min(together, lcp[j])
            d, dead = known, False
            while d < len(w):
                a, b, c = rows[d]
                x = w[d]
                d += 1
                left = min(a + (d < 2 or d - 2 >= size or x != q[d - 2]), b + 1)
                mid = min(b + (d > size or x != q[d - 1]), c + 1, left + 1)
                right = min(c + (d >= size or x != q[d]), mid + 1)
                if d < len(rows):
                    rows[d] = (left, mid, right)
                else:
                    rows.append((left, mid, right))
                if left > 1 and mid > 1 and right > 1:
                    dead = True
                    break
            known = d
            if dead:
                j += 1
                while lcp[j] >= d:
                    j = lower[j]
                continue
            if abs(len(w) - size) <= 1 and rows[len(w)][size - len(w) + 1] == 1:
                yield i, j, together
            j += 1


# ---------------------------------------------------------------- groups

def _thirds(rows: DataFrame) -> DataFrame:
    """The same rows for each third of lo..hi; key tells what lies outside it."""
    def part(k: int) -> Column:
        lo, span = F.col("lo"), F.col("hi") - F.col("lo")
        a, b = lo + F.floor(span * k / 3).cast("int"), lo + F.floor(span * (k + 1) / 3).cast("int")
        return F.struct(a.alias("lo"), b.alias("hi"))

    cut = rows.select("word", "n", "size", F.explode(F.array(*[part(k) for k in range(3)])).alias("s")).select("word", "n", "size", "s.lo", "s.hi").filter("hi > lo")
    return cut.withColumn("key", F.expr(
        "xxhash64(size, lo, hi, substring(word, 1, lo), substring(word, hi + 1 + char_length(word) - size))"))


def _scan(rows: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways, of the near pairs in groups that fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, {}, []

        def found(key_of: tuple, group: dict) -> None:
            words = sorted(group)
            if len(words) > 1:
                size, lo, hi = key_of[1:]
                for i, j, at in near_pairs(words):
                    a, b = words[i], words[j]
                    if min(len(a), len(b)) == size and (lo <= at < hi or at == hi == size):
                        out.append((a, group[a], b, group[b]))
                        out.append((b, group[b], a, group[a]))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()))],
                                              ["word", "n", "other", "other_n"])

        for b in batches:
            for k, size, lo, hi, word, n in zip(*[b.column(c).to_pylist() for c in ("key", "size", "lo", "hi", "word", "n")]):
                if (k, size, lo, hi) != key:
                    if key:
                        found(key, group)
                    key, group = (k, size, lo, hi), {}
                group[word] = n
            yield batch()
        if key:
            found(key, group)
        yield batch()

    own = ["key", "size", "lo", "hi"]
    return rows.select(*own, "word", "n").repartition("key").sortWithinPartitions(*own).mapInArrow(
        run, "word string, n bigint, other string, other_n bigint")


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, other, other_n) for all words (word, n; each once) exactly one edit apart, both ways."""
    size = F.char_length("word")
    rows = _thirds(words.select("word", "n", F.explode(F.array(size, size - 1)).alias("size"))
                   .select("word", "n", "size", F.lit(0).alias("lo"), F.col("size").alias("hi")).filter("size > 0"))
    out = None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("in_group")).filter("in_group > 1")
        met = keep(rows.join(sizes, "key"), "variants-groups")
        fits = (F.col("in_group") <= group) | (F.col("hi") - F.col("lo") <= 1)
        found = keep(_scan(met.filter(fits)), "variants-pairs")
        out = found if out is None else out.unionByName(found)
        large = met.filter(~fits)
        if large.isEmpty():
            return out
        rows = _thirds(large.select("word", "n", "size", "lo", "hi"))


# ---------------------------------------------------------------- forms

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): pointers double until none leads on. Counts grow tenfold at each step, so few rounds do."""
    at = keep(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = keep(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("led")), "variants-roots")
        at = step.select("word", "root")
        if step.filter("led").isEmpty():
            return at


def spelling_variants(docs: DataFrame, often: int = OFTEN, times: int = TIMES, every: int = EVERY, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = keep(vocabulary(docs, often, every), "variants-words")
    best = near_words(words, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    met = words.join(best, "word", "left")
    is_form = -F.col("top.less") >= times * F.col("n")
    known = keep(met.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                            F.when(is_form, F.col("top.other")).alias("form"), F.when(is_form, -F.col("top.less")).alias("form_n")), "variants-forms")
    led = roots(known.filter("form is not null").select("word", "form"))
    return known.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
