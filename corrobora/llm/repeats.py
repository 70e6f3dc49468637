"""Byte strings that came before, found in suffix arrays built by linear grouping.

Which windows are worth sorting. Every WINDOW bytes hold an anchor: of their K-byte grams the one of smallest hash, the
leftmost of equals. Consecutive windows with the same anchor are one stretch. Equal windows have equal anchors at equal
places, so they stand in stretches of one group. Stretches go out as (anchor, hash of their bytes, place), never with
their bytes, and a task hands on only the first of equal ones it holds. Of stretches that are equal throughout, all but
the first have come before. Only where a group holds different stretches are their bytes fetched, each different one
once, and sorted: suffixes that share WINDOW bytes lie next to each other, and all but the first of them have come before.

Grams that stand in many documents of a bounded sample are chosen as anchors only where a window has no other, so that a
line found in a third of all texts makes no large group unless the text around it is the same as well. This moves anchors
and nothing else: any set of common grams gives the same result. A group of more than GROUP different stretches takes
longer grams (the next of GRAMS); the last are as long as the window, and then equal stretches are all there is.

Linear grouping. Suffixes are grouped by their longest Lyndon prefix. Groups are taken from the largest down; every
member points to the nearest suffix before it whose group is still to come (the previous smaller one), and the suffixes
pointed at leave their groups for new ones just above, the further up the more members point at them. Then the order is
emitted from the smallest suffix on: each settled suffix settles the one before it and along its previous-smaller
pointers all that are not settled yet, each at the front of what is left of its group. No renaming, no recursion.

Defined cases: a null text is empty; texts shorter than the window lose nothing. Earlier means a smaller doc_id (null
first), then a smaller hash of the text where ids are equal, then an earlier start; of rows equal in id and text one
counts as the first. No documents give no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora.llm.common import keep, slices, texts_of, utf8

WINDOW = 100
GRAMS = (50, 75, 100)
GROUP = 4_096           # different stretches that are sorted at once
TEXT = 1 << 18          # symbols that are sorted at once, unless one group has more
PIECE = 2_000_000       # bytes whose anchors are found at once, unless one text has more
SAMPLE = 1_024          # documents, about, in which common grams are looked for
COMMON = 8              # of them hold a common gram
SLOTS = 1 << 22         # bits for common grams
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- suffix order by linear grouping

def suffix_order(text: list[int]) -> list[int]:
    """Starts of all suffixes in order. The last symbol must be the smallest and stand nowhere else."""
    n = len(text)
    symbols = sorted(set(text))
    number = {s: i for i, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below, above = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    before, done = [-1] * n, bytearray(n)

    g = len(symbols) - 1
    while g >= 0:
        live = [i for i in members[g] if group[i] == g]
        members[g] = live
        if len(live) == 1:
            i = live[0]
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            pointed = {1: [p]} if p >= 0 else {}
        else:
            live.sort()
            count: dict[int, int] = {}
            for i in live:
                done[i] = 1
            for i in live:
                p = i - 1
                while p >= 0 and done[p]:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    count[p] = count.get(p, 0) + 1
            pointed = {}
            for p, k in count.items():
                pointed.setdefault(k, []).append(p)
        for k in sorted(pointed, reverse=True) if len(pointed) > 1 else pointed:
            leave: dict[int, list[int]] = {}
            for p in pointed[k]:
                leave.setdefault(group[p], []).append(p)
            for old, them in leave.items():
                if len(them) == size[old]:                  # the group stays as it is
                    continue
                new, up = len(members), above[old]
                members.append(them)
                size.append(len(them))
                size[old] -= len(them)
                for p in them:
                    group[p] = new
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
        g = below[g]

    front, at, g = [0] * len(members), 0, 0                 # the smallest symbol's group is the lowest
    while g >= 0:
        front[g] = at
        at += size[g]
        g = above[g]
    order, settled = [0] * n, bytearray(n)
    order[0] = n - 1
    settled[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not settled[j]:
            settled[j] = 1
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            j = before[j]
    return order


# ---------------------------------------------------------------- anchors

def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, by doubling."""
    piece, size, factor = data.astype(np.uint64) + np.uint64(1), 1, np.array([_ODD])
    out, have = None, 0
    while True:
        if k & size:
            m = len(data) - have - size + 1
            out, have = (piece[:m] if out is None else out[:m] * factor + piece[have:have + m]), have + size
        if 2 * size > k:
            return _mixed(out)
        m = len(piece) - size
        piece, size, factor = piece[:m] * factor + piece[size:], 2 * size, factor * factor


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row."""
    size = 1
    out = values
    while 2 * size <= w:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    n = len(values) - w + 1
    return np.minimum(out[:n], out[w - size:w - size + n])


def stretches(texts: list[bytes], k: int, common: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, offset of the anchor, anchor) of every stretch, in order."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW or size.max() < WINDOW:
        return none, none, none, none, none
    h = grams(data, k)
    rank = h >> np.uint64(1)
    if common is not None:                                  # common grams rank behind all others
        slot = h & np.uint64(SLOTS - 1)
        rank |= ((common[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(np.uint64) << np.uint64(63)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    ranked = ((rank >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    at = (_least(ranked, WINDOW - k + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), size)[:len(at)]
    start = np.cumsum(size) - size
    window = np.arange(len(at)) - start[text]
    inside = window + WINDOW <= size[text]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(inside & new)
    last = np.flatnonzero(inside & np.concatenate((new[1:] | ~inside[1:], [True])))
    return text[first], window[first], last - first + 1, at[first] - first, h[at[first]].view(np.int64)


def common_grams(texts: DataFrame, k: int, sample: int = SAMPLE) -> np.ndarray | None:
    """Bits of the grams that stand in COMMON documents or more of a sample."""
    n = texts.count()
    if not n:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            seen = [np.unique(grams(np.frombuffer(t, np.uint8), k) & np.uint64(SLOTS - 1)) for t in utf8(b.column("text")) if len(t) >= k]
            slot, many = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(many.astype(np.int32))], ["slot", "many"])

    found = (texts.sample(min(1.0, sample / n), 7).select("text").mapInArrow(run, "slot int, many int")
             .groupBy("slot").agg(F.sum("many").alias("many")).filter(F.col("many") >= COMMON).select("slot").toArrow())
    bits = np.zeros(SLOTS, bool)
    bits[np.asarray(found.column("slot"))] = True
    return np.packbits(bits, bitorder="little")


# ---------------------------------------------------------------- stretches of a table

_KEY = ["doc_id", "thash"]
#: place: first window << 20 | windows << 8 | offset of the anchor; an offset of SEEN marks windows known to have come before
SEEN = 255
_PLACED = "anchor bigint, bytes bigint, doc_id bigint, thash bigint, place bigint"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about PIECE bytes."""
    for b in batches:
        at, size = 0, np.cumsum([0] + pc.binary_length(b.column("text")).to_pylist())
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + PIECE, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def _order_of(ids: list, hashes: list, starts: list) -> np.ndarray:
    """Rank of each row by (doc_id, null first; thash; start)."""
    null = np.array([i is None for i in ids])
    own = np.array([0 if i is None else i for i in ids], np.int64)
    out = np.empty(len(ids), np.int64)
    out[np.lexsort((np.array(starts, np.int64), np.array(hashes, np.int64), own, ~null))] = np.arange(len(ids))
    return out


def placed(texts: DataFrame, k: int, common: np.ndarray | None) -> DataFrame:
    """Stretches of (doc_id, thash, start, text): the first of equal ones in a piece; the others as windows seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(slices(batches)):
            ids, hashes, starts, data = (b.column("doc_id").to_pylist(), b.column("thash").to_pylist(), b.column("start").to_pylist(), utf8(b.column("text")))
            if max(map(len, data), default=0) > 2 * PIECE:  # windows of a very long text, in pieces
                cut = [(i, at) for i, t in enumerate(data) for at in range(0, max(1, len(t) - WINDOW + 1), PIECE)]
                ids, hashes, starts, data = ([ids[i] for i, _ in cut], [hashes[i] for i, _ in cut], [starts[i] + at for i, at in cut],
                                             [data[i][at:at + PIECE + WINDOW - 1] for i, at in cut])
            rank = _order_of(ids, hashes, starts)
            by = np.argsort(rank)                           # texts in order, so that the first of equals is the earliest
            ids, hashes, starts, data = ([c[i] for i in by] for c in (ids, hashes, starts, data))
            text, window, many, offset, anchor = stretches(data, k, common)
            digest = np.fromiter((xxhash.xxh3_64_intdigest(data[t][w:w + m + WINDOW - 1]) for t, w, m in zip(text.tolist(), window.tolist(), many.tolist())),
                                 np.uint64, len(text)).view(np.int64)
            sort = np.lexsort((digest, anchor))
            same = np.concatenate(([False], (anchor[sort][1:] == anchor[sort][:-1]) & (digest[sort][1:] == digest[sort][:-1]))) if len(sort) else np.zeros(0, bool)
            seen = np.zeros(len(text), bool)
            seen[sort[same]] = True
            # a row met twice, or a piece of the same text, does not come before itself
            begin = np.array(starts, np.int64)[text] + window
            if len(set(zip(ids, hashes))) < len(ids):
                head = sort[np.maximum.accumulate(np.where(~same, np.arange(len(sort)), 0))]
                first = np.empty(len(sort), np.int64)
                first[sort] = head
                key = {v: i for i, v in enumerate(dict.fromkeys(zip(ids, hashes)))}
                own = np.array([key[v] for v in zip(ids, hashes)], np.int64)[text]
                again = seen & (own[first] == own) & (begin[first] == begin)
                some = ~again
            else:
                some = np.ones(len(text), bool)
            offset = np.where(seen, SEEN, offset)
            pick = np.flatnonzero(some)
            place = begin[pick] << 20 | many[pick] << 8 | offset[pick]
            # windows seen need no company: their key only deals them out
            key = np.where(seen[pick], place * np.int64(-7046029254386353131) + np.array(hashes, np.int64)[text[pick]], anchor[pick])
            yield pa.RecordBatch.from_arrays([
                pa.array(key, pa.int64()), pa.array(digest[pick]), pa.array(ids, pa.int64()).take(pa.array(text[pick])),
                pa.array(hashes, pa.int64()).take(pa.array(text[pick])), pa.array(place)], ["anchor", "bytes", *_KEY, "place"])

    return texts.select("doc_id", "thash", "start", "text").mapInArrow(run, _PLACED)


def _windows(rows: DataFrame) -> DataFrame:
    """(doc_id, thash, span): span is start << 12 | n, the n windows from start on have come before."""
    return rows.select(*_KEY, F.shiftright("place", 8).alias("span"))


def compared(spots: DataFrame) -> DataFrame:
    """Windows, of the different stretches (anchor, offset, doc_id, thash, start, data) of each group, that have come before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            rows = sorted(held, key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[4]))
            held.clear()
            out = [(rows[i][2], rows[i][3], (rows[i][4] + a) << 12 | b - a) for i, a, b in repeated(rows)]
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], [*_KEY, "span"])

        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("anchor", "offset", *_KEY, "start", "data", "k")]):
                if size >= TEXT and r[0] != last:
                    yield done()
                    size = 0
                held.append(r)
                size, last = size + len(r[5]), r[0]
        yield done()

    return (spots.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "offset", *_KEY, "start", "data", "k")
            .mapInArrow(run, "doc_id bigint, thash bigint, span bigint"))


def repeated(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(row, first, end) of the windows of rows (anchor, offset, doc_id, thash, start, data, k), in order, that have come before.

    All windows of a row hold its anchor, so the anchor's bytes are one symbol, another for every group. 1 ends a row, 0 all.
    """
    text: list[int] = []
    begin, many, span = [], [], 0
    symbol: dict[int, int] = {}
    for anchor, offset, _, _, _, data, k in rows:
        begin.append(len(text))
        text.extend(c + 2 for c in data[:offset])
        text.append(symbol.setdefault(anchor, 258 + len(symbol)))
        text.extend(c + 2 for c in data[offset + k:])
        text.append(1)
        many.append(len(data) - WINDOW + 1)
        span = WINDOW - k + 1
    if len(rows) < 2:
        return
    text.append(0)
    order = np.array(suffix_order(text), np.int64)
    flat, first, windows = np.array(text, np.int32), np.array(begin), np.array(many)
    row = np.searchsorted(first, order, "right") - 1
    start = order - first[row]
    pick = start < windows[row]
    order, row, start = order[pick], row[pick], start[pick]
    view = np.lib.stride_tricks.sliding_window_view(flat, span)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 1 << 15):
        to = min(len(order), at + (1 << 15))
        same[at:to] = (view[order[at:to]] == view[order[at - 1:to - 1]]).all(1)
    head = np.flatnonzero(~same)
    docs: dict[tuple, int] = {}
    doc = np.array([docs.setdefault((r[2], r[3]), len(docs)) for r in rows], np.int64)
    when = doc[row] << 40 | (np.array([r[4] for r in rows], np.int64)[row] + start)
    least = np.repeat(np.minimum.reduceat(when, head), np.diff(np.append(head, len(order))))
    old = when != least
    flags = np.zeros(int(windows.sum()) + 1, np.int8)
    base = np.cumsum(windows) - windows
    flags[base[row[old]] + start[old]] = 1
    for i in np.unique(row[old]).tolist():
        f = np.diff(np.concatenate(([0], flags[base[i]:base[i] + windows[i]], [0])))
        for a, b in zip(np.flatnonzero(f == 1).tolist(), np.flatnonzero(f == -1).tolist()):
            yield i, a, b


def _level(texts: DataFrame, k: int, common: np.ndarray | None) -> DataFrame:
    """Stretches that matter: seen ones, later ones of equal bytes (late), and those of groups that differ (alike = how many)."""
    equal = Window.partitionBy("anchor", "bytes").orderBy(*_KEY, "place")
    met = placed(texts, k, common).repartition("anchor").withColumn("late", F.rank().over(equal) > 1)
    met = met.withColumn("alike", F.sum(F.when(~F.col("late"), 1)).over(Window.partitionBy("anchor")))
    seen = F.col("place").bitwiseAND(255) == SEEN
    return keep(met.withColumn("late", F.col("late") | seen).filter(F.col("late") | (F.col("alike") > 1)), "repeats-met")


def _fetched(parts: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """The different stretches of groups, each once for a place, with their bytes (data)."""
    spots = met.filter(~F.col("late")).groupBy(*_KEY).agg(F.collect_set(F.struct("anchor", "alike", "place")).alias("spots"))
    t, p = parts.alias("t"), spots.hint("shuffle_hash").alias("p")
    at, many = F.expr("shiftright(s.place, 20)"), F.expr("cast(s.place >> 8 & 4095 as int)")
    cut = (t.join(p, F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.thash") == F.col("p.thash")))
           .select("t.doc_id", "t.thash", F.col("t.start").alias("from"), "text", F.explode("spots").alias("s"))
           .filter((at >= F.col("from")) & (at + many + (WINDOW - 1) <= F.col("from") + F.length("text"))))
    return cut.select("s.anchor", "s.alike", *_KEY, at.alias("start"), F.expr("cast(s.place & 255 as int)").alias("offset"), F.lit(k).alias("k"),
                      F.substring("text", (at - F.col("from") + 1).cast("int"), many + (WINDOW - 1)).alias("data"))


def repeated_windows(texts: DataFrame, group: int = GROUP, grams_of: tuple[int, ...] = GRAMS, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, thash, span) of windows that have come before; span is start << 12 | n. texts: doc_id, thash, text."""
    parts, out = texts.select(*_KEY, F.lit(0).cast("long").alias("start"), F.encode("text", "UTF-8").alias("text")), []
    for k in grams_of:
        met = _level(parts, k, common_grams(parts, k, sample) if k < WINDOW else None)
        out.append(_windows(met.filter("late")))
        differ = met.filter("not late and alike > 1")
        if k == WINDOW or differ.isEmpty():
            break
        cut = keep(_fetched(parts, differ, k), "repeats-stretches")
        out.append(keep(compared(cut.filter(F.col("alike") <= group)), "repeats-compared"))
        large = cut.filter(F.col("alike") > group)
        if large.isEmpty():
            break
        parts = large.select(*_KEY, "start", F.col("data").alias("text"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


# ---------------------------------------------------------------- result

def without(data: bytes, windows: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of data without the windows (start, n), and how many bytes in how many runs went."""
    kept, removed, runs, end = [], 0, 0, 0
    at = None
    for start, n in sorted(windows):
        to = start + n + WINDOW - 1
        if at is None or start > end:
            if at is not None:
                removed, runs = removed + end - at, runs + 1
            kept.append(data[end:start])
            at, end = start, to
        end = max(end, to)
    if at is not None:
        removed, runs = removed + end - at, runs + 1
    kept.append(data[end:])
    return b"".join(kept), removed, runs


def without_repeats(docs: DataFrame, group: int = GROUP, grams_of: tuple[int, ...] = GRAMS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    texts = texts_of(docs).withColumn("thash", F.xxhash64("text"))
    found = repeated_windows(texts, group, grams_of, sample).groupBy(*_KEY).agg(F.collect_set("span").alias("windows"))
    t, w = texts.alias("t"), found.hint("shuffle_hash").alias("w")
    met = (t.join(w, F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.thash") == F.col("w.thash")), "left")
           .select("t.doc_id", "t.thash", "t.text", "w.windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for data, windows in zip(utf8(b.column("text")), b.column("windows").to_pylist()):
                kept, removed, runs = without(data, [(x >> 12, x & 4095) for x in windows or ()])
                rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("thash"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                                             [*_KEY, *_OUT])

    result = met.mapInArrow(run, "doc_id bigint, thash bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return _copies(texts, result)


_OUT = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _copies(texts: DataFrame, result: DataFrame) -> DataFrame:
    """Of rows equal in id and text the first stays as it is; the others have come before, as far as they are long enough."""
    twice = keep(texts.groupBy(*_KEY).count().filter("count > 1"), "repeats-copies")
    if twice.isEmpty():
        return result.select("doc_id", *_OUT)
    rows, c = keep(result, "repeats-result").alias("r"), twice.alias("c")
    met = rows.join(c, F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("r.thash") == F.col("c.thash")), "left")
    single = met.filter("count is null").select("r.doc_id", *_OUT)
    first = met.filter("count is not null").groupBy("r.doc_id", "r.thash", *_OUT).agg(F.first("count").alias("n"))
    long = F.col("n_bytes") >= WINDOW
    gone = [F.col("n_bytes"), F.when(long, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(long, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
            F.when(long, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    later = first.withColumn("i", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select("doc_id", *gone)
    return single.unionByName(first.select("doc_id", *_OUT)).unionByName(later)
