"""Class-based bigram language model (exchange clustering) over whole tables.

Texts are taken apart once, into blocks: each block has its own word list and the documents as numbers into it. Counts
of all training tokens come back to a block as one number for each word of its list, so no table of (document, word)
pairs is ever built. Words that make up at least 1 / FREQUENT of all tokens (so there are FREQUENT of them at most) are
clustered by exchange: each moves to the class where the class bigrams become likeliest, until few moves are left. In a
flat vocabulary the share is lowered until there are as many of these seeds as classes. All other words of LEAST training
occurrences and more then join a class by the same criterion: the classes of their neighbours are counted block by block,
brought together by word, and one task decides for a word, so what is clustered grows with the vocabulary. Rarer words form
a class for each power of two of their count; the end of a text has a class of its own. An unseen word takes the place of
words seen once, each of which was unseen before.

    P(word | last) = P(class | last class) * P(word | class)

Transitions are smoothed by the classes' own frequencies as often as a class has different followers (Witten-Bell);
emissions are shares of a class's tokens. The probabilities of all known words, the end and one unseen word sum to one.

Defined cases: null and empty texts are the end token alone; a null id counts as the empty text in the split; repeated
rows count as often as they stand; without training tokens every token is the unseen word, with probability one.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corrobora.llm.common import crc_mod_py, discard, keep, slices, texts_of, utf8

BLOCK = 16_000_000      # bytes of text in a block, about
FREQUENT = 2_048
LEAST = 5               # training occurrences of a word that joins a class by its neighbours
CLASSES = 64
SWEEPS = 6
BANDS = 64              # powers of two of a count
WORD_BITS = 27          # of a word's place in its block, within its key; 36 are left for the block

_BLOCKS = ("block long, doc_ids array<long>, held array<boolean>, sizes array<int>, codes binary, "
           "words array<binary>, counts array<long>")


# ---------------------------------------------------------------- texts to blocks

def blocks_of(docs: DataFrame, fold: int, held_out: int, size: int = BLOCK) -> DataFrame:
    """Documents as numbers into the word list of their block; word 0 is the end token (no bytes). ``counts``: how often
    each word stands in training documents, those whose crc32(doc_id) mod ``fold`` is not ``held_out``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        if part >= 1 << 20:
            raise OverflowError("partitions of a block number")

        def fresh():
            number: dict[bytes, int] = defaultdict(count(1).__next__)       # an unknown word takes the next number
            number[b""] = 0
            return number, [], [], [], 0
        number, ids, held, codes, taken = fresh()

        def done():
            if seq >= 1 << 16 or len(number) > 1 << WORD_BITS:
                raise OverflowError("blocks of a partition or words of a block")
            sizes = np.fromiter(map(len, codes), np.int32, len(codes))
            flat = np.concatenate(codes)
            training = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(flat[training], minlength=len(number))
            narrow = flat.astype(np.uint16) if len(number) <= 65_536 else flat
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 16) + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([sizes], pa.list_(pa.int32())), pa.array([narrow.tobytes()], pa.binary()),
                 pa.array([list(number)], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))],
                names=["block", "doc_ids", "held", "sizes", "codes", "words", "counts"])
        for b in slices(batches, 500):
            for doc_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                words = text.lower().split()                # bytes: A-Z only; splits at \x20 and \x09-\x0D only
                words.append(b"")
                ids.append(doc_id)
                held.append(crc_mod_py(doc_id, fold) == held_out)
                codes.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                taken += len(text) + 1
                if taken >= size:
                    yield done()
                    seq += 1
                    number, ids, held, codes, taken = fresh()
        if ids:
            yield done()
    return texts_of(docs).mapInArrow(run, _BLOCKS)


def _codes(raw: bytes, tokens: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * tokens else np.uint32)


def with_counts(blocks: DataFrame, least: float, some: int = LEAST) -> DataFrame:
    """Blocks with the count of each word over all training documents, in the order of the word list (int64), and the
    words whose count is at least ``least`` with their places; ``n_known``: known words that no earlier block has; ``keys``:
    of each word with a count of ``some`` and more the number of its first place, the same in all blocks. A word has one row
    for each block that holds it."""
    place = F.shiftleft("block", WORD_BITS) + F.col("code")      # block and place of a word as one number: half the width to ship
    rows = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "x")).select(
        place.alias("own"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    of_word = Window.partitionBy("word")
    known = rows.select("own", "word", F.sum("n").over(of_word).alias("c"), F.min("own").over(of_word).alias("key"))
    ends = F.col("own").bitwiseAND(F.lit((1 << WORD_BITS) - 1).cast("long")) == 0
    ordered = (known.select("own", (2 * F.col("c") + (F.col("key") == F.col("own")).cast("long")).alias("c"),
                            F.when((F.col("c") >= least) & ~ends, F.col("word")).alias("word"), F.when((F.col("c") >= some) & ~ends, F.col("key")).alias("key"))
               .repartition(F.shiftright("own", WORD_BITS)).sortWithinPartitions("own"))

    def pack(batches):
        at, counts, places, words, known, keys = None, [], [], [], 0, []

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([np.concatenate(counts).tobytes()], pa.binary()),
                 pa.array([places], pa.list_(pa.int32())), pa.array([words], pa.list_(pa.binary())), pa.array([known], pa.int64()),
                 pa.array([np.concatenate(keys).tobytes()], pa.binary())],
                names=["block", "counts", "places", "frequent", "n_known", "keys"])
        for b in batches:
            own, c = np.asarray(b.column(0)), np.asarray(b.column(1))
            ids, code, first, c = own >> WORD_BITS, own & ((1 << WORD_BITS) - 1), c & 1, c >> 1
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(ids)]):
                if hi <= lo:
                    continue
                if at is not None and ids[lo] != at:
                    yield done()
                    counts, places, words, known, keys = [], [], [], 0, []
                at = int(ids[lo])
                counts.append(c[lo:hi])
                known += int(first[lo:hi][c[lo:hi] > 0].sum())
                keys.append(np.asarray(b.column(3).slice(lo, hi - lo).drop_null(), np.int64))
                top = b.column(2).slice(lo, hi - lo)
                where = np.flatnonzero(np.asarray(top.is_valid()))
                if len(where):
                    places += code[lo:hi][where].tolist()
                    words += top.take(pa.array(where)).to_pylist()
        if at is not None:
            yield done()
    packed = ordered.mapInArrow(pack, "block long, counts binary, places array<int>, frequent array<binary>, n_known long, keys binary")
    own = blocks.select("block", "doc_ids", "held", "sizes", "codes")
    return own.join(packed.hint("shuffle_hash"), "block").select("block", "doc_ids", "held", "sizes", "codes", "counts", "places", "frequent", "n_known", "keys")


# ---------------------------------------------------------------- states: end, frequent words, bands of counts, unseen

def _band(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(np.float64))[1] - 1            # of 1: 0; of 2 and 3: 1; ...


def _word_states(row: dict, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """State and count of each word of a block. States: 0 end, then frequent words, BANDS bands, unseen."""
    c, f = np.frombuffer(row["counts"], np.int64), len(number)
    state = np.where(c > 0, 1 + f + _band(np.maximum(c, 1)), 1 + f + BANDS)
    for at, w in zip(row["places"], row["frequent"]):
        if bytes(w) in number:
            state[at] = 1 + number[bytes(w)]
    state[0] = 0
    return state, c


def _states(row: dict, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state of each token, sizes, held) of a block."""
    sizes, held = np.array(row["sizes"], np.int64), np.array(row["held"], bool)
    return _word_states(row, number)[0][_codes(row["codes"], int(sizes.sum()))], sizes, held


def _loose(state: np.ndarray, c: np.ndarray, f: int, some: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of a block with a key that aren't among the frequent ones: which of the keys, and their codes."""
    keyed = np.flatnonzero(c >= some)
    keyed = keyed[keyed > 0]
    own = np.flatnonzero(state[keyed] > f)
    return own, keyed[own]


def _word_classes(row: dict, number: dict[bytes, int], of: np.ndarray, some: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and count of each word of a block; ``joined`` holds the classes of the loose ones."""
    state, c = _word_states(row, number)
    k = of[state]
    if row["joined"]:
        k[_loose(state, c, len(number), some)[1]] = np.frombuffer(row["joined"], np.uint16)
    return k, c


def transitions(ready: DataFrame, number: dict[bytes, int]) -> np.ndarray:
    """Counts of all two states that follow each other in training documents. Bounded: FREQUENT + BANDS + 1 states."""
    n = 1 + len(number) + BANDS
    shared = ready.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        total = np.zeros(n * n, np.int64)
        for b in slices(batches, 1):
            states, sizes, held = _states(b.to_pylist()[0], shared.value)
            ends = np.cumsum(sizes)
            last = np.r_[0, states[:-1]]
            last[ends[:-1]] = 0                             # a text begins after an end
            use = np.repeat(~held, sizes)
            total += np.bincount(last[use] * n + states[use], minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // n).astype(np.int32)), pa.array((at % n).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])
    got = (ready.select("doc_ids", "held", "sizes", "codes", "counts", "places", "frequent").mapInArrow(run, "a int, b int, n long")
           .groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros((n, n), np.int64)
    out[got.column("a").to_numpy(), got.column("b").to_numpy()] = got.column("n").to_numpy()
    return out


# ---------------------------------------------------------------- exchange clustering

def _phi(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(w: np.ndarray, movable: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each state. w: bigram counts; states that aren't movable keep a class of their own. Each move goes to the
    class with the likeliest class bigrams: the sum of n log n over pairs, less that over both margins."""
    n, w = len(w), w.astype(np.float64)
    of = np.zeros(n, np.int64)
    moving = np.flatnonzero(movable)
    moving = moving[np.argsort(-w[moving].sum(1), kind="stable")]
    c = min(classes, max(1, len(moving)))
    of[moving] = np.arange(len(moving)) % c
    fixed = np.flatnonzero(~movable)
    of[fixed] = c + np.arange(len(fixed))
    k = c + len(fixed)
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    right, left = w @ member, (member.T @ w).T              # from a state to classes, from classes to a state
    g = member.T @ right
    for _ in range(sweeps):
        moves = 0
        for s in moving:
            own, self_n = of[s], w[s, s]
            r, q = right[s].copy(), left[s].copy()
            r[own] -= self_n
            q[own] -= self_n
            g[own] -= r
            g[:, own] -= q
            g[own, own] -= self_n
            out, into, diag = g.sum(1), g.sum(0), np.diag(g)
            a, b = _phi(g + r) - _phi(g), _phi(g.T + q) - _phi(g.T)
            both = r + q + self_n
            gain = (a.sum(1) - np.diag(a) + b.sum(1) - np.diag(b) + _phi(diag + both) - _phi(diag)
                    - _phi(out + r.sum() + self_n) + _phi(out) - _phi(into + q.sum() + self_n) + _phi(into))[:c]
            new = int(gain.argmax())
            if gain[new] <= gain[own] + 1e-9:
                new = own
            g[new] += r
            g[:, new] += q
            g[new, new] += self_n
            if new != own:
                moves += 1
                of[s] = new
                right[:, own] -= w[:, s]
                right[:, new] += w[:, s]
                left[:, own] -= w[s]
                left[:, new] += w[s]
        if moves <= len(moving) // 200:
            break
    return of


# ---------------------------------------------------------------- the other words

def gains(g: np.ndarray, r: np.ndarray, q: np.ndarray, self_n: np.ndarray, own: np.ndarray, c: int) -> np.ndarray:
    """Of many words at once, the gain in each of the first c classes, as ``exchange`` has it: each word alone is taken out
    of its own class. g: class bigrams; r, q: how often a class follows and precedes the word, without the word itself."""
    n, diag = len(r), np.diag(g)[:c].copy()
    out = np.zeros((n, c))
    for m, counts, back in ((g, r, q), (g.T, q, r)):
        i, j = np.nonzero(counts)
        if not len(i):
            continue
        v = counts[i, j]
        base = m[:c, j].T.copy()
        home = np.flatnonzero(j == own[i])
        base[home] -= back[i[home], :c]
        inner = np.flatnonzero(own[i] < c)
        base[inner, own[i[inner]]] -= v[inner]
        x = _phi(base + v[:, None]) - _phi(base)
        square = np.flatnonzero(j < c)
        x[square, j[square]] = 0                            # the diagonal is counted once, below
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        out[i[starts]] += np.add.reduceat(x, starts)
    rows = np.flatnonzero(own < c)
    both = r[:, :c] + q[:, :c] + self_n[:, None]
    here = np.repeat(diag[None], n, 0)
    here[rows, own[rows]] -= both[rows, own[rows]]
    out += _phi(here + both) - _phi(here)
    for m, total in ((g.sum(1), r.sum(1) + self_n), (g.sum(0), q.sum(1) + self_n)):
        margin = np.repeat(m[None, :c], n, 0)
        margin[rows, own[rows]] -= total[rows]
        out += _phi(margin) - _phi(margin + total[:, None])
    return out


def _near(k: int) -> np.dtype:
    """A place, and a count of at most 255: larger ones stand in several pieces."""
    return np.dtype([("at", "u1" if k < 128 else "<u2"), ("n", "u1")])


def neighbours(ready: DataFrame, number: dict[bytes, int], of: np.ndarray, some: int) -> DataFrame:
    """key, block, code of every loose word of a block, and near: how often a class follows it in training documents (places
    from 0), precedes it (from k) and how often it follows itself (2 k)."""
    k = int(of[-1])
    shared = ready.sparkSession.sparkContext.broadcast((number, of))

    def run(batches):
        number, of = shared.value
        width = 2 * k + 1
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            state, c = _word_states(row, number)
            which, loose = _loose(state, c, len(number), some)
            if not len(loose):
                continue
            sizes, held = np.array(row["sizes"], np.int64), np.array(row["held"], bool)
            use = np.repeat(~held, sizes)
            codes = _codes(row["codes"], int(sizes.sum()))
            last, codes = np.r_[0, codes[:-1]][use], codes[use]     # every text ends with word 0
            place, cls = np.full(len(c), -1, np.int64), of[state].astype(np.int64)
            place[loose] = np.arange(len(loose))
            a, z, same = place[last], place[codes], last == codes
            right = a * width + np.where(same, 2 * k, cls[codes])
            left = z * width + k + cls[last]
            flat, n = np.unique(np.concatenate([right[a >= 0], left[(z >= 0) & ~same]]), return_counts=True)
            pieces = -(-n // 255)
            flat, left = np.repeat(flat, pieces), np.repeat(n, pieces) - 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            near = np.empty(len(flat), _near(k))
            near["at"], near["n"] = flat % width, np.minimum(left, 255)
            cuts = (np.searchsorted(flat, np.arange(len(loose) + 1) * width) * near.itemsize).astype(np.int32)
            whole = pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(row["keys"], np.int64)[which]), pa.array(np.full(len(loose), row["block"], np.int64)), pa.array(loose.astype(np.int32)),
                 pa.Array.from_buffers(pa.binary(), len(loose), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(near.tobytes())])],
                names=["key", "block", "code", "near"])
            yield from slices([whole], 10_000)
    own = ready.select("block", "held", "sizes", "codes", "counts", "places", "frequent", "keys")
    return own.mapInArrow(run, "key long, block long, code int, near binary")


def joined(rows: DataFrame, g: np.ndarray, of: np.ndarray, f: int, c: int) -> DataFrame:
    """rows: of ``neighbours``. block, and the classes that its loose words join, in their order (uint16)."""
    k = len(g)
    shared = rows.sparkSession.sparkContext.broadcast((g.astype(np.float64), of))

    def decide(rows: pa.Table) -> pa.RecordBatch:
        g, of = shared.value
        keys = rows.column(0).to_numpy()
        word = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
        near = rows.column(3).to_pylist()
        flat = np.frombuffer(b"".join(near), _near(k))
        owner = np.repeat(word, [len(x) // flat.itemsize for x in near])
        dense = np.bincount(owner * (2 * k + 1) + flat["at"], flat["n"], (word[-1] + 1) * (2 * k + 1)).reshape(-1, 2 * k + 1)
        r, q, self_n = dense[:, :k], dense[:, k:2 * k], dense[:, 2 * k]
        own = of[1 + f + _band(r.sum(1) + self_n)]          # all training tokens of a word have a follower
        best = np.concatenate([gains(g, r[i:i + 500], q[i:i + 500], self_n[i:i + 500], own[i:i + 500], c).argmax(1) for i in range(0, len(r), 500)])
        return pa.RecordBatch.from_arrays([rows.column(1).combine_chunks(), rows.column(2).combine_chunks(), pa.array(best[word].astype(np.int32))], names=["block", "code", "class"])

    def run(batches):
        rest: list[pa.RecordBatch] = []
        for b in batches:
            keys = b.column(0).to_numpy()
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))      # the last word may go on
            if cut or rest and rest[-1].column(0)[-1].as_py() != keys[0]:
                yield decide(pa.Table.from_batches([*rest, b.slice(0, cut)]))
                rest = []
            rest.append(b.slice(cut))
        if rest:
            yield decide(pa.Table.from_batches(rest))

    def pack(batches):
        at, parts = None, []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.concatenate(parts).astype(np.uint16).tobytes()], pa.binary())], names=["block", "joined"])
        for b in batches:
            ids, cls = b.column(0).to_numpy(), b.column(2).to_numpy()
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(ids)]):
                if hi <= lo:
                    continue
                if at is not None and ids[lo] != at:
                    yield done()
                    parts = []
                at = int(ids[lo])
                parts.append(cls[lo:hi])
        if at is not None:
            yield done()
    own = rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "block long, code int, class int")
    return own.repartition("block").sortWithinPartitions("block", "code").mapInArrow(pack, "block long, joined binary")


def class_bigrams(ready: DataFrame, number: dict[bytes, int], of: np.ndarray, k: int, some: int) -> np.ndarray:
    """Counts of all two classes that follow each other in training documents."""
    shared = ready.sparkSession.sparkContext.broadcast((number, of))

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            sizes, held = np.array(row["sizes"], np.int64), np.array(row["held"], bool)
            cls = _word_classes(row, *shared.value, some)[0].astype(np.int64)[_codes(row["codes"], int(sizes.sum()))]
            use = np.repeat(~held, sizes)
            total += np.bincount((np.r_[shared.value[1][0], cls[:-1]] * k + cls)[use], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // k).astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])
    got = ready.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((k, k), np.int64)
    out[got.column("a").to_numpy(), got.column("b").to_numpy()] = got.column("n").to_numpy()
    return out


# ---------------------------------------------------------------- the model

@dataclass
class Model:
    number: dict[bytes, int]        # frequent words
    of: np.ndarray                  # class of each state, the unseen one last
    log_next: np.ndarray            # log10 P(class | class)
    log_all: np.ndarray             # log10 of each class's tokens
    tokens: int
    words: int

    def log_probability(self, k: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 P of each token, of class k; first: places where a text begins."""
        last = np.r_[self.of[0], k[:-1]]
        last[first] = self.of[0]
        unseen = counts == 0
        return self.log_next[last, k] + np.where(unseen, 0.0, np.log10(np.maximum(counts, 1)) - self.log_all[k])


def cluster(w: np.ndarray, number: dict[bytes, int], classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray, int]:
    """Class of each state (the unseen one last), the class bigrams, and how many classes hold frequent words."""
    n = len(w)
    used = np.union1d(np.flatnonzero((w.sum(0) + w.sum(1)) > 0), [0])
    movable = (used >= 1) & (used <= len(number))
    own = exchange(w[np.ix_(used, used)], movable, classes)
    k = int(own.max()) + 1
    g = np.zeros((k, k))
    np.add.at(g, (own[:, None], own[None, :]), w[np.ix_(used, used)])
    of = np.full(n + 1, k)
    of[used] = own
    return of, g, min(classes, max(1, int(movable.sum())))


def smoothed(of: np.ndarray, bigrams: np.ndarray, number: dict[bytes, int], tokens: int, words: int) -> Model:
    k, once = len(bigrams), int(of[1 + len(number)])
    g = np.zeros((k + 1, k + 1))                            # the last class: unseen
    g[:k, :k] = bigrams
    totals = g.sum(0)[:k].copy()
    if once < k:                                            # as words seen once, before and after others
        g[:, k] = g[:, once]
        g[k, :] = g[once, :]
    share = np.where(g.sum(0) + g.sum(1) > 0, g.sum(0) + 0.5, 0.0)      # a class that all words left is no follower
    share[k] = g[:, k].sum() + 0.5
    share /= share.sum()
    followers = (g > 0).sum(1) + 1.0
    nxt = (g + followers[:, None] * share) / (g.sum(1) + followers)[:, None]
    if not tokens:
        nxt[:, :] = 0.0
        nxt[:, k] = 1.0
    return Model(number, of, np.log10(np.maximum(nxt, 1e-300)), np.log10(np.maximum(np.r_[totals, 1.0], 1.0)), tokens, words)


def fit(w: np.ndarray, number: dict[bytes, int], tokens: int, words: int, classes: int = CLASSES) -> Model:
    """The model of frequent words and bands alone."""
    of, g, _ = cluster(w, number, classes)
    return smoothed(of, g, number, tokens, words)


# ---------------------------------------------------------------- the operator

def _scores(ready: DataFrame, model: Model, some: int) -> DataFrame:
    shared = ready.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            sizes, held = np.array(row["sizes"], np.int64), np.array(row["held"], bool)
            codes = _codes(row["codes"], int(sizes.sum()))
            k, c = (x[codes] for x in _word_classes(row, m.number, m.of, some))
            if not m.tokens:                                # without training even the end is unseen
                k = np.full_like(k, m.of[-1])
            first = np.cumsum(sizes) - sizes
            base = np.log10((c + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
            total = lambda x: np.add.reduceat(x, first)
            score = total(m.log_probability(k, c, first))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(sizes),
                "n_known": pa.array(total((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(sizes), m.tokens, np.int64)),
                "base_score": pa.array(total(base)), "score": pa.array(score), "perplexity": pa.array(10 ** np.minimum(300, -score / sizes))})
    return ready.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def seeds_of(ready: DataFrame, most: int) -> list[bytes]:
    """The words that with_counts names, or the ``most`` most frequent of them, in order."""
    def run(batches):
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            yield pa.RecordBatch.from_arrays([pa.array(row["frequent"], pa.binary()), pa.array(np.frombuffer(row["counts"], np.int64)[row["places"]] if row["places"] else [], pa.int64())], names=["w", "c"])
    words = ready.select("frequent", "places", "counts").mapInArrow(run, "w binary, c long").distinct()
    return sorted(bytes(r["w"]) for r in words.orderBy(F.desc("c"), "w").limit(most).collect())


def class_model_scores(docs: DataFrame, fold: int = 5, held_out: int = 1, block: int = BLOCK, frequent: int = FREQUENT,
                       classes: int = CLASSES, some: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score, perplexity of every row."""
    blocks = keep(blocks_of(docs, fold, held_out, block), "blocks")
    tokens = blocks.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    least = max(1.0, tokens / frequent)
    while True:
        ready = keep(with_counts(blocks, least, some), "counted-blocks")
        top = seeds_of(ready, frequent)
        if len(top) >= min(classes, frequent) or least <= some:
            break
        discard(ready)
        least = max(float(some), least / 8)                 # no word stands out: fewer occurrences make a seed
    discard(blocks)                                         # the counted ones hold all of them
    words = ready.agg(F.sum("n_known")).first()[0] or 0
    number = {w: i for i, w in enumerate(top)}
    of, g, c = cluster(transitions(ready, number), number, classes)
    own = ready.select("block", "doc_ids", "held", "sizes", "codes", "counts", "places", "frequent")
    more = joined(neighbours(ready, number, of, some), g, of, len(number), c)
    classed = keep(own.join(more.hint("shuffle_hash"), "block", "left"), "classed-blocks")
    discard(ready)
    ready = classed
    model = smoothed(of, class_bigrams(ready, number, of, len(g), some), number, int(tokens), int(words))
    return _scores(ready, model, some)
