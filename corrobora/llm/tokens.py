"""Token ids in Huffman-coded blocks.

Documents are encoded in ascending id order into blocks of whole documents. Ids are counted over everything, get
canonical Huffman codes of bounded length (package-merge), and each block is written on its own: payload, and the bit
offset of every ``LANE``-th token. A reader needs only the code lengths and one block; all lanes of a block are decoded
at once, each step looking up one table entry per lane.

Format: a folder with ``codebook`` (id, length; canonical: codes ascend by length, then id) and ``blocks`` (part, seq,
start: position of the first id among all; doc_ids, doc_sizes, n_tokens; payload: bits, most significant first;
lanes: little-endian uint32 bit offsets), ordered by (part, seq).

Defined cases: a null or empty text is the end id alone; a null id sorts first; rows with equal ids follow each other in
the order of their texts; an empty table gives an empty codebook and no blocks.
"""
from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corrobora.llm.common import keep, slices, texts_of

BLOCK = 131_072         # ids in a block at least, unless the part ends
LANE = 64               # ids between two bit offsets
LIMIT = 18              # longest code in bits, more if there are too many different ids
CACHE = 350_000         # words whose ids a worker remembers, and as many of before

BLOCKS = ("part int, seq int, start long, doc_ids array<long>, doc_sizes array<long>, n_tokens long, "
          "payload binary, lanes binary")
RUN = 256               # new words encoded in one call
_RAW = "part int, seq int, pos long, doc_ids array<long>, doc_sizes array<long>, ids binary"
_MARKS = (1 << 24) - 1     # places of marks for words that were seen
_OPENING = ("\u0120", "\u010a")      # how byte-level vocabularies write a space and a line end
_EDGE = re.compile(r"(?<=\S)([ \n])(?=\S)")
#: anything but single spaces and line ends between other characters; RE2's own \\s knows ASCII only
_OTHER_SPACE = "\\t\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_UNEVEN = f"[ \\n][ \\n]|^[ \\n]|[ \\n]$|[{_OTHER_SPACE}]"


class Encoder:
    """Ids of whole texts. This pre-tokeniser never joins text across a single space or line end between two other
    characters: a space opens the next piece, a line end is a piece of one id. So texts are cut there, each different
    word of a batch is looked up once, and a word's ids are remembered. Texts with other white space are cut at fewer places."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.of_text = Tokenizer.from_file(path)
        vocabulary = self.of_text.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for piece, i in vocabulary.items() if piece[:1] in _OPENING]] = True
        self.old: dict[str, bytes] = {}
        self.seen = np.zeros(_MARKS + 1, np.uint8)
        self.known: dict[str, bytes] = {}       # words after a space, which is theirs, or with the line end before them

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        uneven = np.asarray(pc.or_(pc.match_substring_regex(texts, _UNEVEN), pc.equal(pc.binary_length(texts), 0)))
        even = texts.filter(pa.array(~uneven))
        out: list = [None] * len(texts)
        for at, ids in zip(np.flatnonzero(~uneven).tolist(), self._even(even)):
            out[at] = ids
        for at in np.flatnonzero(uneven).tolist():
            out[at] = self._uneven(texts[at].as_py())
        return out

    def _even(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        begun = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        split = pc.split_pattern(begun, " ")
        words = split.flatten().dictionary_encode()
        flat, start, size = self._of_words(words.dictionary.to_pylist())
        code = np.asarray(words.indices)
        n = size[code]
        end = np.cumsum(n, dtype=np.int32)
        place = np.repeat(start[code] - (end - n), n)
        place += np.arange(len(place), dtype=np.int32)
        got = flat[place]
        bounds = np.r_[0, end][np.asarray(split.offsets)]
        return [got[lo + 1:hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]    # less the line end put before

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, where each word's ids start among them, how many they are)."""
        known, old, seen = self.known, self.old, self.seen
        if old:
            known.update((w, old[w]) for w in words if w in old and w not in known)
        got = list(map(known.get, words))
        fresh = np.array([ids is None for ids in got], bool)
        size = np.empty(len(words), np.int32)
        met = [ids for ids in got if ids is not None]
        size[~fresh] = np.fromiter(map(len, met), np.int32, len(met)) // 4
        new = [w for w, ids in zip(words, got) if ids is None]
        found, size[fresh] = self._fresh(new)
        start = np.empty(len(words), np.int32)              # a batch has less than 2^31 ids
        start[~fresh] = np.cumsum(size[~fresh], dtype=np.int32) - size[~fresh]
        end = np.cumsum(size[fresh], dtype=np.int32)
        at = end - size[fresh]
        mark = np.fromiter(map(hash, new), np.int64, len(new)) & _MARKS
        for i in np.flatnonzero(seen[mark]).tolist():       # a word is remembered from the second batch on that has it
            known[new[i]] = found[at[i]:end[i]].tobytes()
        seen[mark] = 1
        if len(known) > CACHE:                              # what isn't asked for again until the next time goes
            self.old, self.known = known, {}
        flat = np.frombuffer(b"".join(met), np.uint32)
        start[fresh] = len(flat) + at
        return np.concatenate([flat, found]), start, size

    def _fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one word after the other, how many each has). Words are encoded in runs, as a call costs more than a word:
        a word's first id is one that opens with a space or is a line end, and no other of its ids is. A run that doesn't
        come out so (marks the vocabulary takes whole, another kind of vocabulary) is encoded word by word."""
        texts = [w if w[:1] == "\n" else " " + w for w in words]
        flat, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int32)]
        runs = [texts[at:at + RUN] for at in range(0, len(texts), RUN)]
        for at in range(0, len(runs), 64):
            some = runs[at:at + 64]
            whole = self.of_text.encode_batch_fast(["".join(r) for r in some], add_special_tokens=False)
            for run, e in zip(some, whole):
                ids = np.array(e.ids, np.uint32)
                first = np.flatnonzero(self.opens[ids])
                if len(first) == len(run) and first[0] == 0:
                    size = np.diff(first, append=len(ids))
                else:
                    each = [x.ids for x in self.of_text.encode_batch_fast(run, add_special_tokens=False)]
                    ids = np.array([i for x in each for i in x], np.uint32)
                    size = np.fromiter(map(len, each), np.int32, len(each))
                flat.append(ids)
                sizes.append(size.astype(np.int32))
        return np.concatenate(flat), np.concatenate(sizes)

    def _uneven(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        first, *rest = _EDGE.split(text)
        parts = [first, *(a + b for a, b in zip(rest[::2], rest[1::2]))]
        found = self.of_text.encode_batch_fast(parts, add_special_tokens=False)
        return np.concatenate([np.array(e.ids, np.uint32) for e in found])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Give a worker's remembered words up. Named, so that tasks reach the worker's own module."""
    _encoders.clear()


# ---------------------------------------------------------------- encoding to raw blocks

def in_id_order(docs: DataFrame) -> DataFrame:
    """Partitions in ascending id order. A table whose partitions already hold separate id ranges isn't shuffled."""
    spans = docs.groupBy(F.spark_partition_id().alias("p")).agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    got = sorted((r for r in spans.collect()), key=lambda r: (r["lo"] is not None, r["lo"] or 0))
    apart = all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]) if a["hi"] is not None) and not any(r["nulls"] for r in got)
    dealt = docs if apart else docs.repartitionByRange("doc_id")
    return dealt.sortWithinPartitions("doc_id", "text")


def raw_blocks(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seq, pos, held, doc_ids = 0, 0, [], []

        def block_of():
            ids = np.concatenate(held) if held else np.empty(0, np.uint32)
            small = ids.astype(np.uint16) if not len(ids) or ids.max() < 65_536 else ids
            return ids, pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([pos], pa.int64()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([list(map(len, held))], pa.list_(pa.int64())),
                 pa.array([small.tobytes() if small.dtype == np.uint16 else b"4" + ids.tobytes()], pa.binary())],
                names=["part", "seq", "pos", "doc_ids", "doc_sizes", "ids"])
        size = 0
        for b in slices(batches, 4_000):
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1))):
                held.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(doc_id)
                size += len(ids) + 1
                if size >= block:
                    yield block_of()[1]
                    seq, pos, held, doc_ids, size = seq + 1, pos + size, [], [], 0
        if held:
            yield block_of()[1]
    return in_id_order(texts_of(docs)).mapInArrow(run, _RAW)


def _ids(raw: bytes) -> np.ndarray:
    """Two bytes an id; or, marked by an odd length, four."""
    return np.frombuffer(raw, np.uint16) if len(raw) % 2 == 0 else np.frombuffer(raw, np.uint32, offset=1)


def id_counts(raw: DataFrame) -> dict[int, int]:
    """How often each id stands in all blocks; as many rows as the vocabulary has ids at most."""
    def run(batches):
        forget()                                            # a worker that is used again needs its words no more
        total = np.zeros(0, np.int64)
        for b in slices(batches, 1):
            n = np.bincount(_ids(b.column(0)[0].as_py()))
            if len(n) > len(total):
                n[:len(total)] += total
                total = n
            else:
                total[:len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids].astype(np.int64))], names=["id", "n"])
    got = raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(got.column("id").to_pylist(), got.column("n").to_pylist()))


# ---------------------------------------------------------------- codes

def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits (package-merge)."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    n = len(ids)
    if n <= 1:
        return {i: 1 for i in ids}
    limit = max(limit, (n - 1).bit_length())
    leaves = [counts[i] for i in ids]
    is_leaf, merged = [], leaves
    marks = [[True] * n]
    for _ in range(limit - 1):
        pairs = [a + b for a, b in zip(merged[::2], merged[1::2])]
        both = list(heapq.merge(((w, False) for w in pairs), ((w, True) for w in leaves)))
        merged, is_leaf = [w for w, _ in both], [x for _, x in both]
        marks.append(is_leaf)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for mark in reversed(marks):
        own = sum(mark[:take])
        length[:own] += 1
        take = 2 * (take - own)
    return dict(zip(ids, length.tolist()))


class Codebook:
    def __init__(self, lengths: dict[int, int]):
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        self.top = max(lengths.values(), default=1)
        size = max(lengths, default=-1) + 1
        self.length, self.code = np.zeros(size, np.int32), np.zeros(size, np.uint64)
        self.symbol, self.bits = np.zeros(1 << self.top, np.uint32), np.zeros(1 << self.top, np.int64)
        code, last = 0, 0
        for i in order:
            n = lengths[i]
            code <<= n - last
            last = n
            self.length[i], self.code[i] = n, code
            low = code << (self.top - n)
            self.symbol[low:low + (1 << (self.top - n))] = i
            self.bits[low:low + (1 << (self.top - n))] = n
            code += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(payload, lanes)."""
        n = self.length[ids]
        end = np.cumsum(n, dtype=np.int32 if len(ids) * self.top < 1 << 31 else np.int64)
        start = end - n
        word = start >> 5
        both = self.code[ids] << (64 - n - (start & 31)).astype(np.uint64)
        out = np.zeros(int(end[-1] + 31 >> 5) + 1 if len(end) else 0, np.uint64)
        if len(end):
            cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[cut]] += np.add.reduceat(both >> np.uint64(32), cut)
            out[word[cut] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), cut)
        total = int(end[-1] + 7 >> 3) if len(end) else 0
        return out.astype(">u4").tobytes()[:total], start[::LANE].astype("<u4").tobytes()

    def decode(self, payload: bytes, lanes: bytes, n: int) -> np.ndarray:
        raw = np.frombuffer(payload + b"\0" * (12 - len(payload) % 4), ">u4").astype(np.uint64)
        windows = raw[:-1] << np.uint64(32) | raw[1:]
        at = np.frombuffer(lanes, "<u4").astype(np.int64)
        out = np.zeros((len(at), LANE), np.uint32)
        live = np.minimum(LANE, n - np.arange(len(at)) * LANE)
        mask, top = np.uint64((1 << self.top) - 1), np.uint64(64 - self.top)
        for step in range(LANE):
            if step and len(live) and live[-1] <= step:       # only the last lane can be short
                at, live = at[:-1], live[:-1]
            here = windows[at >> 5] >> (top - (at & 31).astype(np.uint64)) & mask
            out[:len(at), step] = self.symbol[here]
            at = at + self.bits[here]
        return out.reshape(-1)[:n]


# ---------------------------------------------------------------- files

def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, limit: int = LIMIT, block: int = BLOCK) -> None:
    """Encode all documents and write codebook and blocks under ``path``."""
    spark = docs.sparkSession
    raw = keep(raw_blocks(docs, tokenizer, end_id, block), "raw-blocks")
    lengths = code_lengths(id_counts(raw), limit)
    rows = [(int(i), int(n)) for i, n in lengths.items()]
    spark.createDataFrame(rows, "id long, length int").coalesce(1).sortWithinPartitions("length", "id").write.parquet(f"{path}/codebook")
    sizes = raw.groupBy("part").agg(F.sum(F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"),
                                    F.min(F.get("doc_ids", 0)).alias("first")).collect()
    starts, at = {}, 0                                        # parts: as many as the table has partitions
    for r in sorted(sizes, key=lambda r: (r["first"] is not None, r["first"] or 0, r["part"])):
        starts[r["part"]] = at
        at += r["n"]
    shared = spark.sparkContext.broadcast((lengths, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()                                            # a worker that is used again needs its words no more
        lengths, starts = shared.value
        book = Codebook(lengths)
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            ids = _ids(row["ids"])
            payload, lanes = book.encode(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([starts[row["part"]] + row["pos"]], pa.int64()), b.column(3), b.column(4),
                 pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary()), pa.array([lanes], pa.binary())],
                names=["part", "seq", "start", "doc_ids", "doc_sizes", "n_tokens", "payload", "lanes"])
    (raw.mapInArrow(run, BLOCKS).sortWithinPartitions("start").write.option("compression", "none").parquet(f"{path}/blocks"))


def read_codebook(spark: SparkSession, path: str) -> dict[int, int]:
    return {r["id"]: r["length"] for r in spark.read.parquet(f"{path}/codebook").collect()}


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of int): every document as the files hold it."""
    return _decoded(spark, path, "doc_id long, start long, ids array<int>", lambda ids, size, cut: pa.ListArray.from_arrays(
        pa.array(np.r_[0, cut].astype(np.int32)), pa.array(ids.astype(np.int32))), "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: as read_tokens, with a checksum in place of the ids."""
    def crc(ids, size, cut):
        raw = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * (e - n):4 * e]) for n, e in zip(size.tolist(), cut.tolist())], pa.int64())
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", crc, "ids_crc32")


def _decoded(spark, path, schema, value, name):
    shared = spark.sparkContext.broadcast(read_codebook(spark, path))
    with_size = "n_tokens long" in schema

    def run(batches):
        book = Codebook(shared.value)
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            ids = book.decode(row["payload"], row["lanes"], row["n_tokens"])
            size = np.array(row["doc_sizes"], np.int64)
            cut = np.cumsum(size)
            cols = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["start"] + cut - size)}
            if with_size:
                cols["n_tokens"] = pa.array(size)
            yield pa.RecordBatch.from_pydict(cols | {name: value(ids, size, cut)})
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, schema)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs to a folder of the shared space and return the digests read back from its files."""
    from corrobora.session import scratch_path
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_digests(docs.sparkSession, path)
