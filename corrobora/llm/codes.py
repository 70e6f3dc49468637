"""Short codes of vectors: one codebook for each of 16 parts, learned by member-resident Lloyd.

Rows of the working table are parts, (position, entry, salt, components), partitioned by (position, entry, salt): a
partition owns what it holds. In a round the owners add up their resident members, only these sums travel, and every
member is then held against the new codebook where it lies. A part whose entry stays is not touched again; only parts
that change entry go through the next shuffle, to their new owner. The salt keeps an owner at OWNER parts even if all
vectors share an entry. The codebook is 64 x dimension integers, whatever the table holds. Vectors are coded in a last
pass that ships nothing.

All arithmetic is on integers and exact: floor(256 * x) is held to the range of a long, sums are decimals, distances are
taken in doubles only while every term stays under 2^53. An error beyond a long is the largest long.

Defined cases: vectors that are null, empty, or hold null or non-finite components are dropped, and so are vectors of
another length than the most common one (ties: the longer). Rows of one id count each; first entries are taken by id,
then by components, rows without an id last. Fewer rows than entries give fewer entries. A length that 16 does not
divide is cut at floor(length * i / 16); a part without components has code 0. Labels compare as equal if both are null.
An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.common import keep, slices
from corrobora.session import ship, small_side

PARTS = 16
ENTRIES = 64
ROUNDS = 2
OWNER = 4_096           # parts that one (position, entry, salt) holds, about
LARGEST = 2 ** 63 - 1

Books = list[np.ndarray]        # for each position: entries x components


def usable(v: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    d = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def whole(column: pa.Array) -> np.ndarray:
    """floor(256 * x) of equally long vectors, one row each."""
    with np.errstate(over="ignore"):
        x = np.floor(256.0 * np.asarray(column.flatten(), np.float64).reshape(len(column), -1))
    out = np.clip(x, -2.0 ** 63, 2.0 ** 62).astype(np.int64)
    large = x > 2.0 ** 62
    if large.any():
        out[large] = [min(int(v), LARGEST) if v < np.inf else LARGEST for v in x[large]]
    return out


def cuts(dim: int, parts: int = PARTS) -> list[int]:
    return [dim * i // parts for i in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """Index of the nearest entry of every row (ties: the lowest) and its squared distance."""
    width = x.shape[1]
    if not width:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    most = max(int(np.abs(a.astype(np.float64)).max(initial=0)) for a in (x, book)) + 1
    if 4 * most * most * width < 2 ** 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    else:
        a, b = (x, book) if 4 * most * most * width < 2 ** 62 else (x.astype(object), book.astype(object))
        d = sum((a[:, i, None] - b[None, :, i]) ** 2 for i in range(width))
    at = np.argmin(d, axis=1)
    found = d[np.arange(len(x)), at]
    return at, found.astype(np.int64) if found.dtype != object else found


# ---------------------------------------------------------------- rounds

def first_entries(kept: DataFrame, dim: int, entries: int, parts: int) -> Books:
    """The parts of the rows with the smallest ids, ascending."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    x = whole(rows.column("v").combine_chunks())
    return [x[:, a:b] for a, b in zip(cuts(dim, parts), cuts(dim, parts)[1:])]


def _integers(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), pa.int64()))


def _rows(pos, was, entry, salt, x: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    short = [pa.array(np.broadcast_to(np.asarray(a), n).astype(np.int32)) for a in (pos, was, entry, salt)]
    return pa.RecordBatch.from_arrays([*short, _integers(x)], ["pos", "was", "entry", "salt", "x"])


_STATE = "pos int, was int, entry int, salt int, x array<bigint>"


def placed(kept: DataFrame, books: Books, salts: int) -> DataFrame:
    """Every part with its first entry, at its owner."""
    edges = np.cumsum([0] + [b.shape[1] for b in books]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in slices(batches):
            x = whole(b.column("v"))
            salt = (seen + np.arange(len(x))) % salts
            seen += len(x)
            for pos, book in enumerate(books):
                part = x[:, edges[pos]:edges[pos + 1]]
                entry = nearest(part, book)[0]
                yield _rows(pos, entry, entry, salt, part)

    return keep(kept.select("v").mapInArrow(run, _STATE).repartition("pos", "entry", "salt"), "codes-home")


def updated(home: DataFrame, books: Books) -> Books:
    """Each entry becomes the floor of its members' mean; owners add up, their sums meet."""
    width = max(b.shape[1] for b in books)
    sums = home.groupBy("pos", "entry").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for r in sums.collect():                                            # at most PARTS x ENTRIES rows
        out[r["pos"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(out[r["pos"]].shape[1])]
    return out


def moved(home: DataFrame, books: Books) -> DataFrame:
    """Members against the new entries, where they lie: those that stay are read in place, the others change owner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, entry, salt = (np.asarray(b.column(c)) for c in ("pos", "entry", "salt"))
            for p in np.unique(pos):
                rows = np.flatnonzero(pos == p)
                x = np.asarray(b.column("x").take(pa.array(rows)).flatten(), np.int64).reshape(len(rows), -1)
                yield _rows(p, entry[rows], nearest(x, books[p])[0], salt[rows], x)

    seen = keep(home.mapInArrow(run, _STATE), "codes-seen")
    return seen.filter("entry = was").union(keep(seen.filter("entry <> was").repartition("pos", "entry", "salt"), "codes-moved"))


def fit(kept: DataFrame, dim: int, n: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, owner: int = OWNER) -> Books:
    """Codebooks of kept (id, v), n rows of one length."""
    books = first_entries(kept, dim, entries, parts)
    home = placed(kept, books, -(-n // owner)) if rounds else None
    for left in range(rounds, 0, -1):
        books = updated(home, books)
        if left > 1:
            home = moved(home, books)
    return books


# ---------------------------------------------------------------- codes

def coded(kept: DataFrame, books: Books) -> DataFrame:
    """kept and for each row code and error; nothing is shipped."""
    edges = np.cumsum([0] + [b.shape[1] for b in books]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = whole(b.column("v"))
            found = [nearest(x[:, edges[i]:edges[i + 1]], book) for i, book in enumerate(books)]
            digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
            error = [min(LARGEST, sum(int(f[1][i]) for f in found)) for i in range(len(x))]
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([digits[i * step:(i + 1) * step] for i in range(len(x))], pa.string()),
                                              pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    return kept.select("id", "label", "v").mapInArrow(run, f"id bigint, label {kind}, code string, error bigint")


def digest(books: Books) -> str:
    """sha256 of all entries' components in decimal digits: by part, entry, position."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def codebook_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
                   entries: int = ENTRIES, rounds: int = ROUNDS, owner: int = OWNER) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector. At most 256 entries."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors[vector_col]
    named = vectors.filter(usable(v)).select(vectors[id_col].cast("long").alias("id"), v.cast("array<double>").alias("v"), vectors[label_col].alias("label"))
    lengths = named.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dim, n = lengths[0]
    kept = named.filter(F.size("v") == dim)
    books = fit(kept, dim, n, parts, entries, rounds, owner)
    rows = keep(coded(kept, books), "codes")
    totals = small_side(rows.groupBy(F.col("label").alias("__label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error")))
    return rows.join(totals, rows["label"].eqNullSafe(totals["__label"])).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The query in DuckDB SQL: two rounds spelled out, as recursion cannot aggregate."""
    d = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    out = ["""WITH kept AS (
 SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, q.pos, v[(len(v) * q.pos) // 16 + 1 : (len(v) * (q.pos + 1)) // 16] AS x FROM kept, (SELECT unnest(range(16)) AS pos) q),
b0 AS (SELECT pos, r AS e, x FROM parts WHERE r < 64)"""]
    for i in range(ROUNDS + 1):
        out.append(f"a{i} AS (SELECT p.r, p.pos, any_value(p.x) AS x, min({d} * 64 + b.e) AS best FROM parts p JOIN b{i} b ON p.pos = b.pos GROUP BY p.r, p.pos)")
        if i < ROUNDS:
            out.append(f"""s{i} AS (SELECT pos, e, i, floor(sum(c) / count(*))::BIGINT AS m FROM (
  SELECT pos, (best % 64)::BIGINT AS e, unnest(x) AS c, unnest(range(len(x))) AS i FROM a{i}) GROUP BY pos, e, i)""")
            out.append(f"m{i} AS (SELECT pos, e, list(m ORDER BY i) AS x FROM s{i} GROUP BY pos, e)")
            out.append(f"b{i + 1} AS (SELECT b.pos, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.pos = b.pos AND m.e = b.e)")
    out.append(f"""done AS (SELECT r, string_agg(format('{{:02x}}', (best % 64)::INTEGER), '' ORDER BY pos) AS code, sum((best // 64)::HUGEINT)::BIGINT AS error
 FROM a{ROUNDS} GROUP BY r)""")
    return ",\n".join(out) + f"""
SELECT k.vec_id, d.code, d.error, (sum(d.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept k JOIN done d USING (r)"""


SQL = _sql()
