"""Exact cosine joins over vectors, in large blocks.

Vectors are placed in the cell of their nearest pivot. For unit vectors cosine is a function of distance, so the triangle
inequality rules out cells that can hold no match; nothing is approximated. How much that saves depends on the data: vectors
without clusters must meet every cell, and then the number of copies decides. So a cell holds as many rows as a task can
hold (``BLOCK``, less for long vectors), a vector is shipped once to each cell it must meet, two cells meet in one direction
only, and a task walks its block in ``STEP`` by ``STEP`` products, keeping matches or the best k of each row and nothing else.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corrobora.functions import exprs as X, vocab as V
from corrobora.operators.graph import components
from corrobora.session import cut, one_row, ship

BLOCK = 65_536                # rows of one side of a task
BLOCK_BYTES = 64 << 20        # and their bytes
STEP = 1_024                  # rows that are multiplied at a time
TASKS = 20_000                # most tasks of one comparison
PIVOT_BYTES = 64 << 20        # proven bound on the pivots sent to every executor
CELL_ROWS = 1_000_000         # proven bound on the (scope, cell) table sent with them
SLACK = 1e-4                  # covers rounding of reported scores to four decimals


# --- vectors ---------------------------------------------------------------------------------------
def normalize_vec(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """Unit vectors; a wrong dimension fails the job instead of scoring noise."""
    checked = F.when(F.size(col) == dim, F.col(col)).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, found "), F.size(col).cast("string"))))
    v = F.transform(checked, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn(col, F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)


def _unit(col) -> np.ndarray:
    return _unit_rows(np.stack(col.to_numpy()).astype("float64"))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (m @ pivots.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _pivots(index: DataFrame, block: int):
    """(pivots, rows of a block): vectors with the smallest id hash, repeatable, spread, and bounded in bytes.

    One per full block of the largest scope, at most sqrt(n): only rows of one scope meet, so smaller cells would ship a
    visitor more often and spare no block. Few enough that the table of (scope, cell) stays small too.
    """
    ship(index.sparkSession)
    n, scopes, most = index.groupBy("scope").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*"), F.max("n")).first()
    if not n:
        return None, block
    dim = len(index.select("embedding").first()[0])
    block = min(block, max(256, BLOCK_BYTES // (8 * dim)))
    want = max(1, min(math.isqrt(n), most // block, PIVOT_BYTES // (8 * dim), CELL_ROWS // scopes))
    rows = index.select(F.xxhash64("id").alias("h"), "id", "embedding").orderBy("h", "id").limit(want).collect()
    m = _unit(pd.Series([r["embedding"] for r in rows]))
    return index.sparkSession.sparkContext.broadcast(m), block


def _slices(batches, n_pivots: int):
    """Rows in portions whose distance table to all pivots stays near 32 MB."""
    step = max(1, 4_000_000 // n_pivots)
    for pdf in batches:
        for at in range(0, len(pdf), step):
            yield pdf.iloc[at:at + step]


def _vectors(df: DataFrame, ident: str, scope: str | None, key: Column | None = None) -> DataFrame:
    """Uniform shape (id, scope, embedding), with ``key`` if rows of one key are never to meet; vectors without
    direction match nothing."""
    out = df.select(F.col(ident).alias("id"), (F.col(scope) if scope else F.lit(0)).cast("string").alias("scope"),
                    F.col("embedding").cast("array<double>").alias("embedding"),
                    *([] if key is None else [F.coalesce(F.xxhash64(key), F.lit(0)).alias("key")]))
    return out.filter(F.exists("embedding", lambda x: x != 0))


def _homes(index: DataFrame, pivots) -> DataFrame:
    def place(batches):
        for pdf in _slices(batches, len(pivots.value)):
            m = _unit(pdf["embedding"])
            d = _distances(m, pivots.value)
            cell = d.argmin(1)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "scope": pdf["scope"].to_numpy(), "cell": cell.astype("int32"),
                                "radius": d[np.arange(len(m)), cell], "vec": list(m)})
    return index.mapInPandas(place, f"id {index.schema['id'].dataType.simpleString()}, scope string, cell int, "
                                    "radius double, vec array<double>")


def _visits(rows: DataFrame, pick) -> DataFrame:
    """(scope, cell, n): how often each cell is visited; batches count first, no vector travels."""
    def count(batches):
        for pdf, row, cell in pick(batches):
            met = pd.DataFrame({"scope": pdf["scope"].to_numpy()[row], "cell": cell.astype("int32")})
            yield met.groupby(["scope", "cell"]).size().reset_index(name="n")
    return rows.mapInPandas(count, "scope string, cell int, n long").groupBy("scope", "cell").agg(F.sum("n").alias("n"))


def _tiles(homes: DataFrame, visitors: DataFrame, visits: DataFrame, block: int) -> DataFrame:
    """Rows of both sides with their task (scope, cell, hc, vc). A home is repeated once for each block of visits to its own
    cell, and not shipped at all where nothing visits; a visitor once for each block of the cell's homes. Where that makes
    fewer blocks than keep all cores busy, visits are dealt into smaller ones. Tasks are as many as the products ask for."""
    on = ["scope", "cell"]
    met = homes.groupBy(on).agg(F.count("*").alias("m")).join(visits.select(*on, "n"), on).withColumn("nh", F.ceil(F.col("m") / block).cast("int"))
    met = cut(met.select(*on, "m", "n", "nh"))                                                                     # a row a cell
    few = 4 * homes.sparkSession.sparkContext.defaultParallelism
    cells, blocks, work = met.agg(F.count("*"), F.coalesce(F.sum(F.col("nh") * F.ceil(F.col("n") / block)), F.lit(0)),
                                  F.coalesce(F.sum(F.col("m").cast("double") * F.col("n")), F.lit(0.0))).first()
    least = min(block, max(STEP, block * max(1, blocks) // few))
    sizes = met.select(*on, "nh", F.ceil(F.col("n") / least).cast("int").alias("nv"))
    sizes = F.broadcast(sizes) if cells <= CELL_ROWS else sizes             # else vectors would travel twice
    tasks = max(few, min(TASKS, 2 * max(blocks, math.ceil(work / block ** 2)) if block >= STEP else 0))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    extra = [c for c in ("key", "own") if c in visitors.columns]
    cols = ["scope", "cell", "hc", "vc", "side", "id", "vec", *extra]
    h = homes.join(sizes, on).withColumn("hc", spread("nh")).withColumn("vc", upto("nv")).withColumn("side", F.lit(0))
    h = h.withColumn("own", F.lit(True)) if "own" in extra else h
    v = visitors.join(sizes, on).withColumn("vc", spread("nv")).withColumn("hc", upto("nh")).withColumn("side", F.lit(1))
    return h.select(cols).unionByName(v.select(cols)).repartition(tasks, *_TASK)


_TASK = ("scope", "cell", "hc", "vc")


def _sides(batches) -> tuple | None:
    """(home ids, vectors, columns, visitor ids, vectors, columns) of a task, straight from its batches: no vector becomes an
    object of its own. The home side by id, so that places settle ties. Columns: ``key`` and ``own`` where there are any."""
    parts = ([], [])
    for b in batches:
        side = b.column("side").to_numpy(zero_copy_only=False)
        vec = b.column("vec")
        m = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1) if len(vec) else np.zeros((0, 0))
        extra = [c for c in ("key", "own") if c in b.schema.names]
        cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("id", *extra)}
        for s in (0, 1):
            if (side == s).any():
                parts[s].append((m[side == s], {c: x[side == s] for c, x in cols.items()}))
    if not all(parts):
        return None
    (hm, h), (vm, v) = ((np.concatenate([m for m, _ in p]), {c: np.concatenate([x[c] for _, x in p]) for c in p[0][1]}) for p in parts)
    order = np.argsort(h["id"], kind="stable")
    return h["id"][order], hm[order], {c: x[order] for c, x in h.items()}, v["id"], vm, v


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _scores(v: np.ndarray, h: np.ndarray):
    """(first row, first column, cosines in units of 1e-4) of STEP by STEP products, a row of blocks after the other."""
    for i in range(0, len(v), STEP):
        for j in range(0, len(h), STEP):
            yield i, j, np.rint((v[i:i + STEP] @ h[j:j + STEP].T) * 1e4).astype("int64")


# --- range join ------------------------------------------------------------------------------------
def distinct_vectors(df: DataFrame, ident: str, scope: str | None) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct vector, edges tying every exact copy to its smallest id)."""
    v = _vectors(df, ident, scope)
    heads = v.groupBy("scope", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    copies = v.join(heads.filter("n > 1").withColumnRenamed("id", "a_id").drop("n"), ["scope", "embedding"])
    return heads.select("id", "scope", "embedding"), copies.filter("id <> a_id").select("a_id", F.col("id").alias("b_id"))


def _range_edges(vectors: DataFrame, t: float, forest: bool, block: int) -> DataFrame | None:
    pivots, block = _pivots(vectors, block)
    if pivots is None:
        return None
    eps = math.sqrt(max(0.0, 2.0 - 2.0 * (t - SLACK)))
    idt = vectors.schema["id"].dataType.simpleString()
    homes = cut(_homes(vectors, pivots))

    def pick(batches):
        p = pivots.value
        for pdf in _slices(batches, len(p)):
            m = np.stack(pdf["vec"].to_numpy())
            d = _distances(m, p)
            home = pdf["cell"].to_numpy()
            own = d[np.arange(len(m)), home][:, None]
            g = _distances(p[home], p)
            # distance to the plane between the two pivots bounds the distance to the other cell; of two cells
            # only the later one's rows visit
            plane = np.divide(d * d - own * own, 2.0 * g, out=np.zeros_like(d), where=g > 0)
            yield pdf, *np.nonzero((plane <= eps) & (np.arange(len(p))[None, :] <= home[:, None]))

    def visit(batches):
        for pdf, row, cell in pick(batches):
            vec = pdf["vec"].to_numpy()
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "scope": pdf["scope"].to_numpy()[row],
                                "cell": cell.astype("int32"), "vec": vec[row], "own": cell == pdf["cell"].to_numpy()[row]})
    visitors = homes.mapInPandas(visit, f"id {idt}, scope string, cell int, vec array<double>, own boolean")

    kind = to_arrow_type(vectors.schema["id"].dataType)
    shape = pa.schema([("a_id", kind), ("b_id", kind), ("score", pa.float64())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(batches)
        if sides is None:
            return
        hid, hm, _, vid, vm, v = sides
        own, out = v["own"].astype(bool), []
        for i, j, s in _scores(vm, hm):
            x, y = vid[i:i + STEP], hid[j:j + STEP]
            row, col = np.nonzero((s / 1e4 >= t) & (~own[i:i + STEP, None] | (x[:, None] > y[None, :])))
            a, b = np.minimum(y[col], x[row]), np.maximum(y[col], x[row])
            if forest and len(a):
                out.append(_spanning(a, b))
            elif len(a):
                yield _batch(shape, a, b, s[row, col] / 1e4)
        if out:
            a, b = _spanning(*(np.concatenate(c) for c in zip(*out)))
            yield _batch(shape, a, b, np.ones(len(a)))
    tiles = _tiles(homes, visitors, _visits(homes, pick), block)
    return tiles.groupBy(*_TASK).applyInArrow(match, f"a_id {idt}, b_id {idt}, score double")


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member of a connected group tied to the group's smallest: one edge a member, not one a pair."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[:len(a)], at[len(a):], np.arange(len(ids))
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[tied]], ids[tied]


def sim_pairs(df: DataFrame, t: float, ident: str = "vec_id", scope: str | None = "branch_id",
              block: int = BLOCK) -> DataFrame:
    """(a_id, b_id, score) with a < b and cosine >= t, between classes of equal vectors, each named by its smallest id;
    the other members of a class hang off that id with score 1. No link between different vectors is lost, and a
    class of any size adds one row a member, not all its pairs."""
    distinct, copies = distinct_vectors(df, ident, scope)
    edges = _range_edges(cut(distinct), t, False, block)
    stars = copies.withColumn("score", F.lit(1.0))
    return stars if edges is None else edges.unionByName(stars)


def claim_clusters(df: DataFrame, t: float = V.SAME_MEANING, ident: str = "vec_id",
                   scope: str | None = "branch_id", block: int = BLOCK) -> DataFrame:
    """(id, component): clusters of the relation cosine >= t, whatever the row order."""
    distinct, copies = distinct_vectors(df, ident, scope)
    edges = _range_edges(cut(distinct), t, True, block)
    links = copies if edges is None else edges.select("a_id", "b_id").unionByName(copies)
    return components(links, df, "a_id", "b_id", ident)


def _near_cells(d: np.ndarray, plane: np.ndarray, cells, need: np.ndarray, reach: float, probe=None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells that may hold one of the ``need`` nearest members of a row, or anything within ``reach``; with
    ``probe`` only cells that hold a smaller id. d: distances of each row to the pivots; plane: to the planes between its nearest
    pivot and each other."""
    if cells is None:
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
    ids, sizes, radii, least = cells
    may = np.ones((len(d), len(ids)), bool) if probe is None else (least[None, :] < probe[:, None]).astype(bool)
    near = d[:, ids]
    far = near + radii
    order = np.argsort(far, axis=1)
    full = np.cumsum(np.take_along_axis(np.where(may, sizes, 0), order, 1), axis=1) >= need[:, None]
    at = order[np.arange(len(d)), full.argmax(1)]
    # widened by what rounding to four decimals can hide
    best = np.where(full.any(1), np.sqrt((far[np.arange(len(d)), at] + SLACK) ** 2 + 4 * SLACK), math.inf)
    row, cell = np.nonzero(may & (np.maximum(near - radii, plane[:, ids] - 1e-9) <= np.minimum(best, reach)[:, None]))
    return row, ids[cell]


def _matrix(vec: pa.Array) -> np.ndarray:
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1) if len(vec) else np.zeros((0, 0))


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _best(vm: np.ndarray, hm: np.ndarray, k: int, least: int, allowed) -> Iterator[tuple]:
    """(first row, row, home, score in units of 1e-4) of the k best homes of STEP visitors after STEP visitors, ties to the earlier
    home. ``allowed(rows, homes)`` says which of them may be paired.

    Products in single precision only rule out what can't reach the k-th best so far by more than their error; what is left is
    scored in double precision. Where little is ruled out a whole product is scored.
    """
    n, none, dim = len(hm), np.iinfo("int64").max, vm.shape[1]
    err = (dim + 8) * 1.2e-7
    h32 = hm.astype("float32")
    products, hits = np.empty((STEP, STEP), "float32"), np.empty((STEP, STEP), bool)        # made once: fresh pages cost as much as the product
    for i in range(0, len(vm), STEP):
        v = vm[i:i + STEP]
        v32, rows = v.astype("float32"), np.arange(i, i + len(v))[:, None]
        low = np.full(len(v), (least - 0.5) / 1e4 - err)
        top_row, top_key = np.zeros(0, "int64"), np.zeros(0, "int64")
        for j in range(0, n, STEP):
            wide = min(STEP, n - j)
            s, hit = products.reshape(-1)[:len(v) * wide].reshape(len(v), wide), hits.reshape(-1)[:len(v) * wide].reshape(len(v), wide)
            np.matmul(v32, h32[j:j + STEP].T, out=s)
            np.greater_equal(s, low[:, None].astype("float32"), out=hit)
            if np.count_nonzero(hit) * 32 <= hit.size:
                row, col = np.divmod(np.flatnonzero(hit.ravel()), wide)
                ok = allowed(i + row, j + col)
                row, col = row[ok], col[ok]
                s = np.rint(np.einsum("ij,ij->i", v[row], hm[j + col]) * 1e4).astype("int64")
                key = (20_000 - s) * n + j + col            # one number orders by score, then id
                row, key = row[s >= least], key[s >= least]
            else:
                s = np.rint((v @ hm[j:j + STEP].T) * 1e4).astype("int64")
                places = np.arange(j, j + s.shape[1])[None, :]
                s = np.where((s >= least) & allowed(rows, places), (20_000 - s) * n + places, none)
                if s.shape[1] > k:
                    s = np.partition(s, k - 1, axis=1)[:, :k]
                row, col = np.nonzero(s < none)
                key = s[row, col]
            if not len(row):
                continue
            row, key = np.concatenate([top_row, row]), np.concatenate([top_key, key])
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            top_row, top_key = row[place < k], key[place < k]
            last = place == k - 1                           # later homes must be strictly better than the k-th
            low[row[last]] = (20_000 - key[last] // n + 0.5) / 1e4 - err
        yield i, top_row, top_key % n, 20_000 - top_key // n


# --- nearest neighbours ----------------------------------------------------------------------------
def knn(probes: DataFrame, index: DataFrame, k: int, probe_id: str = "probe_id", ident: str = "vec_id",
        scope: str | None = "branch_id", floor: float | None = None, skip_self: bool = False,
        block: int = BLOCK, skip: tuple[Column, Column] | None = None, earlier: bool = False) -> DataFrame:
    """(probe_id, vec_id, score, rank): the k best by cosine (four decimals), ties by id. Exact.

    ``skip``: a column of the probes and one of the index; rows in which they are equal (copies of the probe's own text,
    say) never count, however many there are. ``earlier``: only rows of a smaller id than the probe's count.

    Cell sizes and radii bound the k-th distance before any comparison; a probe visits only cells that
    may hold something closer (or above ``floor``).
    """
    q, ix = _vectors(probes, probe_id, scope, skip and skip[0]), _vectors(index, ident, scope, skip and skip[1])
    idt = ix.schema["id"].dataType.simpleString()
    qt = q.schema["id"].dataType.simpleString()
    schema = f"{probe_id} {qt}, {ident} {idt}, score double"
    ix = cut(ix)
    pivots, block = _pivots(ix, block)
    if pivots is None:
        return probes.sparkSession.createDataFrame([], schema + ", rank int")
    homes = cut(_homes(ix, pivots))
    if skip is not None:
        homes = homes.join(ix.select("id", "key").distinct(), "id")
    many = len(pivots.value) > 1
    cells: dict = {}
    if many:        # at most CELL_ROWS rows by the choice of pivots
        for r in homes.groupBy("scope", "cell").agg(F.count("*").alias("n"), F.max("radius").alias("r"), F.min("id").alias("least")).collect():
            cells.setdefault(r["scope"], []).append((r["cell"], r["n"], r["r"], r["least"]))
    table = homes.sparkSession.sparkContext.broadcast({
        sc: (*(np.asarray(x) for x in list(zip(*rows))[:3]), np.asarray([x[3] for x in rows], object)) for sc, rows in cells.items()})
    mixed = qt != idt               # one side's ids travel as text, and are numbers again where ties are settled
    need, skipping = k + (1 if skip_self else 0), skip is not None
    if earlier:
        need = math.inf             # how many rows of a cell are earlier isn't known
    if skipping:        # a probe skips as many rows as there are of its own key
        q = q.join(ix.groupBy("key").agg(F.count("*").alias("same")), "key", "left")
    reach = math.inf if floor is None else math.sqrt(max(0.0, 2.0 - 2.0 * (floor - SLACK)))

    by_order = earlier and not mixed

    names = ["id", "scope", *(["key"] if skipping else [])]

    def pick(batches):
        """(batch, unit vectors, row, cell) of all visits."""
        p = pivots.value
        for whole in batches:
            step = max(1, 1_000_000 // len(p))
            for b in (whole.slice(at, step) for at in range(0, len(whole), step)):
                m = _unit_rows(_matrix(b.column("embedding")))
                if not many:
                    yield b, m, np.arange(len(b)), np.zeros(len(b), "int64")
                    continue
                d = _distances(m, p)
                apart = 2.0 * _distances(p[d.argmin(1)], p)
                plane = np.divide(d * d - d.min(1)[:, None] ** 2, apart, out=np.zeros_like(d), where=apart > 0)
                wanted = np.full(len(b), need, "float64")
                if skipping:
                    wanted = wanted + b.column("same").fill_null(0).to_numpy(zero_copy_only=False)
                ids = b.column("id").to_numpy(zero_copy_only=False)
                for sc, at in pd.Series(np.arange(len(b))).groupby(b.column("scope").to_numpy(zero_copy_only=False), dropna=False):
                    at = at.to_numpy()
                    row, cell = _near_cells(d[at], plane[at], table.value.get(None if pd.isna(sc) else sc), wanted[at], reach, ids[at] if by_order else None)
                    yield b, m, at[row], cell

    def count(batches):
        met: dict = {}
        for b, _, row, cell in pick(batches):
            seen = pd.DataFrame({"scope": b.column("scope").to_numpy(zero_copy_only=False)[row], "cell": cell})
            for at, n in seen.groupby(["scope", "cell"], dropna=False).size().items():
                met[at] = met.get(at, 0) + n
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([None if pd.isna(sc) else sc for sc, _ in met], pa.string()),
                                              pa.array([c for _, c in met], pa.int32()), pa.array(list(met.values()), pa.int64())], ["scope", "cell", "n"])

    def visit(batches):
        for b, m, row, cell in pick(batches):
            for at in range(0, len(row), 8 * STEP):
                some = row[at:at + 8 * STEP]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(some)) for c in names), pa.array(cell[at:at + 8 * STEP], pa.int32()), _lists(m[some])],
                                                 [*names, "cell", "vec"])
    visits = (q.mapInArrow(count, "scope string, cell int, n long") if many else
              q.groupBy("scope").agg(F.lit(0).alias("cell"), F.count("*").alias("n"))).groupBy("scope", "cell").agg(F.sum("n").alias("n"))
    visitors = q.mapInArrow(visit, f"id {qt}, scope string, " + ("key long, " if skipping else "") + "cell int, vec array<double>")

    least = -10**9 if floor is None else math.ceil(floor * 1e4 - 1e-6)

    shape = pa.schema([(probe_id, to_arrow_type(q.schema["id"].dataType)), (ident, to_arrow_type(ix.schema["id"].dataType)), ("score", pa.float64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(batches)
        if sides is None:
            return
        hid, hm, h, vid, vm, v = sides
        if mixed and idt in ("bigint", "int"):
            hid = hid.astype("int64")
            order = np.argsort(hid, kind="stable")
            hm, hid, h = hm[order], hid[order], {c: x[order] for c, x in h.items()}

        def allowed(row, home):
            ok = np.ones(np.broadcast_shapes(row.shape, home.shape), bool)
            if skip_self:
                ok &= vid[row] != hid[home]
            if earlier:
                ok &= vid[row] > hid[home]
            if skipping:
                ok &= v["key"][row] != h["key"][home]
            return ok
        for i, row, home, score in _best(vm, hm, k, least, allowed):
            if len(row):
                yield _batch(shape, vid[i + row], hid[home], score / 1e4)
    if mixed:
        homes, visitors = homes.withColumn("id", F.col("id").cast("string")), visitors.withColumn("id", F.col("id").cast("string"))
    hits = _tiles(homes, visitors, visits, block).groupBy(*_TASK).applyInArrow(best, schema)
    rank = F.row_number().over(W.partitionBy(probe_id).orderBy(F.desc("score"), ident))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def query_index(probes: DataFrame, index: DataFrame, k: int, kind: str | None = None,
                tier: str | None = None, **kw) -> DataFrame:
    """Filtered top-k with the stored fields of each hit; filters run before any vector is placed."""
    if kind is not None:
        index = index.filter(F.col("node_kind") == kind)
    if tier is not None:
        index = index.filter(F.col("confidence_tier") == tier)
    fields = index.select("vec_id", "node_kind", "confidence_tier", "urls", "source_types", "corroboration_count",
                          "created_at", (F.size("source_types") > 1).alias("cross_source"))
    return knn(probes, index, k, **kw).join(fields, "vec_id")


def score_novelty(new: DataFrame, index: DataFrame) -> DataFrame:
    hit = knn(new, index, 1).select("probe_id", "vec_id", "score")
    s = F.coalesce("score", F.lit(0.0))
    return new.select("probe_id").join(hit, "probe_id", "left").select(
        "probe_id", F.col("vec_id").alias("nearest_id"), s.alias("nearest_score"), X.novelty_tier(s).alias("novelty"))


def best_match(topics: DataFrame, index: DataFrame, floor: float = V.SAME_MEANING) -> DataFrame:
    return knn(topics, index, 1, floor=floor).select("probe_id", "vec_id", "score")


def bridges(a: DataFrame, b: DataFrame, min_sim: float = 0.45, top: int | None = None) -> DataFrame:
    """Each A row's closest B row, strongest first; ``n_total`` counts what the cut left out."""
    hits = cut(knn(a, b, 1, scope=None, floor=min_sim))
    total = hits.agg(F.count("*").alias("n_total"))
    best = hits.orderBy(F.desc("score"), "probe_id", "vec_id")
    if top is not None:
        best = best.limit(top)
    return best.select("probe_id", "vec_id", "score", X.sim_band(F.col("score")).alias("band"), one_row(total)["n_total"].alias("n_total"))


def bridge_all(df: DataFrame, min_sim: float = 0.5, per_pair: int | None = None, top: int | None = None) -> DataFrame:
    """Strongest links between branches: each row's single best partner in every later branch, then the best
    ``per_pair`` rows of each two branches, then the ``top`` of all; ``n_total`` counts the links before both cuts."""
    branches = one_row(df.agg(F.collect_set("branch_id").alias("b")))["b"]
    asked = df.select(F.col("vec_id").alias("a_id"), F.col("branch_id").alias("branch_a"), "embedding", F.explode(branches).alias("branch_id"))
    asked = asked.filter("branch_a < branch_id")
    asked = asked.withColumn("probe_id", F.concat_ws("|", "a_id", "branch_id"))
    hits = knn(asked, df, 1, floor=min_sim).select("probe_id", F.col("vec_id").alias("b_id"), "score")
    links = cut(hits.join(asked.select("probe_id", "a_id", "branch_a", F.col("branch_id").alias("branch_b")), "probe_id"))
    n = one_row(links.agg(F.count("*").alias("n")))["n"]
    if per_pair is not None:
        rank = F.row_number().over(W.partitionBy("branch_a", "branch_b").orderBy(F.desc("score"), "a_id"))
        links = links.withColumn("rank", rank).filter(F.col("rank") <= per_pair)
    best = links.orderBy(F.desc("score"), "a_id", "b_id")
    best = best if top is None else best.limit(top)
    return best.select("branch_a", "branch_b", "a_id", "b_id", "score", n.alias("n_total"))


# --- decisions built on neighbours -----------------------------------------------------------------
def relation_candidates(new: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs to be judged: each new claim's nearest neighbour and its band."""
    hit = knn(new, index, 1, floor=V.NEST_FLOOR)
    return hit.select("probe_id", "vec_id", "score", X.relation_band(F.col("score")).alias("band"))


def kb_lookup(questions: DataFrame, index: DataFrame, judge: DataFrame, as_of: Column,
              sim_floor: float = 0.50, min_corroboration: int = 2, max_age_days: float | None = None, hits_judged: int = 5) -> DataFrame:
    """Best stored answer per question that clears every gate, among its ``hits_judged`` nearest findings; a missing
    judgement means no."""
    hits = query_index(questions, index, hits_judged, kind="finding").filter(F.col("score") >= sim_floor)
    age = X.age_days(F.col("created_at"), as_of)
    ok = ((F.col("confidence_tier") == "Accepted") & (F.col("corroboration_count") >= min_corroboration)
          & (F.size("urls") > 0))
    if max_age_days is not None:
        ok = ok & F.coalesce(age <= max_age_days, F.lit(True))
    judged = hits.filter(ok).join(judge.filter("answer = 'yes'"), "probe_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("probe_id").orderBy(F.desc("score"), "vec_id"))
    return judged.withColumn("_r", rank).filter("_r = 1").select(
        "probe_id", "vec_id", "score", "corroboration_count", F.round(age, 1).alias("age_days"))


def consensus(claims: DataFrame, index: DataFrame, verdicts: DataFrame, minimum: int = 3,
              floor: float = V.CONNECT, text: str | None = None) -> DataFrame:
    """How many of the seven nearest other findings agree to be near, and whether the claim contradicts them.

    ``text`` names the column by which a verbatim copy of the claim is kept from backing itself.
    """
    same = None if text is None else (F.trim(text), F.trim(text))
    near = knn(claims, index, minimum + 4, skip_self=True, skip=same).filter(F.col("score") >= floor)
    size = near.groupBy("probe_id").agg(F.count("*").alias("consensus_size"))
    joined = claims.select("probe_id").join(size, "probe_id", "left").join(verdicts, "probe_id", "left")
    n = F.coalesce("consensus_size", F.lit(0))
    return joined.select("probe_id", n.alias("consensus_size"),
                         ((n >= minimum) & F.coalesce(F.col("contradicts"), F.lit(False))).alias("contradiction"))


def export_edges(df: DataFrame, k: int = 3) -> DataFrame:
    """Each finding's nearest neighbours with a positive score, for neighbour exports."""
    fields = df.select(F.col("vec_id").alias("probe_id"), "branch_id", "confidence_tier",
                       F.size("urls").alias("n_urls"), "corroboration_count")
    hits = knn(df.withColumnRenamed("vec_id", "probe_id"), df, k, skip_self=True).filter("score > 0")
    return hits.join(fields, "probe_id")


def post_flight(found: DataFrame, index: DataFrame, floor: float = V.CONNECT) -> DataFrame:
    """Findings, and how many connect to the index, per domain they cite (blank domain = none cited)."""
    near = knn(found, index, 1, floor=floor).select("probe_id").withColumn("_c", F.lit(1))
    rows = found.select("probe_id", F.explode_outer("urls").alias("url")).join(near, "probe_id", "left")
    return rows.groupBy(X.domain_of(F.col("url")).alias("domain")).agg(
        F.countDistinct("probe_id").alias("findings"), F.count_if(F.col("url").isNotNull()).alias("citations"),
        F.countDistinct(F.when(F.col("_c") == 1, F.col("probe_id"))).alias("connected"))


def prefilter(questions: DataFrame, index: DataFrame) -> DataFrame:
    """Question score from map geometry; ``survives`` at or above the floor."""
    f = knn(questions, index.filter("node_kind = 'finding'"), V.LOAD_CAP).groupBy("probe_id").agg(
        F.max("score").alias("top_find"), F.count_if(F.col("score") >= V.NEAR).alias("near"))
    g = knn(questions, index.filter("node_kind = 'gap'"), 3).groupBy("probe_id").agg(F.max("score").alias("top_gap"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = questions.select("probe_id").join(f, "probe_id", "left").join(g, "probe_id", "left")
    rows = rows.select("probe_id", z("top_gap").alias("disagreement"), X.frontier(z("top_find")).alias("frontier"),
                       F.least(F.coalesce("near", F.lit(0)) / V.LOAD_CAP, F.lit(1.0)).alias("load_bearing"))
    rows = rows.withColumn("tractability", 0.4 + 0.6 * F.col("load_bearing"))
    total = sum((w * F.col(c) for c, w in V.PREFILTER_WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("combined", F.bround(total, 4)).withColumn(
        "survives", F.col("combined") >= V.PREFLIGHT_FLOOR)
