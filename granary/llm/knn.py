"""Exact top-k search by inner product: a Voronoi kNN join.

Components are turned into whole numbers, ``floor(SCALE * x)``. Pivots (k-means centres of a
bounded sample; about the square root of the number of vectors) cut the vectors into Voronoi cells, and a
summary of each cell holds its size and its radius R, the largest distance of a member from the pivot p. For every member v of a cell
``q . v <= q . p + |q| R``, and that bound decides where a query has to go:

1. each query is solved in its own cell, which gives it a lower bound for its k-th score;
2. it is then sent only to those other cells whose upper bound reaches that score.

Queries, the smaller side, are what is replicated; a vector is moved once. Large cells are cut into
chunks by a hash of vec_id, so many equal vectors fill many chunks; a chunk has about ``CHUNK`` vectors at
most, and fewer where that would give fewer chunks than ``SPREAD`` times the tasks that can run. A task reads a chunk, then streams the queries past it in tiles, so its memory is bounded
by the chunk whatever the number of queries. Where nothing can be pruned, each query meets each
chunk and the result is still exact.

Scores are exact: products are summed in float32 or float64 while the norms prove that every
partial sum is a whole number those hold exactly, and else in Python's integers (a score beyond a
long is clipped to it). Rows with a null vec_id, and vectors that are null or hold null or
non-finite components, take no part. Vectors are compared with those of as many components. Rows
equal in vec_id and vector count once; a query id in rows with different vectors is asked with the
first of them in byte order. A candidate with the query's vec_id is not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.textkit import free, settle

SCALE, K = 1024.0, 10
#: Vectors to a chunk at most and at least, chunks to a task slot, cells at most, and vectors that the pivots are fitted on.
CHUNK, LEAST_CHUNK, SPREAD, MAX_CELLS, SAMPLE = 65_536, 512, 4, 512, 8192
#: Scores held at once.
TILE = 1 << 21
_LONG = np.iinfo(np.int64)
_ROW = "vec_id long, dim int, v binary, cell int, norm double, resid double"


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of float64 from packed vectors of one length: float32 where that is exact, else float64."""
    out = np.empty((len(column), dim))
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for kind in (np.float32, np.float64):
        at = np.flatnonzero(sizes == np.dtype(kind).itemsize * dim)
        if dim and len(at):
            out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), dtype=kind).reshape(-1, dim)
    return out


def _quantised(scale: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("vec_id")), pc.is_valid(batch.column("embedding"))))
            lists, ids = batch.column("embedding"), batch.column("vec_id")
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                flat = lists.take(pa.array(at)).flatten()
                x = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
                v = np.floor(scale * x) + 0.0  # no -0.0: equal vectors have equal bytes
                good = np.isfinite(v).all(axis=1)
                small = (np.abs(v) < 1 << 24).all(axis=1)
                for pick, kind in ((good & small, np.float32), (good & ~small, np.float64)):
                    part = np.flatnonzero(pick)
                    if len(part):
                        packed = [r.tobytes() for r in v[part].astype(kind)]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[part])), pa.array(np.full(len(part), dim, np.int32)), pa.array(packed, pa.binary())], ["vec_id", "dim", "v"])

    return rows


def fit_pivots(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of the sample; fewer than ``cells`` if it has fewer rows."""
    centres = sample[np.random.default_rng(5).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = (sample @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(axis=0)
    return centres


def _pivots(base: DataFrame, count: int, cells: int | None) -> dict[int, np.ndarray]:
    """dim -> pivots, from at most SAMPLE rows, the first by a hash of vec_id; some sqrt(count) cells for each dim."""
    cells = min(MAX_CELLS, cells or max(1, math.isqrt(count)))
    picked = base.select("dim", "v").orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).toArrow()
    out = {}
    for dim in sorted(set(picked["dim"].to_pylist())):
        rows = picked.filter(pc.equal(picked["dim"], dim))
        out[dim] = fit_pivots(_vectors(rows["v"].combine_chunks(), dim), cells)
    return out


def cell_number(dim: int, i: int) -> int:
    return dim * 2 * MAX_CELLS + i


def _assigned(pivots: dict[int, np.ndarray]):
    """Rows with their nearest pivot's cell, their norm and their distance from the pivot."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                v = _vectors(part.column("v"), dim)
                p = pivots.get(dim, np.zeros((1, dim)))
                near = (v @ p.T - (p**2).sum(axis=1) / 2).argmax(axis=1)
                resid = np.sqrt(((v - p[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array((near + cell_number(dim, 0)).astype(np.int32)), pa.array(np.sqrt((v**2).sum(axis=1))), pa.array(resid)],
                    ["vec_id", "dim", "v", "cell", "norm", "resid"],
                )

    return rows


class Chunk:
    """The vectors of one chunk, ordered by vec_id; of equal vectors only the k + 1 smallest ids, which is all that a top k can hold."""

    def __init__(self, ids: list[int], packed: list[bytes], dim: int, k: int):
        kept: dict[bytes, list[int]] = {}
        for b, i in sorted(set(zip(packed, ids, strict=True))):
            held = kept.setdefault(b, [])
            if len(held) <= k:
                held.append(i)
        pairs = sorted((i, b) for b, held in kept.items() for i in held)
        self.ids = np.array([i for i, _ in pairs], dtype=np.int64)
        self.dim, self.k = dim, k
        self.v = _vectors(pa.array([b for _, b in pairs], pa.binary()), dim)
        self.norm = float(np.sqrt((self.v**2).sum(axis=1)).max()) if len(pairs) else 0.0
        self.narrow = self.v.astype(np.float32) if self.norm < 1 << 24 else None

    def scores(self, q: np.ndarray, at: slice) -> np.ndarray:
        """Exact inner products: by Cauchy and Schwarz no partial sum is above the product of the norms."""
        most = self.norm * float(np.sqrt((q**2).sum(axis=1)).max()) * 1.001
        if most < 1 << 24 and self.narrow is not None:
            return q.astype(np.float32) @ self.narrow[at].T
        if most < 1 << 53:
            return q @ self.v[at].T
        exact = np.array([[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in self.v[at]] for a in q], dtype=object)
        return np.clip(exact, _LONG.min, _LONG.max)

    def solve(self, query_ids: np.ndarray, q: np.ndarray, floor: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, vec_id, score) of each query's k best that reach its floor; ties to smaller ids."""
        n, k = len(q), self.k
        least = [(-(1 << 70) if x is None else x) for x in floor]
        at, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype=object)
        width = max(1, min(len(self.ids), max(1024, TILE // max(n, 1))))
        for start in range(0, len(self.ids), width):
            part = slice(start, start + width)
            s = self.scores(q, part)
            bound = np.array(least, dtype=object) if s.dtype == object else np.array([max(float(x), -1e300) for x in least])[:, None].astype(s.dtype)
            r, c = np.nonzero(s >= (bound[:, None] if s.dtype == object else bound))
            if len(r) > 32 * n:  # columns are in order of ids, so a stable sort keeps ties in order
                best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                r, c = np.repeat(np.arange(n), best.shape[1]), best.ravel()
            found = self.ids[part][c]
            ok = found != query_ids[r]
            r, c, found = r[ok], c[ok], found[ok]
            new = s[r, c] if s.dtype == object else s[r, c].astype(np.int64)
            at, ids = np.concatenate([at, r]), np.concatenate([ids, found])
            scores = np.concatenate([scores, new]) if len(scores) else new
            order = np.lexsort((ids, -scores.astype(np.int64), at))
            rank = np.arange(len(at)) - np.searchsorted(at[order], at[order])
            order = order[rank < k]
            at, ids, scores = at[order], ids[order], scores[order]
            full = np.flatnonzero(np.bincount(at, minlength=n) >= k)
            last = np.searchsorted(at, full, side="right") - 1
            for i, x in zip(full.tolist(), scores[last].tolist(), strict=True):
                least[i] = max(least[i], int(x))
        return at, ids, scores.astype(np.int64)


def _solver(k: int):
    """Streams rows ordered by (chunk, side): the vectors of a chunk (side 0), then the queries sent to it (side 1)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, packed, chunk = None, [], [], None
        for batch in batches:
            key, side = batch.column("chunk").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if key[a] != current:
                    current, ids, packed, chunk = key[a], [], [], None
                if side[a] == 0:
                    ids += part.column("id").to_pylist()
                    packed += part.column("v").to_pylist()
                    continue
                dim = part.column("dim")[0].as_py()
                if chunk is None:
                    chunk = Chunk(ids, packed, dim, k)
                    ids, packed = [], []
                if not len(chunk.ids):
                    continue
                tile = max(1, min(1024, TILE // 1024))
                for i in range(0, part.num_rows, tile):
                    some = part.slice(i, tile)
                    query_ids = some.column("id").to_numpy()
                    at, found, scores = chunk.solve(query_ids, _vectors(some.column("v"), dim), some.column("floor").to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[at]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])

    return rows


def _local(data: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each chunk for the queries routed to it."""
    columns = ["chunk", "side", "id", "dim", "v", "floor"]
    vectors = data.select("chunk", F.lit(0).alias("side"), F.col("vec_id").alias("id"), "dim", "v", F.lit(None).cast("long").alias("floor"))
    both = vectors.union(routed.select("chunk", F.lit(1).alias("side"), F.col("vec_id").alias("id"), "dim", "v", "floor"))
    return both.select(columns).repartition("chunk").sortWithinPartitions("chunk", "side").mapInArrow(_solver(k), "query_id long, vec_id long, score long")


def _router(pivots: dict[int, np.ndarray], radius: dict[int, float], parts: dict[int, int]):
    """Queries to the chunks of the other cells that may hold one of their k best."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                p = pivots.get(dim, np.zeros((1, dim)))
                cells = [cell_number(dim, i) for i in range(len(p)) if cell_number(dim, i) in radius]
                where = [c - cell_number(dim, 0) for c in cells]
                q = _vectors(part.column("v"), dim)
                most = q @ p[where].T + part.column("norm").to_numpy()[:, None] * np.array([radius[c] for c in cells])
                most += 1e-9 * np.abs(most) + 1.0  # rounding
                floor = np.array([-np.inf if x is None else float(x) for x in part.column("floor").to_pylist()])
                go = (most >= floor[:, None]) & (np.array(cells)[None, :] != part.column("cell").to_numpy()[:, None])
                for j, c in enumerate(cells):
                    sent = part.filter(pa.array(go[:, j]))
                    for i in range(parts[c] if sent.num_rows else 0):
                        chunk = pa.array(np.full(sent.num_rows, chunk_number(c, i), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([chunk, *[sent.column(x) for x in ("vec_id", "dim", "v", "floor")]], ["chunk", "vec_id", "dim", "v", "floor"])

    return rows


def chunk_number(cell: int, part: int) -> int:
    return cell * (1 << 24) + part


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_cell(values: dict[int, int], column: str = "cell") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair]), F.col(column))


def knn_join(vectors: DataFrame, queries: Column, k: int = K, scale: float = SCALE, cells: int | None = None, chunk: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of each row of vectors (vec_id, embedding) for which ``queries`` holds."""
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    base = settle(base.mapInArrow(_quantised(scale), "vec_id long, dim int, v binary"))
    count = base.count()
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    chunk = chunk or min(CHUNK, max(LEAST_CHUNK, -(-count // (SPREAD * tasks))))
    pivots = _pivots(base, count, cells)
    plain, base = base, settle(base.mapInArrow(_assigned(pivots), _ROW))
    free(plain)
    # One row per cell: at most MAX_CELLS for each length of vectors.
    summary = base.groupBy("cell").agg(F.count("*").alias("n"), F.max("resid").alias("r")).collect()
    if not summary:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    radius, parts = {x["cell"]: x["r"] for x in summary}, {x["cell"]: -(-x["n"] // chunk) for x in summary}
    part = F.pmod(F.xxhash64("vec_id"), _by_cell(parts))
    data = base.withColumn("chunk", F.col("cell").cast("long") * (1 << 24) + part)
    first = F.min(F.struct("v", "dim", "cell", "norm")).alias("x")
    asked = settle(base.where(queries).groupBy("vec_id").agg(first).select("vec_id", "x.*"))
    at_home = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), _by_cell(parts) - 1))).withColumn("chunk", F.col("cell").cast("long") * (1 << 24) + F.col("chunk"))
    near = settle(_ranked(_local(data, at_home.withColumn("floor", F.lit(None).cast("long")), k), k))
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    abroad = asked.join(floors, "vec_id", "left").select("vec_id", "dim", "v", "cell", "norm", "floor")
    routed = abroad.mapInArrow(_router(pivots, radius, parts), "chunk long, vec_id long, dim int, v binary, floor long")
    found = near.drop("rank").unionByName(_local(data, routed, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame) -> DataFrame:
    """The ten best of every vector whose id is divisible by 100."""
    return knn_join(vectors, F.col("vec_id") % 100 == 0)
