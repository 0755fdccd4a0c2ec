"""Score maps of a query grid against a tile grid: local matching, offsets, correlation.

An image's patches are packed into one matrix; each candidate pair is one matrix
product in Arrow, and what leaves it are maps and scores, not pairs of patches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import vector as V

PAIR = ["query_idx", "tile_idx"]
_TYPES = {"long": pa.int64(), "double": pa.float64()}


def packed(patches: DataFrame, names: list[str]) -> DataFrame:
    """patches: image_idx, desc and the named whole numbers.  A row for each image: its size, the numbers and unit vectors, in order of the numbers."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([(n, "ascending") for n in names])
        numbers = np.stack([t.column(n).to_numpy() for n in names], 1).astype("<i8")
        m = t.column("desc").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), V.EPS)
        return pa.table({"image_idx": t.column("image_idx").slice(0, 1), "size": pa.array([len(t)], pa.int64()), "numbers": pa.array([numbers.tobytes()], pa.binary()), "flat": pa.array([m.astype("<f8").tobytes()], pa.binary())})

    rows = patches.select(F.col("image_idx").cast("long").alias("image_idx"), *[F.col(n).cast("long").alias(n) for n in names], V.as_double("desc").alias("desc"))
    return rows.groupBy("image_idx").applyInArrow(pack, "image_idx long, size long, numbers binary, flat binary")


def per_pair(pairs: DataFrame, queries: DataFrame, tiles: DataFrame, names: list[str], run: Callable[..., Iterator[np.ndarray]], columns: str) -> DataFrame:
    """pairs: query_idx, tile_idx.  What run(query numbers, query matrix, tile numbers, tile matrix) gives for each pair: the columns after PAIR."""
    side = lambda df, key: packed(df, names).toDF(key, *[f"{key}_{c}" for c in ("size", "numbers", "flat")])
    both = pairs.select(*[F.col(c).cast("long").alias(c) for c in PAIR]).join(side(queries, "query_idx"), "query_idx").join(side(tiles, "tile_idx"), "tile_idx")
    fields = [c.split() for c in columns.split(", ")]

    def apply(batches):
        for b in batches:
            for r in b.to_pylist():
                args = []
                for key in PAIR:
                    n = r[f"{key}_size"]
                    args += [np.frombuffer(r[f"{key}_numbers"], "<i8").reshape(n, -1), np.frombuffer(r[f"{key}_flat"], "<f8").reshape(n, -1)]
                got = list(run(*args))
                k = len(got[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, r[c]), pa.int64()) for c in PAIR] + [pa.array(g, _TYPES[t]) for g, (_, t) in zip(got, fields)], names=[*PAIR, *[n for n, _ in fields]])

    return both.mapInArrow(apply, f"query_idx long, tile_idx long, {columns}")


def patch_pairs(pairs: DataFrame, queries: DataFrame, tiles: DataFrame) -> DataFrame:
    """queries and tiles: image_idx, p, desc.  Cosine of every patch pair of each candidate pair: qp, tp, sim.  All pairs are what is asked for."""

    def run(qp, q, tp, t):
        yield np.repeat(qp[:, 0], len(t))
        yield np.tile(tp[:, 0], len(q))
        yield (q @ t.T).ravel()

    return per_pair(pairs, queries, tiles, ["p"], run, "qp long, tp long, sim double")


def _best_mean(m: np.ndarray, k: int) -> np.ndarray:
    """Of each row the mean of its k largest values (all, if fewer)."""
    k = max(1, min(k, m.shape[1]))
    return np.sort(m, axis=1)[:, -k:].mean(1)


def similarity_map(pairs: DataFrame, queries: DataFrame, tiles: DataFrame, m: int) -> DataFrame:
    """For each tile patch the mean of its m best query patches: tp, v."""

    def run(qp, q, tp, t):
        yield tp[:, 0]
        yield _best_mean(t @ q.T, m)

    return per_pair(pairs, queries, tiles, ["p"], run, "tp long, v double")


def mutual_nearest(pairs: DataFrame, queries: DataFrame, tiles: DataFrame) -> DataFrame:
    """Mean similarity of patches that are each other's best, and their number; without one, the mean of the query patches' best.

    Equal similarities (to nine places) go to the smaller patch.
    """

    def run(qp, q, tp, t):
        s = q @ t.T
        near = np.round(s, 9)
        of_q, of_t = near.argmax(1), near.argmax(0)
        rows = np.arange(len(q))
        both = of_t[of_q] == rows
        best = s[rows, of_q]
        yield np.array([best[both].mean() if both.any() else best.mean()])
        yield np.array([both.sum()])

    return per_pair(pairs, queries, tiles, ["p"], run, "score double, n_mutual long")


def match_scores(pairs: DataFrame, queries: DataFrame, tiles: DataFrame, method: str, m: int) -> DataFrame:
    """score of each pair.  cosine_pool: mean of the m best of the query patches' maxima; sim_map: of the map; mutual_nn."""
    if method == "mutual_nn":
        return mutual_nearest(pairs, queries, tiles).select(*PAIR, "score")
    if method not in ("cosine_pool", "sim_map"):
        raise ValueError(f"unknown method {method}")

    def run(qp, q, tp, t):
        best = (q @ t.T).max(1) if method == "cosine_pool" else _best_mean(t @ q.T, m)
        yield _best_mean(best[None, :], m)

    return per_pair(pairs, queries, tiles, ["p"], run, "score double")


def soft_argmax(maps: DataFrame, grid_h: int, grid_w: int, temperature: float = 15.0, extent: float = 1.0) -> DataFrame:
    """maps: tp (row-major), v.  Expected cell centre under a softmax, from -0.5 to 0.5, times the extent."""
    w = Window.partitionBy(*PAIR)
    e = maps.withColumn("_e", F.exp(temperature * (F.col("v") - F.max("v").over(w))))
    x, y = (F.col("tp") % grid_w + 0.5) / grid_w - 0.5, (F.floor(F.col("tp") / grid_w) + 0.5) / grid_h - 0.5
    return e.groupBy(*PAIR).agg((F.sum(F.col("_e") * x) / F.sum("_e") * extent).alias("px"), (F.sum(F.col("_e") * y) / F.sum("_e") * extent).alias("py"))


def ncc_map(pairs: DataFrame, queries: DataFrame, tiles: DataFrame, q_size: tuple[int, int], t_size: tuple[int, int], eps: float = 1e-6) -> DataFrame:
    """Normalised cross-correlation of the query grid at each place inside the tile grid: dy, dx, v.

    queries and tiles: image_idx, row, col, desc.  A place's score follows from the
    sums of the products, of the tile's vectors and of their squares below the query.
    """
    (qh, qw), (th, tw) = q_size, t_size
    if qh > th or qw > tw:
        raise ValueError("the query grid must fit into the tile grid")

    def run(q_at, q, t_at, t):
        product = np.zeros((len(q), th, tw))
        product[:, t_at[:, 0], t_at[:, 1]] = q @ t.T
        sums, squares = np.zeros((th, tw)), np.zeros((th, tw))
        sums[t_at[:, 0], t_at[:, 1]], squares[t_at[:, 0], t_at[:, 1]] = t.sum(1), (t * t).sum(1)
        total, total2, numel = q.sum(), (q * q).sum(), q.size
        mean = total / numel
        q_norm = max(np.sqrt(max(total2 - total * mean, 0.0)), eps)
        dy, dx = (a.ravel() for a in np.mgrid[0 : th - qh + 1, 0 : tw - qw + 1])
        v = np.empty(len(dy))
        for i, (y, x) in enumerate(zip(dy, dx)):
            r, c = q_at[:, 0] + y, q_at[:, 1] + x
            ts, ts2 = sums[r, c].sum(), squares[r, c].sum()
            v[i] = (product[np.arange(len(q)), r, c].sum() - mean * ts) / (q_norm * np.sqrt(max(ts2 - ts * ts / numel, eps)))
        yield dy
        yield dx
        yield v

    return per_pair(pairs, queries, tiles, ["row", "col"], run, "dy long, dx long, v double")


def ncc_offset(maps: DataFrame, q_size: tuple[int, int], t_size: tuple[int, int], extent: float) -> DataFrame:
    """The first best place (row by row), as the offset of the query's centre."""
    (qh, qw), (th, tw) = q_size, t_size
    best = maps.groupBy(*PAIR).agg(F.max_by(F.struct("dy", "dx"), F.struct(F.round("v", 9), -(F.col("dy") * tw + F.col("dx")))).alias("b"))
    centre = lambda c, q, t: ((F.col(c) + (q - 1) / 2 + 0.5) / t - 0.5) * extent
    return best.select(*PAIR, centre("b.dx", qw, tw).alias("px"), centre("b.dy", qh, th).alias("py"))
