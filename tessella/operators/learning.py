"""Vocabularies, projections and sampling; every seed is a parameter."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import vector as V
from tessella.operators.pooling import assign


def fit_vocabulary(descriptors: DataFrame, k: int, seed: int = 42, measure: str = "cosine", max_iter: int = 20) -> DataFrame:
    """k, c: centres of unit-length descriptors; fewer than k of them is an error."""
    unit = descriptors.select(V.l2_normalize(F.col("desc")).alias("d"))
    if unit.limit(k).count() < k:
        raise ValueError(f"fewer than {k} descriptors")
    model = KMeans(k=k, seed=seed, distanceMeasure=measure, maxIter=max_iter, featuresCol="v").fit(unit.select(array_to_vector("d").alias("v")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return descriptors.sparkSession.createDataFrame(rows, "k long, c array<double>")


def lloyd_step(patches: DataFrame, centers: DataFrame) -> DataFrame:
    """Means of the patches of each centre: k, pos, x."""
    rows = assign(patches, centers).select("k", F.posexplode("desc").alias("pos", "v"))
    return rows.groupBy("k", F.col("pos").cast("long").alias("pos")).agg(F.avg("v").alias("x"))


def by_hash(seed: int, *ids: str):
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def uniform(*parts) -> Column:
    """A number in [0, 1) told by a hash of the parts alone, so that no partitioning changes it."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha1(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def gaussian(*parts) -> Column:
    """A standard normal number from two such uniforms."""
    return F.sqrt(-2 * F.log(1 - uniform(*parts, "r"))) * F.cos(2 * math.pi * uniform(*parts, "a"))


def block_sample(tiles: DataFrame, count: int, grid: int, seed: int) -> DataFrame:
    """tiles: tile_id, row, col.  One tile of each of sqrt(count) x sqrt(count) blocks; 8 is 2 x 2 blocks of two tiles; in order of a seeded hash."""
    side, per = (2, 2) if count == 8 else (int(round(count**0.5)), 1)
    if side * side * per != count or grid % side:
        raise ValueError(f"no blocks for {count} tiles on a grid of {grid}")
    size = grid // side
    w = Window.partitionBy(F.floor(F.col("row") / size), F.floor(F.col("col") / size)).orderBy(by_hash(seed, "tile_id"), "tile_id")
    return tiles.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).drop("_r")


def capped_sample(rows: DataFrame, by: str, id: str, cap: int, seed: int) -> DataFrame:
    """At most `cap` rows of each group, in order of a seeded hash, which no partitioning changes."""
    w = Window.partitionBy(by).orderBy(by_hash(seed, by, id), id)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def file_sample(files: DataFrame, name: str, ratio: float, seed: int, most: int | None = None) -> DataFrame:
    """round(ratio * n) files, one at least, in order of a seeded hash; of those the first `most` by name."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio lies in (0, 1]")
    if most is not None and most < 1:
        raise ValueError("most must be positive")
    k = max(1, round(files.count() * ratio))
    out = files.orderBy(by_hash(seed, name), name).limit(k)
    return out if most is None else out.orderBy(name).limit(most)


def ratio_sample(rows: DataFrame, file: str, id: str, ratio: float, per_file: int | None, total: int | None, seed: int, most_files: int | None = None) -> DataFrame:
    """Rows of sampled files, at most `per_file` of each and `total` of all, by seeded hashes."""
    chosen = file_sample(rows.select(file).distinct(), file, ratio, seed, most_files)
    out = rows.join(chosen, file, "left_semi")
    if per_file is not None:
        out = capped_sample(out, file, id, per_file, seed)
    return out if total is None else out.orderBy(by_hash(seed, file, id), file, id).limit(total)


def vocabulary_sweep(patches: DataFrame, tiles: DataFrame, grid: int, counts: tuple[int, ...], k: int, seed: int = 42) -> DataFrame:
    """A vocabulary for each number of tiles, of tiles spread over the grid.  tiles: image_idx, tile_id, row, col.  tiles, k, c."""
    out = None
    for n in sorted(set(counts)):
        chosen = tiles if n == grid * grid else block_sample(tiles, n, grid, seed)
        v = fit_vocabulary(patches.join(chosen.select("image_idx"), "image_idx", "left_semi"), k, seed).select(F.lit(n).cast("long").alias("tiles"), "k", "c")
        out = v if out is None else out.unionByName(v)
    return out


def inertia(descriptors: DataFrame, centers: DataFrame) -> DataFrame:
    """One row: the mean over unit descriptors of 1 - cosine to the nearest centre, and their number."""
    near = assign(descriptors.withColumn("desc", V.l2_normalize(F.col("desc"))), centers)
    return near.agg(F.avg(1 - F.col("sim")).alias("inertia"), F.count(F.lit(1)).alias("n"))


def moments(rows: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (n - 1) and count; summed in the executors, one small matrix from each task."""

    def run(batches):
        n, s, ss = 0, None, None
        for b in batches:
            if len(b):
                m = np.stack(b[vec].to_numpy()).astype(float)
                s, ss, n = (m.sum(0) if s is None else s + m.sum(0)), (m.T @ m if ss is None else ss + m.T @ m), n + len(m)
        if n:
            yield pd.DataFrame({"i": range(len(s)), "n": n, "s": s, "ss": list(ss)})

    parts = rows.select(vec).mapInPandas(run, "i int, n long, s double, ss array<double>")
    width = parts.select(F.size("ss")).first()[0]
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array(*[F.sum(F.col("ss")[j]) for j in range(width)]).alias("ss")).orderBy("i").collect()  # a row for each dimension
    n, s, ss = got[0]["n"], np.array([r["s"] for r in got]), np.array([r["ss"] for r in got])
    mean = s / n
    return mean, (ss - n * np.outer(mean, mean)) / max(n - 1, 1), n


def _axes(cov: np.ndarray, dims: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and directions, the largest first and `low` of them from the smallest; the largest part of each is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = [*range(dims - low), *range(len(values) - low, len(values))]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), range(len(values))])
    return values[keep], (vectors * sign)[:, keep]


def _project(df: DataFrame, vec: str, mean: np.ndarray, axes: np.ndarray, unit: bool) -> DataFrame:
    """(v - mean) @ axes, batch by batch; mean and axes are broadcast (one matrix of the fitted width)."""
    told = df.sparkSession.sparkContext.broadcast((mean, axes))

    def run(batch: pd.Series) -> pd.Series:
        m, a = told.value
        out = (np.stack(batch.to_numpy()) - m) @ a
        if unit:
            out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), V.EPS)
        return pd.Series(list(out))

    return df.withColumn(vec, F.pandas_udf(run, "array<double>")(F.col(vec)))


def pca(fit_on: DataFrame, vec: str, dims: int, whiten: bool = False, low_factor: float = 0.0):
    """A function that reduces a vector column: centred by the fitted mean, projected, optionally whitened, unit length.

    low_factor takes that share of the directions from the smallest eigenvalues.
    """
    mean, cov, _ = moments(fit_on, vec)
    values, axes = _axes(cov, dims, int(dims * low_factor))
    if whiten:
        axes = axes / np.sqrt(np.maximum(values, 1e-12))
    return lambda df: _project(df, vec, mean, axes, unit=True)


def reduce_pca(train: DataFrame, test: DataFrame, vec: str, dims: int, low_factor: float = 0.0, fallback: int = 0) -> tuple[DataFrame, DataFrame]:
    """Both sides reduced by axes of the training side, without unit length.

    With a low_factor and fewer training rows than dimensions, both are first
    reduced together to `fallback` dimensions, for the smallest directions would be empty.
    """
    if not 0 <= low_factor <= 1:
        raise ValueError("low_factor lies in [0, 1]")
    mean, cov, n = moments(train, vec)
    if low_factor and n < len(mean):
        if not dims <= fallback <= len(mean):
            raise ValueError(f"{n} rows of {len(mean)} dimensions: fallback has to be between {dims} and {len(mean)}")
        both_mean, both_cov, _ = moments(train.select(vec).unionByName(test.select(vec)), vec)
        _, axes = _axes(both_cov, fallback, 0)
        train, test = (_project(x, vec, both_mean, axes, unit=False) for x in (train, test))
        mean, cov, _ = moments(train, vec)
    _, axes = _axes(cov, dims, int(dims * low_factor))
    return _project(train, vec, mean, axes, unit=False), _project(test, vec, mean, axes, unit=False)


def sample_points(spark, n: int, canvas: tuple[int, int], query: tuple[int, int], seed: int, tile: tuple[int, int] | None = None) -> DataFrame:
    """id, cx, cy of n query centres, one at most on each rounded pixel, from seeded draws in parallel; too few is an error.

    canvas, query, tile: height and width.  A query stays inside the canvas, and with
    `tile` inside one tile, drawn first; draws end after twenty for each point (1,000 at least).
    """
    (h, w), (qh, qw) = canvas, query
    th, tw = tile or canvas
    rows, cols = h // th, w // tw
    if qh > th or qw > tw or not rows or not cols:
        raise ValueError(f"a query of {query} does not fit into {tile or canvas}")
    draws = spark.range(max(1000, 20 * n))
    part = lambda name: uniform(seed, F.col("id"), name)
    cell = F.floor(part("tile") * (rows * cols)).cast("long")
    x = F.pmod(cell, F.lit(cols)) * tw + qw / 2 + part("x") * (tw - qw)
    y = F.floor(cell / cols) * th + qh / 2 + part("y") * (th - qh)
    points = draws.select("id", x.cast("double").alias("cx"), y.cast("double").alias("cy"))
    first = points.groupBy(F.rint("cx"), F.rint("cy")).agg(F.min_by(F.struct("id", "cx", "cy"), "id").alias("p")).select("p.*")
    out = first.orderBy("id").limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} distinct points")
    return out
