"""Recall, precision, offset and localisation metrics; one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recall_at_k(ranking: DataFrame, gt: DataFrame, ks: list[int]) -> DataFrame:
    """ranking: query_id, rank, db_id; gt: query_id, gt (null: not valid).  k, recall, n_valid.

    k beyond a ranking's width counts its whole width.
    """
    hit = ranking.join(gt, "query_id").where("db_id = gt").groupBy("query_id").agg(F.min("rank").alias("hit"))
    valid = gt.where("gt is not null").join(hit, "query_id", "left")
    each = valid.select("hit", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return each.groupBy(F.col("k").cast("long").alias("k")).agg(F.avg(F.coalesce((F.col("hit") <= F.col("k")).cast("double"), F.lit(0.0))).alias("recall"), F.count(F.lit(1)).alias("n_valid"))


def recall_any(ranking: DataFrame, positives: DataFrame, ks: list[int]) -> DataFrame:
    """positives: query_id, db_id.  The share of queries with any positive among the first k."""
    hits = ranking.join(positives, ["query_id", "db_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("hit"))
    each = ranking.select("query_id").distinct().join(hits, "query_id", "left").select("hit", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    found = F.coalesce((F.col("hit") <= F.col("k")).cast("double"), F.lit(0.0))
    return each.groupBy(F.col("k").cast("long").alias("k")).agg(F.sum(found).cast("long").alias("n_hit"), F.avg(found).alias("recall"))


def precision_at_hits(ranking: DataFrame, positives: DataFrame) -> DataFrame:
    """Running hits and precision at each rank."""
    marked = ranking.join(positives.withColumn("hit", F.lit(1)), ["query_id", "db_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)).cast("long"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("hits", F.sum("hit").over(w)).withColumn("precision", F.col("hits") / F.col("rank"))


def map_at_k(ranking: DataFrame, positives: DataFrame, k: int, counts: DataFrame | None = None) -> DataFrame:
    """The mean over queries with positives of sum(precision at hits) / min(positives, k).

    counts: query_id, n (positives in all), if `positives` holds only those within the ranking.
    """
    sums = precision_at_hits(ranking.where(F.col("rank") <= k), positives).where("hit = 1").groupBy("query_id").agg(F.sum("precision").alias("s"))
    n = counts if counts is not None else positives.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ap = n.join(sums, "query_id", "left").select((F.coalesce("s", F.lit(0.0)) / F.least("n", F.lit(k))).alias("ap"))
    return ap.agg(F.avg("ap").alias("map"), F.count(F.lit(1)).alias("n_valid"))


def mean_reciprocal_rank(ranking: DataFrame, gt: DataFrame, k: int) -> DataFrame:
    hit = ranking.where(F.col("rank") <= k).join(gt, "query_id").where("db_id = gt").groupBy("query_id").agg(F.min("rank").alias("r"))
    return gt.where("gt is not null").join(hit, "query_id", "left").agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("n_valid"))


def error_summary(errors: DataFrame, thresholds: list[int], prefix: str) -> DataFrame:
    """errors: err (null rows do not count).  Mean, median, count and the share of errors up to each threshold."""
    ok = errors.where("err is not null")
    return ok.agg(F.avg("err").alias(f"{prefix}_mean"), F.median("err").alias(f"{prefix}_median"), F.count("err").alias(f"{prefix}_count"), *[F.avg((F.col("err") <= t).cast("double")).alias(f"{prefix}_sr{t}") for t in thresholds])


def offset_errors(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """pred: query_idx, px, py; gt: query_idx, dx, dy."""
    return pred.join(gt, "query_idx").select("query_idx", F.sqrt((F.col("px") - F.col("dx")) ** 2 + (F.col("py") - F.col("dy")) ** 2).alias("err"))


def localization_errors(pred: DataFrame, gt: DataFrame, tiles: DataFrame) -> DataFrame:
    """Distance of predicted and true point; without centres only where the tile is right, else null.

    pred: query_idx, tile, px, py; gt: query_idx, gt_tile, dx, dy; tiles: image_idx, cx, cy (null: no centre).
    """
    t, g = tiles.select(F.col("image_idx").alias("tile"), F.col("cx").alias("tx"), F.col("cy").alias("ty")), tiles.select(F.col("image_idx").alias("gt_tile"), F.col("cx").alias("gx"), F.col("cy").alias("gy"))
    both = pred.join(gt, "query_idx").join(t, "tile", "left").join(g, "gt_tile", "left")
    far = F.sqrt((F.col("tx") + F.col("px") - F.col("gx") - F.col("dx")) ** 2 + (F.col("ty") + F.col("py") - F.col("gy") - F.col("dy")) ** 2)
    near = F.sqrt((F.col("px") - F.col("dx")) ** 2 + (F.col("py") - F.col("dy")) ** 2)
    known = F.col("tx").isNotNull() & F.col("gx").isNotNull()
    return both.select("query_idx", F.when(known, far).when(F.col("tile") == F.col("gt_tile"), near).alias("err"))
