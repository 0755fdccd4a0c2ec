"""From patches to metrics: image vectors, exact search, local re-ranking, offsets, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import PipelineConfig
from tessella.operators import evaluation as E
from tessella.operators import learning as L
from tessella.operators import maps as A
from tessella.operators import pooling as P
from tessella.operators import retrieval as R
from tessella.operators import segments as S
from tessella.stages import stored


@dataclass(frozen=True)
class Run:
    bank: DataFrame
    ranking: DataFrame
    offsets: DataFrame
    metrics: DataFrame


def image_vectors(patches: DataFrame, config: PipelineConfig, centers: DataFrame | None = None) -> DataFrame:
    """image_idx, v: one vector for each image; centres without patches give zeros."""
    if config.aggregation == "vlad":
        if centers is None:
            raise ValueError("residual aggregation needs a vocabulary")
        unit = P.normalized(patches)
        long = P.vlad_soft(unit, centers) if config.soft_assignment else P.vlad(P.assign(unit, centers), ["image_idx"])
        return P.dense(long, ["image_idx"], centers)
    if config.aggregation == "cls":
        return P.pooled(patches.where("p = 0"), "gap", ["image_idx"])
    return P.pooled(patches, config.aggregation, ["image_idx"], p=config.gem_p)


def segment_vectors(patches: DataFrame, masks: DataFrame, config: PipelineConfig, grid: tuple[int, int], centers: DataFrame | None = None) -> DataFrame:
    """masks: image_idx, seg, p.  image_idx, seg, v: a vector for each segment and its neighbours (`neighbours`
    nearest, over `order` hops), with weighted position encodings where the configuration asks for them."""
    cells = masks.select("image_idx", "seg", "p", F.floor(F.col("p") / grid[1]).alias("row"), (F.col("p") % grid[1]).alias("col"))
    cents = S.centroids(cells)
    near = S.knn_adjacency(cents, config.neighbours)
    expanded = P.expand_masks(masks.select("image_idx", "seg", "p"), S.hops(near, config.order))
    by = ["image_idx", "seg"]
    if config.aggregation == "vlad":
        if centers is None:
            raise ValueError("residual aggregation needs a vocabulary")
        vectors = P.dense(P.segment_vlad(P.normalized(patches), centers, expanded), by, centers)
    elif config.aggregation == "gap":
        joined = expanded.join(P.normalized(patches).select("image_idx", "p", "desc"), ["image_idx", "p"])
        vectors = P.pooled(joined, "gap", by)
    else:
        raise ValueError(f"no segment vectors by {config.aggregation}")
    added = []
    if config.centroid_weight or config.context_weight:
        own, context = S.encodings(cents, near, *grid, config.centroid_frequencies, config.context_frequencies)
        added = [(e, w) for e, w in ((own, config.centroid_weight), (context, config.context_weight)) if w]
    return P.with_encodings(vectors, added, by)


def _sampled(queries: DataFrame, tiles: DataFrame, config: PipelineConfig) -> tuple[DataFrame, DataFrame]:
    return queries.where(F.col("image_idx") % config.sub_sample_queries == 0), tiles.where(F.col("image_idx") % config.sub_sample_db == 0)


def _vocabulary(tiles: DataFrame, config: PipelineConfig, centers: DataFrame | None) -> DataFrame | None:
    return L.fit_vocabulary(tiles.select("desc"), config.num_clusters, config.seed) if config.aggregation == "vlad" and centers is None else centers


def _finished(bank: DataFrame, ranking: DataFrame, q: DataFrame, t: DataFrame, gt: DataFrame, config: PipelineConfig, grid: tuple[int, int], extent: float) -> Run:
    """What both runs do after the coarse ranking: local re-ranking, offsets of the first tile, metrics."""
    if config.rerank:
        first = ranking.where(F.col("rank") <= config.coarse_top_k)
        near = first.select(F.col("query_id").alias("query_idx"), F.col("db_id").alias("tile_idx"))
        local = A.match_scores(near, q, t, config.matcher, config.top_m).toDF("query_id", "db_id", "local")
        ranking = R.rerank(first, local, config.alpha).select("query_id", F.col("new_rank").alias("rank"), "db_id", F.col("fused").alias("sim"))
    ranking = stored(ranking.select("query_id", "rank", "db_id", "sim"), "ranking")  # offsets and metrics both read it
    top = ranking.where("rank = 1").select(F.col("query_id").alias("query_idx"), F.col("db_id").alias("tile_idx"))
    if config.offset == "slide_ncc":
        offsets = A.ncc_offset(A.ncc_map(top, q, t, grid, grid), grid, grid, extent)
    else:
        offsets = A.soft_argmax(A.similarity_map(top, q, t, config.top_m), *grid, config.temperature, extent)
    recall = E.recall_at_k(ranking, gt.select("query_id", "gt"), list(config.top_k_vals))
    errors = E.error_summary(E.offset_errors(offsets.select("query_idx", "px", "py"), gt.select(F.col("query_id").alias("query_idx"), "dx", "dy")), list(config.thresholds), "offset")
    wide = recall.groupBy().agg(*[F.max(F.when(F.col("k") == k, F.col("recall"))).alias(f"recall_{k}") for k in config.top_k_vals])
    return Run(bank, ranking, offsets, wide.join(errors, F.lit(True)))  # one row beside one row


def retrieve(queries: DataFrame, tiles: DataFrame, gt: DataFrame, config: PipelineConfig, grid: tuple[int, int], extent: float = 512.0, centers: DataFrame | None = None) -> Run:
    """A run by image vectors.  queries, tiles: patches of either side; gt: query_id, gt (tile), dx, dy."""
    q, t = _sampled(queries, tiles, config)
    centers = _vocabulary(t, config, centers)
    bank = stored(image_vectors(t, config, centers), "bank")
    asked = image_vectors(q, config, centers).select(F.col("image_idx").alias("query_id"), F.col("v").alias("q"))
    ranking = R.top_k_blocks(asked, bank.select(F.col("image_idx").alias("db_id"), F.col("v").alias("e")), config.width)
    return _finished(bank, ranking, q, t, gt, config, grid, extent)


def retrieve_segments(queries: DataFrame, tiles: DataFrame, query_masks: DataFrame, tile_masks: DataFrame, gt: DataFrame, config: PipelineConfig, grid: tuple[int, int], extent: float = 512.0, centers: DataFrame | None = None) -> Run:
    """A run by segments: each query segment's `segment_top_k` best segments vote for their images, by `vote`.

    Masks: image_idx, seg, p.  Images without a vote rank with 0.
    """
    q, t = _sampled(queries, tiles, config)
    centers = _vocabulary(t, config, centers)
    vectors = lambda patches, masks: segment_vectors(patches, masks.join(patches.select("image_idx").distinct(), "image_idx", "left_semi"), config, grid, centers)
    bank, asked = stored(vectors(t, tile_masks), "bank"), stored(vectors(q, query_masks), "asked")
    hits = stored(R.segment_top_k(asked.withColumnRenamed("v", "e"), bank.withColumnRenamed("v", "e"), config.segment_top_k), "hits")
    votes = R.vote_sum(hits) if config.vote == "sum" else R.vote_weighted(hits)
    ranked = R.rank_votes(votes, t.select("image_idx").distinct(), config.width)
    ranking = ranked.select(F.col("query_idx").alias("query_id"), "rank", F.col("image_idx").alias("db_id"), F.col("score").alias("sim"))
    return _finished(bank, ranking, q, t, gt, config, grid, extent)
