"""Writers of stage tables, vocabularies, manifests and run results."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_patches(patches: DataFrame, path: str, key: str) -> DataFrame:
    """Patches below a key of content and configuration; what is there already is kept and read."""
    target = f"{path}/{key}"
    patches.write.mode("ignore").parquet(target)
    return patches.sparkSession.read.parquet(target)


def _one_line(spark: SparkSession, value: Mapping, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_vocabulary(centers: DataFrame, path: str, **facts) -> None:
    """Centres as Parquet, and what they were made from as JSON beside them."""
    centers.coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    _one_line(centers.sparkSession, facts | {"num_clusters": centers.count()}, f"{path}/facts")


def write_manifests(tiles: DataFrame, queries: DataFrame, path: str, **summary) -> None:
    tiles.write.mode("overwrite").json(f"{path}/tiles")
    queries.write.mode("overwrite").json(f"{path}/queries")
    _one_line(tiles.sparkSession, summary | {"tiles": tiles.count(), "queries": queries.count()}, f"{path}/summary")


def write_metrics(metrics: DataFrame, path: str, prefix: str = "") -> dict:
    """A one-row table of metrics as sorted JSON."""
    row = {prefix + k: v for k, v in metrics.first().asDict().items()}
    _one_line(metrics.sparkSession, row, path)
    return row


def write_run(config: Mapping, metrics: Mapping, ranking: DataFrame, path: str, offsets: DataFrame | None = None, tiles: DataFrame | None = None, queries: DataFrame | None = None) -> None:
    """Configuration and metrics as one JSON line; rankings with scores, predicted offsets and path lists as tables beside it.

    ranking: query_id, rank, db_id, sim; offsets: query_idx, px, py; tiles, queries: an index and relpath.
    """
    _one_line(ranking.sparkSession, {"Run-Config": dict(config)} | dict(metrics), f"{path}/result")
    ranking.write.mode("overwrite").parquet(f"{path}/ranking")
    nested = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "db_id", "sim"))).alias("results"))
    nested.write.mode("overwrite").json(f"{path}/ranking_json")
    for name, table in (("offsets", offsets), ("tiles", tiles), ("queries", queries)):
        if table is not None:
            table.write.mode("overwrite").json(f"{path}/{name}")


def read_run(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """What write_run has written: the JSON line, and the ranking."""
    return json.loads(spark.read.text(f"{path}/result").first()[0]), spark.read.parquet(f"{path}/ranking")


def write_tiles(image: DataFrame, tile: tuple[int, int], path: str) -> DataFrame:
    """image: image_id, height, width, channels, pixels (bytes, row by row).  Tiles as rows of a table, and their manifest.

    Parts that do not fill a tile are left out.  tile_id, image, center, extent, row, col, bbox of each.
    """
    import numpy as np
    import pandas as pd

    th, tw = tile
    schema = "image_id long, tile_id string, row int, col int, height int, width int, channels int, pixels binary"

    def cut(batches):
        for b in batches:
            for r in b.itertuples():
                grid = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, r.channels)
                at = [(i, j) for i in range(r.height // th) for j in range(r.width // tw)]
                if at:
                    yield pd.DataFrame([(r.image_id, f"tile_r{i:02d}_c{j:02d}", i, j, th, tw, r.channels, grid[i * th : (i + 1) * th, j * tw : (j + 1) * tw].tobytes()) for i, j in at], columns=[c.split()[0] for c in schema.split(", ")])

    image.mapInPandas(cut, schema).write.mode("overwrite").partitionBy("image_id").parquet(f"{path}/tiles")
    tiles = image.sparkSession.read.parquet(f"{path}/tiles")
    side = lambda c, n: F.col(c) * n
    corners = F.array(side("col", tw), side("row", th), side("col", tw) + tw, side("row", th) + th).cast("array<long>")
    centre = F.array(side("col", tw) + tw / 2, side("row", th) + th / 2)
    manifest = tiles.select(F.col("image_id").cast("long").alias("image_id"), "tile_id", F.concat(F.lit("tiles/image_id="), "image_id", F.lit("/"), "tile_id").alias("image"), centre.alias("center"), F.array(F.lit(float(tw)), F.lit(float(th))).alias("extent"), "row", "col", corners.alias("bbox"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


# Columns of the table of masks, in their order.
MASK_COLUMNS = ("id", "area", "bbox_x0", "bbox_y0", "bbox_w", "bbox_h", "point_input_x", "point_input_y", "predicted_iou", "stability_score", "crop_box_x0", "crop_box_y0", "crop_box_w", "crop_box_h")


def write_mask_table(masks: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """masks: the columns above; a CSV with them as header.  runs (id, counts, height, width): run lengths as JSON beside it."""
    masks.select(*MASK_COLUMNS).write.mode("overwrite").option("header", True).csv(f"{path}/metadata")
    if runs is not None:
        runs.select("id", F.struct(F.array("height", "width").alias("size"), "counts").alias("segmentation")).write.mode("overwrite").json(f"{path}/rle")


def log_run(results: Mapping, logger=None) -> bool:
    """Hands a run's results to a logger's `log`, if there is one; tells whether it did."""
    if logger is None:
        return False
    logger.log(dict(results))
    return True


def write_masks(masks: DataFrame, path: str) -> None:
    masks.write.mode("overwrite").option("header", True).csv(path)
