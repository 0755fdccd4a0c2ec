"""Column functions and generated tables over grids, tiles, crops, boxes and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.least(v, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)


def crop_to_stride(h: Column, w: Column, stride: int) -> tuple[Column, Column, Column, Column]:
    """Cropped height and width, and the patch grid; an image smaller than a patch is an error."""
    gh, gw = F.floor(h / stride).cast("long"), F.floor(w / stride).cast("long")
    guard = lambda c: F.when((gh == 0) | (gw == 0), F.raise_error(F.lit("image smaller than a patch")).cast("long")).otherwise(c)
    return guard(gh * stride), guard(gw * stride), guard(gh), guard(gw)


def center_crop(h: Column, w: Column, crop_h: Column, crop_w: Column) -> tuple[Column, Column]:
    """Top and left with whole-number halves."""
    return F.floor((h - crop_h) / 2).cast("long"), F.floor((w - crop_w) / 2).cast("long")


def center_crop_even(center: Column, size: Column) -> Column:
    """The start of a crop around a centre, halves rounded to even."""
    return F.bround(center - size / 2, 0).cast("long")


def rotation_support(h: Column, w: Column) -> Column:
    return F.ceil(F.sqrt((h * h + w * w).cast("double"))).cast("long")


def offset_to_grid(dx: Column, dy: Column, ew: Column, eh: Column, gh: int, gw: int, flip_y: bool = False) -> tuple[Column, Column]:
    """Grid position of an offset from the tile's centre."""
    y = -dy if flip_y else dy
    return (dx / ew + 0.5) * gw - 0.5, (y / eh + 0.5) * gh - 0.5


def grid_to_offset(gx: Column, gy: Column, ew: Column, eh: Column, gh: int, gw: int) -> tuple[Column, Column]:
    return ((gx + 0.5) / gw - 0.5) * ew, ((gy + 0.5) / gh - 0.5) * eh


def point_to_tile(x: Column, y: Column, size: int, rows: int, cols: int) -> tuple[Column, Column, Column, Column, Column]:
    """Row, column, id, and the offset from the tile's centre."""
    r, c = clamp(F.floor(y / size), 0, rows - 1).cast("long"), clamp(F.floor(x / size), 0, cols - 1).cast("long")
    return r, c, F.format_string("tile_r%02d_c%02d", r, c), x - (c + 0.5) * size, y - (r + 0.5) * size


def tile_grid(spark: SparkSession, rows: int, cols: int, size: int) -> DataFrame:
    """tile_id, row, col, centre, extent and box of a regular grid."""
    g = spark.range(rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("col"))
    return g.select(F.format_string("tile_r%02d_c%02d", "row", "col").alias("tile_id"), "row", "col", ((F.col("col") + 0.5) * size).cast("double").alias("cx"), ((F.col("row") + 0.5) * size).cast("double").alias("cy"), (F.col("col") * size).alias("x0"), (F.col("row") * size).alias("y0"), ((F.col("col") + 1) * size).alias("x1"), ((F.col("row") + 1) * size).alias("y1"))


def overlap_starts(spark: SparkSession, full: int, tile: int, overlap: int) -> DataFrame:
    """Starts at tile - overlap, and one last start flush with the end."""
    step, last = tile - overlap, max(full - tile, 0)
    return spark.range(0, last + 1, step).select(F.col("id").alias("start")).union(spark.range(last, last + 1).select("id")).distinct()


def point_grid(spark: SparkSession, n: int) -> DataFrame:
    """n x n cell centres in the unit square."""
    g = spark.range(n).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("c"))
    return g.select("r", "c", ((F.col("c") + 0.5) / n).cast("double").alias("x"), ((F.col("r") + 0.5) / n).cast("double").alias("y"))


def crop_pyramid(spark: SparkSession, h: int, w: int, layers: int, ratio: float) -> DataFrame:
    """Boxes of layer 0 (the whole) and of 2**i crops a side in layer i, overlapping by ratio * short side * 2 / n."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("layer"), F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), F.lit(w).cast("long").alias("x1"), F.lit(h).cast("long").alias("y1"))
    for layer in range(1, layers + 1):
        n = 2**layer
        over = int(ratio * min(h, w) * (2 / n))
        cw, ch = (math.ceil((over * (n - 1) + side) / n) for side in (w, h))
        g = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("j"))
        x0, y0 = F.col("i") * (cw - over), F.col("j") * (ch - over)
        out = out.union(g.select(F.lit(layer).cast("long"), x0, y0, F.least(x0 + cw, F.lit(w).cast("long")), F.least(y0 + ch, F.lit(h).cast("long"))))
    return out


def near_crop_edge(box: list[Column], crop: list[Column], image: list[Column], within: float = 20.0) -> Column:
    """Whether any side lies at the crop's edge and not at the image's."""
    out = F.lit(False)
    for b, c, i in zip(box, crop, image):
        out = out | ((F.abs(b - c) <= within) & ~(F.abs(b - i) <= within))
    return out


def uncrop(box: list[Column], x: Column, y: Column) -> list[Column]:
    return [b + (x if i % 2 == 0 else y) for i, b in enumerate(box)]


# The side of a patch and of a unit, in pixels of the large image.
PATCH_PX, UNIT_PX = 256, 128


def norm_to_latlon(bx: Column, by: Column, xn: Column, yn: Column, size: int, lat: float, lon: float, lat_px: float, lon_px: float) -> tuple[Column, Column]:
    """From block and offset to pixels around the image's centre; latitude falls downwards."""
    pixel = lambda block, n: block * PATCH_PX + n * UNIT_PX + PATCH_PX - size / 2
    return F.lit(lat) - pixel(by, yn) * lat_px, F.lit(lon) + pixel(bx, xn) * lon_px


# Fixed value: ties height, distance, size and resolution: height * size = K * distance * resolution.
ALTITUDE_K = 204.5 * 256 / (64 * 935)


def altitude_formula(height: Column, distance: Column, size: Column, resolution: Column) -> Column:
    """The one of the four that is null; any other number of nulls is an error."""
    k, known = F.lit(ALTITUDE_K), [height, distance, size, resolution]
    nulls = sum((c.isNull().cast("int") for c in known), F.lit(0))
    out = (
        F.when(height.isNull(), k * distance * resolution / size)
        .when(distance.isNull(), height * size / (k * resolution))
        .when(size.isNull(), k * distance * resolution / height)
        .otherwise(height * size / (k * distance))
    )
    return F.when(nulls != 1, F.raise_error(F.lit("exactly one value must be missing")).cast("double")).otherwise(out)


def latlon_grid(spark: SparkSession, lat: float, lon: float, rows: int, cols: int, step_m: float) -> DataFrame:
    """A lattice of points step_m metres apart, to six places."""
    g = spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("j"))
    d = step_m / 111000
    return g.select("i", "j", F.round(F.lit(lat) + F.col("i") * d, 6).alias("lat"), F.round(F.lit(lon) + F.col("j") * d / F.cos(F.radians(F.lit(lat))), 6).alias("lon"))


def centered_lattice(spark: SparkSession, lat: float, lon: float, rows: int, cols: int, step_m: float) -> DataFrame:
    """i, j, lat, lon of a lattice around its middle; each row's step of longitude follows its own (rounded) latitude."""
    g = spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("j"))
    d = step_m / 111000
    at = g.withColumn("lat", F.round(F.lit(lat) + (F.col("i") - (rows - 1) / 2) * d, 6))
    return at.withColumn("lon", F.round(F.lit(lon) + (F.col("j") - (cols - 1) / 2) * d / F.cos(F.radians("lat")), 6))


def footprints(points: DataFrame, width_m: float, height_m: float, width_px: int, height_px: int) -> DataFrame:
    """points: lat, lon.  With the middles of the four sides of an image of that size, and degrees for each pixel."""
    shrink = F.cos(F.radians("lat"))
    half_lat, half_lon = height_m / (2 * 111000), F.lit(width_m / (2 * 111000)) / shrink
    return points.select(
        *points.columns,
        F.round(F.col("lon") - half_lon, 9).alias("left_lon"), F.round(F.col("lon") + half_lon, 9).alias("right_lon"),
        F.round(F.col("lat") + half_lat, 9).alias("top_lat"), F.round(F.col("lat") - half_lat, 9).alias("bottom_lat"),
        F.round(F.lit(width_m / (width_px * 111000)), 12).alias("lat_per_pixel"), F.round(F.lit(height_m / (height_px * 111000)) / shrink, 12).alias("lon_per_pixel"),
    )


def resize_longest(h: Column, w: Column, target: int) -> tuple[Column, Column]:
    scale = F.lit(float(target)) / F.greatest(h, w)
    return F.floor(h * scale + 0.5).cast("long"), F.floor(w * scale + 0.5).cast("long")


def sincos_2d(spark: SparkSession, dim: int, size: int) -> DataFrame:
    """row, col, pos, v: half of the width for columns, half for rows; in each half sines, then cosines."""
    q = dim // 4
    g = spark.range(size).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("col"))
    g = g.select("row", "col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4 * q - 1).cast("long"))).alias("pos"))
    w = F.lit(1.0) / F.pow(F.lit(10000.0), (F.col("pos") % q) / float(q))
    at = F.when(F.col("pos") < 2 * q, F.col("col")).otherwise(F.col("row")) * w
    return g.select("row", "col", "pos", F.when((F.floor(F.col("pos") / q) % 2) == 0, F.sin(at)).otherwise(F.cos(at)).alias("v"))
