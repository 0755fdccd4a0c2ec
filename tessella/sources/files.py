"""Folders of images, masks and features: listing, decoding, and the order of mask sources."""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.sources.manifests import with_index

MASK_KEYS = ("masks", "segmentations", "data", "items")
# ImageNet mean and standard deviation.
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.jpg", recursive: bool = True) -> DataFrame:
    """path, length; metadata only, contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(folder).select("path", "length")


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (), recursive: bool = True, limit: int | None = None) -> DataFrame:
    """path, length of the files with one of the suffixes (any, without), in order of path; none at all is an error."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    files = scan_files(spark, folder, "*", recursive)
    if suffixes:
        files = files.where(F.lower("path").rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$"))
    if files.isEmpty():
        raise FileNotFoundError(f"no files in {folder}")
    out = files.orderBy("path")
    return out if limit is None else out.limit(limit)


def image_folder(files: DataFrame) -> DataFrame:
    """files: path.  role (db for database or ref folders, query for queries or query), idx in natural order within the role."""
    role = F.when(F.col("path").rlike("/(database|ref)/"), "db").when(F.col("path").rlike("/(queries|query)/"), "query")
    marked = files.withColumn("role", role).where("role is not null").withColumn("_key", F.concat_ws("\u0001", "role", P.natural_key(F.col("path"))))
    # ranges of (role, name) are ranked side by side; a role's first index is then taken off
    ranked = with_index(marked, "_key", "_at")
    first = ranked.groupBy("role").agg(F.min("_at").alias("_first"))
    return ranked.join(F.broadcast(first), "role").select("path", "role", (F.col("_at") - F.col("_first")).alias("idx"))  # two rows


def with_distractors(tiles: DataFrame, distractors: DataFrame) -> DataFrame:
    return tiles.unionByName(distractors.withColumn("role", F.lit("db")), allowMissingColumns=True)


def scan_masks(spark: SparkSession, folder: str) -> DataFrame:
    return parse_masks(spark.read.format("binaryFile").option("pathGlobFilter", "*.{npy,npz,json}").load(folder).select("path", "content"))


def parse_masks(files: DataFrame) -> DataFrame:
    """files: path, content.  image (file stem), seg, row, col of .npy, .npz and .json mask files.  Pickles are refused."""
    import numpy as np
    import pandas as pd

    def masks_of(path: str, raw: bytes):
        if path.endswith(".json"):
            got = json.loads(raw)
            if isinstance(got, dict):
                got = next(got[k] for k in MASK_KEYS if k in got)
            return [np.asarray(m.get("segmentation", m.get("mask")) if isinstance(m, dict) else m) for m in got]
        got = np.load(io.BytesIO(raw), allow_pickle=False)
        return list(got[next(k for k in (*MASK_KEYS, *got.files) if k in got.files)] if hasattr(got, "files") else got)

    def run(batches):
        for b in batches:
            out = []
            for path, raw in zip(b.path, b.content):
                for s, m in enumerate(masks_of(path, raw)):
                    if m.ndim != 2:
                        raise ValueError(f"{path}: a mask has two dimensions")
                    r, c = np.nonzero(m)
                    out.append(pd.DataFrame({"image": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "seg": s, "row": r, "col": c}))
            yield pd.concat(out) if out else pd.DataFrame({"image": [], "seg": [], "row": [], "col": []})

    return files.mapInPandas(run, "image string, seg long, row long, col long")


#: manifest: the manifest's masks or none; generate: the cache's, else a generator's; auto: all three in order.
MASK_POLICIES = ("manifest", "generate", "auto")


def choose_masks(images: DataFrame, manifest: DataFrame, cached: DataFrame, policy: str = "auto", generator: bool = False) -> DataFrame:
    """image, source: manifest, cache, generated or none.

    The manifest's masks come first; unless policy is `manifest`, then the cache's, then a
    generator's.  An image that only a generator could serve is an error without one under `generate`.
    """
    if policy not in MASK_POLICIES:
        raise ValueError(f"policy: {policy!r} is none of {', '.join(MASK_POLICIES)}")
    m = manifest.select("image").distinct().withColumn("_m", F.lit("manifest"))
    c = cached.select("image").distinct().withColumn("_c", F.lit("cache"))
    if generator:
        last = F.lit("generated")
    elif policy == "generate":
        last = F.raise_error(F.concat(F.lit("no mask generator for "), "image")).cast("string")
    else:
        last = F.lit("none")
    source = F.coalesce("_m", F.lit("none")) if policy == "manifest" else F.coalesce("_m", "_c", last)
    return images.select("image").join(m, "image", "left").join(c, "image", "left").select("image", source.alias("source"))


def decode_images(spark: SparkSession, folder: str) -> DataFrame:
    """Spark decodes, normalized_pixels scales."""
    return normalized_pixels(spark.read.format("image").load(folder).select("image.*"))


#: Image transforms: as it is; to a size; the shorter side to a length; a central crop after scaling; five crops.
TRANSFORMS = ("none", "hard_resize", "shorter_side", "central_crop", "five_crops")


def resized(image, height: int, width: int):
    """A float image (rows, columns, channels) by bilinear sampling; pixel centres lie half a pixel inside."""
    import numpy as np

    def taps(n_out: int, n_in: int):
        at = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n_in - 1), at - low

    y0, y1, fy = taps(height, image.shape[0])
    x0, x1, fx = taps(width, image.shape[1])
    rows = image[y0] * (1 - fy)[:, None, None] + image[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def transformed(image, transform: str = "none", size: tuple[int, int] = (320, 320)) -> list:
    """The images that a transform makes of one; five_crops are the corners, row by row, and the middle."""
    if transform not in TRANSFORMS:
        raise ValueError(f"transform: {transform!r} is none of {', '.join(TRANSFORMS)}")
    h, w = image.shape[:2]
    if transform == "none":
        return [image]
    if transform == "hard_resize":
        return [resized(image, *size)]
    short = min(size)
    scale = max(size[0] / h, size[1] / w) if transform == "central_crop" else short / min(h, w)
    ch, cw = size if transform == "central_crop" else (short, short)
    big = resized(image, max(ch, int(h * scale)), max(cw, int(w * scale))) if transform != "shorter_side" else resized(image, *((short, int(w * scale)) if h <= w else (int(h * scale), short)))
    if transform == "shorter_side":
        return [big]
    bh, bw = big.shape[:2]
    crop = lambda top, left: big[top : top + ch, left : left + cw]
    middle = crop(round((bh - ch) / 2), round((bw - cw) / 2))
    return [middle] if transform == "central_crop" else [crop(0, 0), crop(0, bw - cw), crop(bh - ch, 0), crop(bh - ch, bw - cw), middle]


def normalized_images(images: DataFrame, transform: str = "none", size: tuple[int, int] = (320, 320), mean=IMAGENET_MEAN, std=IMAGENET_STD) -> DataFrame:
    """images: origin, height, width, nChannels, data (BGR bytes).  path, crop, height, width, pixels (RGB, normalised, row by row)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                bgr = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, :3].astype(float) / 255
                made = transformed((bgr[:, :, ::-1] - mean) / std, transform, size)
                yield pd.DataFrame([(r.origin, i, *m.shape[:2], m.ravel()) for i, m in enumerate(made)], columns=["path", "crop", "height", "width", "pixels"])

    return images.mapInPandas(run, "path string, crop int, height int, width int, pixels array<double>")


def normalized_pixels(images: DataFrame, mean=IMAGENET_MEAN, std=IMAGENET_STD, transform: str = "none", size: tuple[int, int] = (320, 320)) -> DataFrame:
    """path, height, width and the normalised mean of each channel (RGB); of five crops, the middle one."""
    each = normalized_images(images, transform, size, mean, std)
    each = each.where("crop = 4") if transform == "five_crops" else each
    channel = lambda c: F.aggregate(F.filter("pixels", lambda x, i: i % 3 == c), F.lit(0.0), lambda a, x: a + x) / (F.col("height") * F.col("width"))
    return each.select("path", "height", "width", *[channel(i).alias(n) for i, n in enumerate("rgb")])


def indexed_images(listing: DataFrame, images: DataFrame) -> DataFrame:
    """listing: path, idx; images: path and what was decoded.  The images of a listing under their index; a missing one is an error."""
    both = listing.select("path", "idx").join(images.withColumn("_there", F.lit(True)), "path", "left")
    path = F.when(F.col("_there"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no image "), "path")).cast("string"))
    return both.withColumn("path", path).drop("_there")
