"""Extension points for models: dense feature extractors and mask generators.

Networks are not part of the engine.  A plug-in implements a protocol, registers
under a name and runs batch by batch in mapInPandas; everything after it works on
the tables it writes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class DenseExtractor(Protocol):
    """Images (float array: batch, height, width, channel) to patch vectors (batch, patches, dims)."""

    cache_id: str
    patch_stride: int

    def __call__(self, images: np.ndarray) -> np.ndarray: ...


class MaskGenerator(Protocol):
    """An image to boolean masks (count, height, width)."""

    def __call__(self, image: np.ndarray) -> np.ndarray: ...


_EXTRACTORS: dict[str, Callable[..., DenseExtractor]] = {}
#: Names that plug-ins are expected under; none comes with the engine.
KNOWN = ("dinov2", "dino", "resnet50", "clip", "dinov3", "timm", "cosplace")


def register(name: str) -> Callable:
    def put(factory: Callable[..., DenseExtractor]):
        _EXTRACTORS[name] = factory
        return factory

    return put


def build(name: str, **options) -> DenseExtractor:
    if name not in _EXTRACTORS:
        raise ValueError(f"no extractor {name!r}" + (": its network has to be plugged in" if name in KNOWN else ""))
    return _EXTRACTORS[name](**options)


@register("patch_stats")
class PatchStats:
    """Mean, deviation, least and greatest value of each channel of each patch; needs no network."""

    def __init__(self, patch_stride: int = 14):
        self.patch_stride, self.cache_id = patch_stride, f"patch_stats_{patch_stride}"

    def __call__(self, images: np.ndarray) -> np.ndarray:
        b, h, w, c = images.shape
        s = self.patch_stride
        if h < s or w < s:
            raise ValueError("image smaller than a patch")
        x = images[:, : h // s * s, : w // s * s].reshape(b, h // s, s, w // s, s, c).transpose(0, 1, 3, 2, 4, 5).reshape(b, -1, s * s, c)
        return np.concatenate([x.mean(2), x.std(2), x.min(2), x.max(2)], axis=-1)


def extract(images: DataFrame, name: str, **options) -> DataFrame:
    """images: image_idx, height, width, channels, pixels (bytes, row by row).  image_idx, p, row, col, desc."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build(name, **options)
        for b in batches:
            for r in b.itertuples():
                image = np.frombuffer(r.pixels, np.uint8).reshape(1, r.height, r.width, r.channels) / 255.0
                d = model(image)[0]
                cols = r.width // model.patch_stride
                p = np.arange(len(d))
                yield pd.DataFrame({"image_idx": r.image_idx, "p": p, "row": p // cols, "col": p % cols, "desc": list(d)})

    return images.mapInPandas(run, "image_idx long, p long, row long, col long, desc array<double>")


def resize_position_table(table: np.ndarray, grid: tuple[int, int], new: tuple[int, int], prefix: int = 1) -> np.ndarray:
    """Position vectors of a grid (after `prefix` ones that stay) for another grid, by cubic convolution.

    table: (prefix + rows * columns, dims).  Cell centres lie half a cell inside, edges are held.
    """
    def weights(n_out: int, n_in: int, a: float = -0.75) -> np.ndarray:
        at = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
        out = np.zeros((n_out, n_in))
        for step in range(-1, 3):
            cell = np.floor(at).astype(int) + step
            d = np.abs(at - cell)
            w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, a * (d**3 - 5 * d**2 + 8 * d - 4))
            np.add.at(out, (np.arange(n_out), np.clip(cell, 0, n_in - 1)), w)
        return out

    if grid == new:
        return table
    cells = table[prefix:].reshape(*grid, -1)
    out = np.einsum("yr,xc,rcd->yxd", weights(new[0], grid[0]), weights(new[1], grid[1]), cells)
    return np.concatenate([table[:prefix], out.reshape(new[0] * new[1], -1)])


# The weight that holds the first mask back, by the number of points.
MASK_POINTS, MASK_WEIGHT = 2.5, 1000.0


def best_mask(scores: DataFrame, n_points: int) -> DataFrame:
    """scores: image_idx, mask, iou.  The mask of the best score; with one or two points the first mask is held back, with more it is preferred."""
    from pyspark.sql import functions as F

    weight = F.when(F.col("mask") == 0, F.lit((n_points - MASK_POINTS) * MASK_WEIGHT)).otherwise(F.lit(0.0))
    return scores.groupBy("image_idx").agg(F.max_by("mask", F.struct(F.col("iou") + weight, -F.col("mask"))).alias("mask"))
