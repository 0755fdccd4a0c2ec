"""Run-length masks, boxes, suppression, components and triangulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rle_encode(bits: DataFrame, by: str, order: str, bit: str) -> DataFrame:
    """Runs of equal bits in order, from 0; the first run is of zeros and has length 0 if the first bit is set.

    by, run, n.
    """
    w = Window.partitionBy(by).orderBy(order)
    marked = bits.withColumn("_new", (F.col(bit) != F.lag(bit, 1, 0).over(w)).cast("int")).withColumn("run", F.sum("_new").over(w).cast("long"))
    runs = marked.groupBy(by, "run").agg(F.count(F.lit(1)).alias("n"))
    first = bits.select(by).distinct().join(runs.where("run = 0"), by, "left_anti").select(by, F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("n"))
    return runs.unionByName(first)


def rle_decode(runs: DataFrame, by: str) -> DataFrame:
    """by, pos of every set bit."""
    w = Window.partitionBy(by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_at", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return placed.where("run % 2 = 1 and n > 0").select(by, F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("n") - 1)).alias("pos"))


def rle_area(runs: DataFrame, by: str) -> DataFrame:
    return runs.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("run") % 2 == 1, F.col("n"))), F.lit(0)).alias("area"))


def mask_boxes(masks: DataFrame, images: DataFrame, by: list[str]) -> DataFrame:
    """x, y, width and height of the set cells (row, col); without any, zeros."""
    b = masks.groupBy(*by).agg(F.min("col").alias("x0"), F.min("row").alias("y0"), F.max("col").alias("x1"), F.max("row").alias("y1"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return images.join(b, by, "left").select(*by, zero(F.col("x0")).alias("x"), zero(F.col("y0")).alias("y"), zero(F.col("x1") - F.col("x0")).alias("w"), zero(F.col("y1") - F.col("y0")).alias("h"))


def iou(a: list[Column], b: list[Column]) -> Column:
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h)


def nms(boxes: DataFrame, threshold: float = 0.7, by: str = "grp") -> DataFrame:
    """Greedy suppression by score within each group; equal scores keep the smaller box_id, then the smaller corners.  by, box_id.

    Sequential by nature: a group (the boxes of one image, a bounded number) is one task.
    """
    import numpy as np
    import pandas as pd

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id", "x0", "y0", "x1", "y1"], ascending=[False, *[True] * 5])
        x0, y0, x1, y1 = (pdf[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
        area, left, kept = (x1 - x0) * (y1 - y0), np.ones(len(pdf), bool), []
        for i in range(len(pdf)):
            if not left[i]:
                continue
            kept.append(i)
            inter = np.maximum(np.minimum(x1[i], x1) - np.maximum(x0[i], x0), 0) * np.maximum(np.minimum(y1[i], y1) - np.maximum(y0[i], y0), 0)
            left &= ~(inter > threshold * (area[i] + area - inter))
        return pdf.iloc[kept][[by, "box_id"]]

    return boxes.groupBy(by).applyInPandas(keep, f"{by} long, box_id long")


def nms_across_crops(boxes: DataFrame, threshold: float = 0.7, by: str = "grp") -> DataFrame:
    """boxes: crop_x0 .. crop_y1 beside the usual columns.  Boxes of smaller crops come first; equal crops by box_id."""
    area = (F.col("crop_x1") - F.col("crop_x0")) * (F.col("crop_y1") - F.col("crop_y0"))
    return nms(boxes.withColumn("score", 1.0 / area), threshold, by)


def nms_after_cleanup(boxes: DataFrame, threshold: float = 0.7, by: str = "grp") -> DataFrame:
    """boxes: changed (whether cleaning changed the mask).  Unchanged masks come first; equal ones by box_id."""
    return nms(boxes.withColumn("score", F.when(F.col("changed"), 0.0).otherwise(1.0)), threshold, by)


def clean_masks(cells: DataFrame, h: int, w: int, area: int, threshold: float = 0.7) -> DataFrame:
    """cells: image_idx, mask_id, row, col.  Holes filled, islands dropped, then boxes suppressed within each image.

    image_idx, mask_id, row, col of the masks that stay.
    """
    images = cells.select("image_idx", "mask_id").distinct()
    plain = cells.select("mask_id", "row", "col")
    cleaned = small_regions(small_regions(plain, h, w, area, "holes"), h, w, area, "islands")
    count = lambda df, name: df.groupBy("mask_id").agg(F.count(F.lit(1)).alias(name), F.sum(F.col("row") * w + F.col("col")).alias(f"{name}_sum"))
    changed = count(plain.distinct(), "a").join(count(cleaned, "b"), "mask_id").select("mask_id", ((F.col("a") != F.col("b")) | (F.col("a_sum") != F.col("b_sum"))).alias("changed"))
    boxes = mask_boxes(cleaned, images.select("mask_id"), ["mask_id"]).join(changed, "mask_id").join(images, "mask_id")
    corners = boxes.select(F.col("image_idx").alias("grp"), F.col("mask_id").alias("box_id"), "changed", *[F.col(c).cast("double").alias(c + "0") for c in "xy"], (F.col("x") + F.col("w")).cast("double").alias("x1"), (F.col("y") + F.col("h")).cast("double").alias("y1"))
    kept = nms_after_cleanup(corners, threshold).select(F.col("grp").alias("image_idx"), F.col("box_id").alias("mask_id"))
    return kept.join(cleaned, "mask_id").select("image_idx", "mask_id", "row", "col")


def small_regions(cells: DataFrame, h: int, w: int, area: int, mode: str) -> DataFrame:
    """cells: mask_id, row, col.  8-connected regions below `area`: holes are filled, or islands dropped (the largest stays if all are small)."""
    import numpy as np
    import pandas as pd

    def regions(grid: np.ndarray) -> np.ndarray:
        label, n = np.zeros(grid.shape, int), 0
        for r, c in zip(*np.nonzero(grid)):
            if not label[r, c]:
                n += 1
                label[r, c], todo = n, [(r, c)]
                while todo:
                    y, x = todo.pop()
                    for v in range(max(0, y - 1), min(h, y + 2)):
                        for u in range(max(0, x - 1), min(w, x + 2)):
                            if grid[v, u] and not label[v, u]:
                                label[v, u] = n
                                todo.append((v, u))
        return label

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((h, w), bool)
        grid[pdf.row, pdf.col] = True
        label = regions(~grid if mode == "holes" else grid)
        sizes = np.bincount(label.ravel(), minlength=2)
        sizes[0] = 0
        small = [i for i in range(1, len(sizes)) if sizes[i] < area]
        if mode == "holes":
            grid |= np.isin(label, small)
        else:
            keep = [i for i in range(1, len(sizes)) if sizes[i] >= area] or [int(np.argmax(sizes))]
            grid = np.isin(label, keep) if small else grid
        r, c = np.nonzero(grid)
        return pd.DataFrame({"mask_id": pdf.mask_id.iloc[0], "row": r, "col": c})

    return cells.groupBy("mask_id").applyInPandas(clean, "mask_id long, row long, col long")


def stability(logits: DataFrame, by: str, threshold: float, offset: float) -> DataFrame:
    """Share of the cells above threshold + offset among those above threshold - offset."""
    return logits.groupBy(by).agg((F.count_if(F.col("v") > threshold + offset) / F.count_if(F.col("v") > threshold - offset)).alias("stability"))


def triangulate(points: list[tuple[float, float]]) -> set[tuple[int, int]]:
    """Edges of the Delaunay triangulation: points go in one by one, and the triangles whose circle holds the new one are rebuilt."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    mid, far = ((min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2), 50 * max(max(xs) - min(xs), max(ys) - min(ys), 1e-9)
    n = len(points)
    at = [*points, (mid[0] - far, mid[1] - far), (mid[0] + far, mid[1] - far), (mid[0], mid[1] + far)]

    def holds(t, p):
        (ax, ay), (bx, by), (cx, cy) = ((at[i][0] - p[0], at[i][1] - p[1]) for i in t)
        det = (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)
        (px, py), (qx, qy), (rx, ry) = (at[i] for i in t)
        turn = (qx - px) * (ry - py) - (qy - py) * (rx - px)
        return det * turn > 1e-12

    triangles = {(n, n + 1, n + 2)}
    for i, p in enumerate(points):
        hit = [t for t in triangles if holds(t, p)]
        sides: dict[tuple[int, int], int] = {}
        for t in hit:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                sides[tuple(sorted(e))] = sides.get(tuple(sorted(e)), 0) + 1
        triangles -= set(hit)
        triangles |= {(*e, i) for e, k in sides.items() if k == 1}
    return {tuple(sorted(e)) for t in triangles for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])) if max(e) < n}


def delaunay_adjacency(cents: DataFrame) -> DataFrame:
    """image_idx, i, j: triangulated centroids, symmetric and reflexive; with three segments or fewer, or in a line, all of kNN's edges instead."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = list(zip(pdf.cx, pdf.cy))
        edges = {(i, i) for i in range(len(pts))}
        apart = len(set(pts)) >= 3
        flat = apart and all(abs((pts[1][0] - pts[0][0]) * (p[1] - pts[0][1]) - (pts[1][1] - pts[0][1]) * (p[0] - pts[0][0])) < 1e-9 for p in pts)
        if len(pts) > 3 and apart and not flat:
            edges |= triangulate(pts)
        else:
            for i, p in enumerate(pts):
                edges |= {(i, j) for j in sorted(range(len(pts)), key=lambda j: ((pts[j][0] - p[0]) ** 2 + (pts[j][1] - p[1]) ** 2, j))[:4]}
        rows = sorted(edges | {(j, i) for i, j in edges})
        seg = pdf.seg.tolist()
        return pd.DataFrame({"image_idx": pdf.image_idx.iloc[0], "i": [seg[i] for i, _ in rows], "j": [seg[j] for _, j in rows]})

    return cents.groupBy("image_idx").applyInPandas(run, "image_idx long, i long, j long")
