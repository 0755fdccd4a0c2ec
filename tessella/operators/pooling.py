"""Patches to image and segment vectors.

Vectors are summed whole (one buffer for each group, partial before any shuffle);
the long form, a row for each position, is only made of the results.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import vector as V


def normalized(patches: DataFrame) -> DataFrame:
    return patches.withColumn("desc", V.l2_normalize(F.col("desc")))


def assign(patches: DataFrame, centers: DataFrame) -> DataFrame:
    """Each patch with its nearest centre by cosine (lowest k on ties) and that centre as given.

    Centres are a vocabulary of a fixed number of rows; they come as one broadcast
    array, and the choice is a projection without a join of patches.
    """
    vocabulary = centers.agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("_cs"))
    both = patches.join(F.broadcast(vocabulary), F.lit(True))
    sims = F.transform("_cs", lambda c: F.struct(F.round(V.cosine(F.col("desc"), c["c"]), 9).alias("sim"), (-c["k"]).alias("k"), c["c"].alias("c")))
    return both.withColumn("_best", F.array_max(sims)).select(*patches.columns, (-F.col("_best.k")).alias("k"), F.col("_best.sim").alias("sim"), F.col("_best.c").alias("c"))


def _total(x: Column, weight: Column | None = None) -> Column:
    """The sum of array vectors in a group."""
    return vector_to_array(Summarizer.sum(array_to_vector(x if weight is None else F.zip_with(x, F.array_repeat(weight, F.size(x)), lambda a, w: a * w))))


def _long(vectors: DataFrame, by: list[str], vec: str) -> DataFrame:
    """by, pos, x."""
    return vectors.select(*by, F.posexplode(vec).alias("pos", "x")).select(*by, F.col("pos").cast("long").alias("pos"), "x")


def _blocks_to_long(sums: DataFrame, by: list[str]) -> DataFrame:
    """sums: by, k, v.  Each block of unit length, then all blocks of a group together."""
    unit = sums.select(*by, "k", V.l2_normalize(F.col("v")).alias("v"))
    # after the blocks a group's length is the root of the number of blocks that are not zero, told by their own squares
    whole = unit.groupBy(*by).agg(F.collect_list(F.struct("k", "v")).alias("_b"), F.sqrt(F.sum(V.dot(F.col("v"), F.col("v")))).alias("_n"))
    each = whole.select(*by, F.greatest("_n", F.lit(V.EPS)).alias("_n"), F.explode("_b").alias("_b")).select(*by, F.col("_b.k").alias("k"), V.scaled(F.col("_b.v"), 1 / F.col("_n")).alias("v"))
    return _long(each, [*by, "k"], "v")


def vlad(assigned: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Residual sums for each group and centre, each of unit length, the whole of unit length.  by, k, pos, x (missing centres: no rows, zeros)."""
    x = V.residual(F.col("desc"), F.col("c"))
    return _blocks_to_long(assigned.groupBy(*by, "k").agg(_total(x, F.col(weight) if weight else None).alias("v")), by)


def soft_weights(patches: DataFrame, centers: DataFrame, temperature: float) -> DataFrame:
    """Every patch with every centre and the softmax of temperature * cosine over the centres."""
    both = patches.join(F.broadcast(centers), F.lit(True))  # a vocabulary of a fixed number of rows
    s = temperature * V.cosine(F.col("desc"), F.col("c"))
    w = Window.partitionBy("image_idx", "p")
    e = both.withColumn("_s", s).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return e.withColumn("w", F.col("_e") / F.sum("_e").over(w)).drop("_s", "_e")


def vlad_soft(patches: DataFrame, centers: DataFrame, temperature: float = 1.0, textbook: bool = False) -> DataFrame:
    """Soft residual sums.  As defined here the block of centre k sums w_k times the residuals to every centre; textbook: to centre k only."""
    weighted = soft_weights(patches, centers, temperature)
    if textbook:
        return vlad(weighted, ["image_idx"], weight="w")
    total = centers.agg(F.count(F.lit(1)).alias("_n"), _total(F.col("c")).alias("_sum"))
    x = F.zip_with(F.transform("desc", lambda v: v * F.col("_n")), F.col("_sum"), lambda a, b: a - b)
    rows = weighted.join(F.broadcast(total), F.lit(True)).select("image_idx", "k", "w", x.alias("x"))  # one row
    return _blocks_to_long(rows.groupBy("image_idx", "k").agg(_total(F.col("x"), F.col("w")).alias("v")), ["image_idx"])


def pooled(patches: DataFrame, how: str, by: list[str], p: float = 3.0, use_abs: bool = False) -> DataFrame:
    """gap, gmp or gem over patches, then unit length: by, v."""
    v = F.col("desc")
    if how == "gem":
        v = F.transform(v, lambda x: F.pow(F.abs(x) if use_abs else x, F.lit(p)))
    stat = {"gap": Summarizer.mean, "gem": Summarizer.mean, "gmp": Summarizer.max}.get(how)
    if stat is None:
        raise ValueError(f"unknown pooling {how}")
    out = patches.groupBy(*by).agg(vector_to_array(stat(array_to_vector(v))).alias("v"))
    if how == "gem":
        out = out.withColumn("v", F.transform("v", lambda m: F.signum(m) * F.pow(F.abs(m), F.lit(1 / p))))
    return out.withColumn("v", V.l2_normalize(F.col("v")))


def pool(patches: DataFrame, how: str, by: list[str], p: float = 3.0, use_abs: bool = False) -> DataFrame:
    """The same in long form: by, pos, x."""
    return _long(pooled(patches, how, by, p, use_abs), by, "v")


def dense(long: DataFrame, by: list[str], centers: DataFrame) -> DataFrame:
    """by, k, pos, x to by, v: blocks of all centres in order, zeros for those a group lacks."""
    shape = centers.agg(F.max(F.size("c")).alias("dims"), F.max("k").alias("k")).first()
    blocks = long.groupBy(*by, "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    held = blocks.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    block = lambda k: F.coalesce(F.try_element_at("m", k), F.array_repeat(F.lit(0.0), shape["dims"]))
    return held.select(*by, F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shape["k"]).cast("long")), block)).alias("v"))


def with_encodings(vectors: DataFrame, encodings: list[tuple[DataFrame, float]], by: list[str]) -> DataFrame:
    """vectors: by, v; encodings: tables (by, v) with their weights.  The vector and the weighted encodings side by side, of unit length."""
    out = vectors
    parts = [F.col("v")]
    for i, (e, weight) in enumerate(encodings):
        out = out.join(e.select(*by, F.col("v").alias(f"_e{i}")), by)
        parts.append(V.scaled(F.col(f"_e{i}"), F.lit(weight)))
    return out.select(*by, V.l2_normalize(F.concat(*parts)).alias("v"))


def expand_masks(masks: DataFrame, adjacency: DataFrame) -> DataFrame:
    """masks: image_idx, seg, p; adjacency: image_idx, i, j.  Patches of each segment and of its neighbours."""
    return adjacency.join(masks, (adjacency["image_idx"] == masks["image_idx"]) & (adjacency["j"] == masks["seg"])).select(adjacency["image_idx"], F.col("i").alias("seg"), "p").distinct()


def segment_vlad(patches: DataFrame, centers: DataFrame, expanded: DataFrame) -> DataFrame:
    """image_idx, seg, k, pos, x."""
    a = assign(patches, centers).select("image_idx", "p", "desc", "k", "c")
    return vlad(expanded.join(a, ["image_idx", "p"]), ["image_idx", "seg"])


def segment_average(patches: DataFrame, expanded: DataFrame) -> DataFrame:
    return pool(expanded.join(normalized(patches).select("image_idx", "p", "desc"), ["image_idx", "p"]), "gap", ["image_idx", "seg"])
