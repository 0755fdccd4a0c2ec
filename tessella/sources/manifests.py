"""Manifests of tiles and queries, saved runs, ground truth and poses, as DataFrames with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.stages import stored

#: Wrappers of a manifest's list, the first one present wins.
WRAPPERS = ("items", "tiles", "queries", "data")
KNOWN_KEYS = ("tile_id", "query_id", "image", "center", "extent", "gt_tile_id", "offset", "coord", "positives")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def manifest_entries(documents: DataFrame) -> DataFrame:
    """documents: json (one manifest each).  pos and entry (VARIANT) of each item of a bare or wrapped list; anything else is an error."""
    v = F.parse_json("json")
    wrapped = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in WRAPPERS])
    found = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), wrapped)
    checked = F.when(found.isNull(), F.raise_error(F.lit("a manifest is a list or wraps one")).cast("array<variant>")).otherwise(found)
    return documents.select(F.posexplode(checked).alias("pos", "entry")).select(F.col("pos").cast("long").alias("pos"), "entry")


def get(entry: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(entry, f"$.{key}", kind)


def coerce_xy(v: Column) -> tuple[Column, Column]:
    """{x, y}, {dx, dy} or a list of two at least; null passes; anything else is an error."""
    x = F.coalesce(*[F.try_variant_get(v, p, "double") for p in ("$.x", "$.dx", "$[0]")])
    y = F.coalesce(*[F.try_variant_get(v, p, "double") for p in ("$.y", "$.dy", "$[1]")])
    nothing = v.isNull() | F.is_variant_null(v)
    bad = ~nothing & (x.isNull() | y.isNull())
    guard = lambda c: F.when(bad, F.raise_error(F.lit("not a point")).cast("double")).otherwise(c)
    return guard(x), guard(y)


def tiles_of(entries: DataFrame) -> DataFrame:
    """tile_idx, tile_id, image, center and extent."""
    e = F.col("entry")
    cx, cy = coerce_xy(F.try_variant_get(e, "$.center", "variant"))
    ew, eh = coerce_xy(F.try_variant_get(e, "$.extent", "variant"))
    image = F.when(get(e, "image").isNull(), F.raise_error(F.lit("a tile needs an image")).cast("string")).otherwise(get(e, "image"))
    return entries.select(F.col("pos").alias("tile_idx"), F.coalesce(get(e, "tile_id"), F.format_string("tile_%06d", "pos")).alias("tile_id"), image.alias("image"), cx.alias("cx"), cy.alias("cy"), ew.alias("ew"), eh.alias("eh"), F.to_json(e).alias("metadata"))


def queries_of(entries: DataFrame) -> DataFrame:
    """query_idx, query_id, image, gt_tile_id (else the first positive), offset, coord, positives."""
    e = F.col("entry")
    dx, dy = coerce_xy(F.try_variant_get(e, "$.offset", "variant"))
    x, y = coerce_xy(F.try_variant_get(e, "$.coord", "variant"))
    positives = F.try_variant_get(e, "$.positives", "array<string>")
    return entries.select(F.col("pos").alias("query_idx"), F.coalesce(get(e, "query_id"), F.format_string("query_%06d", "pos")).alias("query_id"), get(e, "image").alias("image"), F.coalesce(get(e, "gt_tile_id"), F.try_element_at(positives, F.lit(1))).alias("gt_tile_id"), dx.alias("dx"), dy.alias("dy"), x.alias("x"), y.alias("y"), positives.alias("positives"))


def load_tiles_queries(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame]:
    """The split's own manifests if they are there, else the general ones."""
    out = []
    for name, of in (("tiles", tiles_of), ("queries", queries_of)):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}_{split}.json")
        own = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        out.append(of(manifest_entries(read_text(spark, f"{root}/{name}_{split}.json" if own else f"{root}/{name}.json"))))
    return out[0], out[1]


# Where a saved run names its data set's root.
ROOT_FIELDS = ("$['Run-Config'].cvgl_dataset_root", "$['Run-Config'].dataset_root", "$['CVGL-Dataset']")


def dataset_root(results: DataFrame, given: str | None = None) -> DataFrame:
    """results: json (a saved run).  root: the one given, else the one of its configuration, else an error."""
    v = F.parse_json("json")
    told = F.coalesce(F.lit(given), *[F.try_variant_get(v, f, "string") for f in ROOT_FIELDS])
    return results.select(F.coalesce(told, F.raise_error(F.lit("the run names no data set root")).cast("string")).alias("root"))


def rankings_of(results: DataFrame) -> DataFrame:
    """results: json (a saved run).  query_row, rank, pos, from the most final ranking that is there."""
    v = F.parse_json("json")
    fields = [F.try_variant_get(v, f"$['{k}']", "array<array<long>>") for k in ("Final-DB-Indices-Orig", "Final-Indices", "Coarse-Indices")]
    rows = results.select(F.posexplode(F.coalesce(*fields)).alias("query_row", "ids"))
    each = rows.select("query_row", F.posexplode("ids").alias("r", "pos"))
    return each.select(F.col("query_row").cast("long").alias("query_row"), (F.col("r") + 1).cast("long").alias("rank"), "pos")


def camera_pose(files: DataFrame) -> DataFrame:
    """files: name, text.  Lines 4 to 6 are a rotation, the last but one the centre: x, y, z and zyx Euler degrees."""
    lines = F.split(F.rtrim(F.col("text")), "\n")
    number = lambda line, i: F.split(F.trim(line), r"\s+")[i].cast("double")
    r = [[number(lines[k], i) for i in range(3)] for k in (3, 4, 5)]
    at = F.element_at(lines, -2)
    deg = F.degrees
    yaw, pitch, roll = deg(F.atan2(r[1][0], r[0][0])), deg(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -r[2][0])))), deg(F.atan2(r[2][1], r[2][2]))
    return files.select("name", *[number(at, i).alias(c) for i, c in enumerate("xyz")], yaw.alias("yaw"), pitch.alias("pitch"), roll.alias("roll"))


def pose_lines(lines: DataFrame) -> DataFrame:
    """lines: value, of fields split by white space; fields 1 to 3 are x, y, z."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.select(*[f[i].cast("double").alias(c) for i, c in zip((1, 2, 3), "xyz")])


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of a pose file: text lines, or the first array of an .npz; a missing file gives no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "x double, y double, z double")
    if not path.endswith(".npz"):
        return pose_lines(spark.read.text(path))

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for b in batches:
            for raw in b.content:
                a = np.load(io.BytesIO(raw), allow_pickle=False)["arr_0"].reshape(-1, 3).astype(float)
                yield pd.DataFrame(a, columns=["x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "x double, y double, z double")


def unpivot_truth(wide: DataFrame, n: int = 5) -> DataFrame:
    """query_ind, top_1_ref_ind ... to query_ind, rank, ref."""
    return wide.select("query_ind", F.posexplode(F.array(*[F.col(f"top_{i}_ref_ind") for i in range(1, n + 1)])).alias("rank", "ref")).select("query_ind", (F.col("rank") + 1).cast("long").alias("rank"), "ref")


def truth_lists(spark: SparkSession, path: str) -> DataFrame:
    """query, positive of a saved list: JSON lines of {query, positives}, or a table with such columns."""
    rows = spark.read.json(path, schema="query long, positives array<long>") if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return rows.select("query", F.explode("positives").alias("positive"))


def file_number(path: Column) -> Column:
    """The number that a file is named by."""
    return F.split(F.element_at(F.split(path, "/"), -1), r"\.")[0].cast("long")


def remap_truth(truth: DataFrame, queries: DataFrame, db: DataFrame) -> DataFrame:
    """truth: query, positive by file number; queries, db: number, idx.  Truth among the files that are there, by index."""
    q, p = queries.toDF("query", "query_idx"), db.toDF("positive", "db_idx")
    return truth.join(q, "query").join(p, "positive").select("query_idx", "db_idx")


def truth_rows(truth: DataFrame, skip: int = 0) -> DataFrame:
    """truth: idx, positives; rows before `skip` are left out, indices start anew."""
    return truth.where(F.col("idx") >= skip).select((F.col("idx") - skip).alias("query_idx"), F.explode("positives").alias("db_idx"))


def pose_slice(poses: DataFrame, db: tuple[int, int], queries: tuple[int, int]) -> DataFrame:
    """poses: idx, x, y.  role and index within the role of two fixed ranges of rows (end exclusive)."""
    part = lambda role, a, b: poses.where((F.col("idx") >= a) & (F.col("idx") < b)).select(F.lit(role).alias("role"), (F.col("idx") - a).alias("i"), "x", "y")
    return part("db", *db).unionByName(part("query", *queries))


def labeled_names(files: DataFrame) -> DataFrame:
    """files: path (root/split/view/class/.../name).  split, view, class_id and the new name; spaces become underscores."""
    f = F.split("path", "/")
    class_id = F.when(F.size(f) > 4, f[3]).otherwise(F.lit("unknown"))
    stem = F.regexp_replace(F.element_at(f, -1), r"\.[^.]*$", "")
    name = F.replace(F.concat_ws("_", f[1], f[2], class_id, stem), F.lit(" "), F.lit("_"))
    return files.select("path", f[1].alias("split"), f[2].alias("view"), class_id.alias("class_id"), name.alias("name"))


def keyed_descriptors(files: DataFrame, key: str) -> DataFrame:
    """files: id, arrays (map of name to array of vectors, or of rows of vectors).  id, n, desc of the array of that name, flattened; without it an error."""
    got = F.try_element_at("arrays", F.lit(key))
    checked = F.when(got.isNull(), F.raise_error(F.concat(F.lit(f"no {key} in "), F.col("id").cast("string"))).cast(files.schema["arrays"].dataType.valueType)).otherwise(got)
    deep = files.schema["arrays"].dataType.valueType.simpleString().startswith("array<array<array<")
    return files.select("id", F.posexplode(F.flatten(checked) if deep else checked).alias("n", "desc"))


def load_descriptors(rows: DataFrame) -> DataFrame:
    """rows: id, desc.  The same, or an error: empty, not finite, or of mixed lengths."""
    from tessella.functions import vector as V

    dims = rows.agg(F.count_distinct(F.size("desc")).alias("d")).first()["d"]
    if dims != 1:
        raise ValueError(f"descriptors of {dims} lengths")
    bad = (F.size("desc") == 0) | ~V.is_finite(F.col("desc"))
    return rows.withColumn("desc", F.when(bad, F.raise_error(F.lit("a descriptor is empty or not finite")).cast("array<double>")).otherwise(F.col("desc")))


def with_index(rows: DataFrame, order: str, name: str) -> DataFrame:
    """A gapless index from 0 by `order`: ranges are dealt out, ranked alone and then shifted by the sizes before them."""
    dealt = stored(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "indexed")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_in", inner).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_in", "_before")
