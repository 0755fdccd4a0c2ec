"""Tables and the views derived from them, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import vector as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, e (array<double>), label."""
    return table(spark, d, "embeddings").select("vec_id", V.as_double("embedding").alias("e"), "label")


def split_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every tenth) and database."""
    v = vectors(spark, d)
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"), F.col("label").alias("q_label"))
    return q, v.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("db_id"), "e", "label")


def patches(spark: SparkSession, d: str) -> DataFrame:
    """5x5 grids: image_idx, p, row, col, desc."""
    v = vectors(spark, d)
    return v.select(F.expr("vec_id div 25").alias("image_idx"), (F.col("vec_id") % 25).alias("p"), F.expr("(vec_id % 25) div 5").alias("row"), F.expr("vec_id % 5").alias("col"), F.col("e").alias("desc"))


def centers(spark: SparkSession, d: str) -> DataFrame:
    """k, c: of each label the first vector, lengthened so that it has no unit norm."""
    first = vectors(spark, d).groupBy("label").agg(F.min_by("e", "vec_id").alias("e"))
    return first.select(F.col("label").cast("long").alias("k"), F.transform("e", lambda x: x * (1.1 + F.col("label") / 10.0)).alias("c"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """image_idx, seg, p: five cross-shaped masks on each grid."""
    p = patches(spark, d)
    seg = p.select("image_idx", "p", "row", "col", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seg"))
    return seg.where("row = seg or col = seg").select("image_idx", F.col("seg").cast("long").alias("seg"), "p", "row", "col")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """grp, box_id, x0, y0, x1, y1, score."""
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 50).alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"),
        (F.col("l_partkey") % 100).cast("double").alias("x0"), (F.col("l_suppkey") % 100).cast("double").alias("y0"),
        (F.col("l_partkey") % 100 + 5 + F.col("l_linenumber")).cast("double").alias("x1"), (F.col("l_suppkey") % 100 + 5 + F.col("l_quantity")).cast("double").alias("y1"),
        F.col("l_extendedprice").alias("score"),
    )


def tile_geo(spark: SparkSession, d: str) -> DataFrame:
    i = patches(spark, d).select("image_idx").distinct()
    return i.select("image_idx", ((F.col("image_idx") % 8 + 0.5) * 512).cast("double").alias("cx"), ((F.expr("image_idx div 8") + 0.5) * 512).cast("double").alias("cy"), F.lit(512.0).alias("ew"), F.lit(512.0).alias("eh"))


def query_geo(spark: SparkSession, d: str) -> DataFrame:
    """query_idx, gt_tile, dx, dy, x, y."""
    t = tile_geo(spark, d)
    q = t.where("image_idx % 4 = 0").select(F.col("image_idx").alias("query_idx"), (F.col("image_idx") + 1).alias("gt_tile"), ((F.col("image_idx") * 37) % 512 - 256).cast("double").alias("dx"), ((F.col("image_idx") * 53) % 512 - 256).cast("double").alias("dy"))
    return q.join(t.select(F.col("image_idx").alias("gt_tile"), "cx", "cy"), "gt_tile").select("query_idx", "gt_tile", "dx", "dy", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"))


#: The same views as SQL for DuckDB, to stand before a query.
SQL = {
    "vectors": "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)",
    "vec_query": "vec_query AS (SELECT vec_id AS query_id, e AS q, label AS q_label FROM vectors WHERE vec_id % 10 = 0)",
    "vec_db": "vec_db AS (SELECT vec_id AS db_id, e, label FROM vectors WHERE vec_id % 10 <> 0)",
    "patches": "patches AS (SELECT vec_id // 25 AS image_idx, vec_id % 25 AS p, (vec_id % 25) // 5 AS row, vec_id % 5 AS col, e AS \"desc\" FROM vectors)",
    "centers": "centers AS (SELECT CAST(label AS BIGINT) AS k, list_transform(arg_min(e, vec_id), lambda x: x * (1.1 + label / 10.0)) AS c FROM vectors GROUP BY label)",
    "segments": "segments AS (SELECT image_idx, CAST(s.seg AS BIGINT) AS seg, p, row, col FROM patches, (SELECT unnest(range(0, 5)) AS seg) s WHERE row = s.seg OR col = s.seg)",
    "boxes": "boxes AS (SELECT l_orderkey % 50 AS grp, l_orderkey * 10 + l_linenumber AS box_id, CAST(l_partkey % 100 AS DOUBLE) AS x0, CAST(l_suppkey % 100 AS DOUBLE) AS y0, CAST(l_partkey % 100 + 5 + l_linenumber AS DOUBLE) AS x1, CAST(l_suppkey % 100 + 5 + l_quantity AS DOUBLE) AS y1, l_extendedprice AS score FROM lineitem)",
    "tile_geo": "tile_geo AS (SELECT DISTINCT image_idx, (image_idx % 8 + 0.5) * 512.0 AS cx, (image_idx // 8 + 0.5) * 512.0 AS cy, 512.0 AS ew, 512.0 AS eh FROM patches)",
    "query_geo": "query_geo AS (SELECT q.image_idx AS query_idx, q.image_idx + 1 AS gt_tile, CAST((q.image_idx * 37) % 512 - 256 AS DOUBLE) AS dx, CAST((q.image_idx * 53) % 512 - 256 AS DOUBLE) AS dy, t.cx + ((q.image_idx * 37) % 512 - 256) AS x, t.cy + ((q.image_idx * 53) % 512 - 256) AS y FROM tile_geo q JOIN tile_geo t ON t.image_idx = q.image_idx + 1 WHERE q.image_idx % 4 = 0)",
    "unit": "unit AS (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS e, label FROM vectors)",
    "unit_patches": "unit_patches AS (SELECT vec_id // 25 AS image_idx, vec_id % 25 AS p, (vec_id % 25) // 5 AS row, vec_id % 5 AS col, e AS \"desc\" FROM unit)",
    "ranking": "ranking AS (SELECT query_id, rank, db_id, sim, label, q_label FROM (SELECT q.vec_id AS query_id, d.vec_id AS db_id, round(list_dot_product(q.e, d.e), 9) AS sim, d.label, q.label AS q_label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, d.e), 9) DESC, d.vec_id) AS rank FROM unit q JOIN unit d ON q.vec_id % 10 = 0 AND d.vec_id % 10 <> 0) WHERE rank <= 20)",
}
NEEDS = {"vec_query": ["vectors"], "vec_db": ["vectors"], "patches": ["vectors"], "centers": ["vectors"], "segments": ["patches"], "tile_geo": ["patches"], "query_geo": ["tile_geo"], "unit": ["vectors"], "unit_patches": ["unit"], "ranking": ["vec_query", "vec_db", "unit"]}


def with_views(*names: str) -> str:
    """WITH ... of the views named and of all that they need."""
    out: list[str] = []

    def need(n: str) -> None:
        for m in NEEDS.get(n, []):
            need(m)
        if n not in out:
            out.append(n)

    for n in names:
        need(n)
    return "WITH " + ",\n".join(SQL[n] for n in out)
