"""Vectors, exact search, ranking, votes and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import vector as V
from tessella.functions.vector import r6
from tessella.operators import evaluation as E
from tessella.operators import retrieval as R
from tessella.plans import fixtures as X
from tessella.plans.fixtures import with_views
from tessella.queries.registry import query
from tessella.stages import stored

_RANK = with_views("ranking")


def ranking(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    q, db = X.split_vectors(spark, d)
    return R.top_k_blocks(q, db, k)


def positives(spark: SparkSession, d: str, ranked: DataFrame) -> DataFrame:
    """The pairs of a ranking whose labels agree; queries do not meet all rows of their label."""
    q, db = X.split_vectors(spark, d)
    both = ranked.select("query_id", "db_id").join(q.select("query_id", "q_label"), "query_id").join(db.select("db_id", "label"), "db_id")
    return both.where("q_label = label").select("query_id", "db_id")


def of_label(spark: SparkSession, d: str) -> DataFrame:
    """query_id, n (database rows of its label) and gt (the first) of each query that has any."""
    q, db = X.split_vectors(spark, d)
    first = db.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("db_id").alias("gt"))
    return q.select("query_id", F.col("q_label").alias("label")).join(first, "label").select("query_id", "n", "gt")


def lowest_positive(spark: SparkSession, d: str) -> DataFrame:
    return of_label(spark, d).select("query_id", "gt")


_POS = ", pos AS (SELECT query_id, db_id FROM vec_query JOIN vec_db ON q_label = label), gt AS (SELECT query_id, min(db_id) AS gt FROM pos GROUP BY 1)"


@query(f"{with_views('vectors')} SELECT vec_id, i - 1 AS pos, round(e[i] / greatest(sqrt(list_dot_product(e, e)), 1e-12), 6) + 0.0 AS x FROM vectors, (SELECT unnest(range(1, 65)) AS i)")
def v01_l2_normalize(spark, d):
    v = X.vectors(spark, d).select("vec_id", F.posexplode(V.l2_normalize(F.col("e"))).alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("x"))


@query(f"{with_views('vectors')} SELECT a.vec_id, round(list_dot_product(a.e, b.e), 6) + 0.0 AS dot, round(list_cosine_similarity(a.e, b.e), 6) + 0.0 AS cosine FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def v02_dot(spark, d):
    a = X.vectors(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return a.join(b, "vec_id").select("vec_id", r6(V.dot(F.col("e"), F.col("f"))).alias("dot"), r6(V.cosine(F.col("e"), F.col("f"))).alias("cosine"))


@query(f"{with_views('vectors')} SELECT a.vec_id, round(list_distance(a.e, b.e), 6) + 0.0 AS dist FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def v03_l2_distance(spark, d):
    a = X.vectors(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return a.join(b, "vec_id").select("vec_id", r6(V.l2_distance(F.col("e"), F.col("f"))).alias("dist"))


@query(f"{with_views('patches', 'centers')} SELECT image_idx, p, k, i - 1 AS pos, round(\"desc\"[i] - c[i], 6) + 0.0 AS x FROM patches, centers, (SELECT unnest(range(1, 65)) AS i)")
def v04_residual(spark, d):
    both = X.patches(spark, d).join(F.broadcast(X.centers(spark, d)), F.lit(True))  # the vocabulary: one row for each label
    r = both.select("image_idx", "p", "k", F.posexplode(V.residual(F.col("desc"), F.col("c"))).alias("pos", "x"))
    return r.select("image_idx", "p", "k", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("x"))


@query(f"""{with_views('patches', 'centers')},
u AS (SELECT image_idx, p, k, i, ("desc"[i] - c[i]) / greatest(list_distance("desc", c), 1e-12) AS x FROM patches, centers, (SELECT unnest(range(1, 65)) AS i))
SELECT image_idx, p, k, i - 1 AS pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY image_idx, p)), 1e-12), 6) + 0.0 AS x FROM u""")
def v05_residual_concat(spark, d):
    cs = X.centers(spark, d).agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("cs"))  # the vocabulary as one row
    p = X.patches(spark, d).join(F.broadcast(cs), F.lit(True))
    joined = V.l2_normalize(F.flatten(F.transform("cs", lambda c: V.l2_normalize(V.residual(F.col("desc"), c["c"])))))
    each = p.select("image_idx", "p", F.transform("cs", lambda c: c["k"]).alias("ks"), F.posexplode(joined).alias("i", "x"))
    return each.select("image_idx", "p", F.element_at("ks", F.expr("i div 64").cast("int") + 1).alias("k"), (F.col("i") % 64).cast("long").alias("pos"), r6(F.col("x")).alias("x"))


@query(f"{_RANK} SELECT query_id, db_id, round(0.7 * sim + 0.3 * (1.0 / rank), 6) AS fused FROM ranking")
def v06_score_fusion(spark, d):
    return ranking(spark, d).select("query_id", "db_id", F.round(0.7 * F.col("sim") + 0.3 * (1.0 / F.col("rank")), 6).alias("fused"))


@query(f"{with_views('vectors')} SELECT vec_id, i - 1 AS pos, round(y / greatest(sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 1e-12), 6) + 0.0 AS x FROM (SELECT vec_id, i, CASE WHEN i <= 64 THEN e[i] ELSE 0.5 * e[i - 64] END AS y FROM vectors, (SELECT unnest(range(1, 73)) AS i))")
def v09_weighted_concat(spark, d):
    v = X.vectors(spark, d).select("vec_id", F.posexplode(V.weighted_concat(F.col("e"), F.slice("e", 1, 8), 0.5)).alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("x"))


@query(f"{with_views('vectors')} SELECT vec_id, i - 1 AS pos, round((e[i] * 0.229 + 0.485 - 0.481) / 0.268, 6) + 0.0 AS x FROM vectors, (SELECT unnest(range(1, 65)) AS i)")
def v10_renormalize_stats(spark, d):
    v = X.vectors(spark, d).select("vec_id", F.posexplode(V.renormalize(F.col("e"), 0.485, 0.229, 0.481, 0.268)).alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("x"))


@query(f"{with_views('vec_query', 'vec_db')} SELECT query_id, db_id, round(list_cosine_similarity(q, e), 6) + 0.0 AS sim FROM vec_query, vec_db")
def j01_cosine_cross_join(spark, d):
    q, db = X.split_vectors(spark, d)
    return R.cosine_pairs(q, db, 6)


@query(f"{_RANK} SELECT query_id, CAST(rank AS BIGINT) AS rank, db_id, round(sim, 6) + 0.0 AS sim FROM ranking WHERE rank <= 10")
def t01_topk_per_query(spark, d):
    return ranking(spark, d, 10).select("query_id", "rank", "db_id", r6(F.col("sim")).alias("sim"))


@query(f"{_RANK} SELECT query_id, CAST(rank AS BIGINT) AS rank, db_id, round(sim, 6) + 0.0 AS sim FROM ranking WHERE rank <= 10")
def t03_topk_merge(spark, d):
    """Partial top-k of each pair of blocks, merged."""
    q, db = X.split_vectors(spark, d)
    return R.top_k_blocks(q, db, 10, block_rows=128, query_rows=16, broadcast_bytes=0).select("query_id", "rank", "db_id", r6(F.col("sim")).alias("sim"))


@query(f"{_RANK} SELECT query_id, avg(sim) AS x FROM ranking WHERE rank <= 5 GROUP BY 1".replace("avg(sim)", "round(avg(sim), 6)"))
def t02_topm_mean(spark, d):
    return R.top_m_mean(ranking(spark, d), ["query_id"], "sim", 5).select("query_id", F.round("sim", 6).alias("x"))


def local_scores(ranked):
    return ranked.select("query_id", "db_id", ((F.col("db_id") * 31 + F.col("query_id")) % 17 / 17.0).alias("local"))


@query(f"""{_RANK}, f AS (SELECT query_id, db_id, rank, 0.5 * sim + 0.5 * ((db_id * 31 + query_id) % 17 / 17.0) AS fused FROM ranking WHERE rank <= 10)
SELECT query_id, db_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, rank) AS BIGINT) AS new_rank, round(fused, 6) AS fused FROM f""")
def t04_rerank_sort(spark, d):
    coarse = stored(ranking(spark, d, 10), "ranking")
    return R.rerank(coarse, local_scores(coarse), 0.5).select("query_id", "db_id", "new_rank", F.round("fused", 6).alias("fused"))


@query(f"{_RANK} SELECT query_id, db_id, CAST(rank AS BIGINT) AS rank FROM ranking")
def w01_rank_in_query(spark, d):
    return ranking(spark, d).select("query_id", "db_id", "rank")


@query(f"""{_RANK} SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(sum(CASE WHEN label = q_label THEN 1 ELSE 0 END) OVER w AS BIGINT) AS hits,
round(sum(CASE WHEN label = q_label THEN 1 ELSE 0 END) OVER w / rank, 6) AS precision FROM ranking WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)""")
def w02_cumulative_hits(spark, d):
    r = stored(ranking(spark, d), "ranking")
    return E.precision_at_hits(r, positives(spark, d, r)).select("query_id", "rank", "hits", F.round("precision", 6).alias("precision"))


@query(f"""{with_views('unit')}, s AS (SELECT q.vec_id AS query_id, d.vec_id AS db_id, round(list_dot_product(q.e, d.e), 9) AS sim FROM unit q JOIN unit d ON q.vec_id % 10 = 0 AND d.vec_id % 10 <> 0)
SELECT query_id, db_id, CAST(rank() OVER (PARTITION BY query_id ORDER BY sim DESC) AS BIGINT) AS value_rank, round(cume_dist() OVER (PARTITION BY query_id ORDER BY sim), 6) AS percentile FROM s""")
def w03_value_rank_percentile(spark, d):
    q, db = X.split_vectors(spark, d)
    return R.value_ranks(q, db)


@query(f"{_RANK} SELECT query_id, db_id, round((sim - min(sim) OVER w) / greatest(max(sim) OVER w - min(sim) OVER w, 1e-12), 6) AS x FROM ranking WINDOW w AS (PARTITION BY query_id)")
def w04_minmax_scale(spark, d):
    s, w = ranking(spark, d), Window.partitionBy("query_id")
    low, high = F.min("sim").over(w), F.max("sim").over(w)
    return s.select("query_id", "db_id", F.round((F.col("sim") - low) / F.greatest(high - low, F.lit(1e-12)), 6).alias("x"))


@query(f"{_RANK}, x AS (SELECT query_id, db_id, exp(15 * (sim - max(sim) OVER (PARTITION BY query_id))) AS e FROM ranking) SELECT query_id, db_id, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS x FROM x")
def w05_softmax_partition(spark, d):
    w = Window.partitionBy("query_id")
    e = ranking(spark, d).withColumn("e", F.exp(15 * (F.col("sim") - F.max("sim").over(w))))
    return e.select("query_id", "db_id", F.round(F.col("e") / F.sum("e").over(w), 6).alias("x"))


@query(f"{with_views('patches')} SELECT image_idx, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM (SELECT *, row_number() OVER (PARTITION BY image_idx ORDER BY round(\"desc\"[1], 9) DESC, p) AS r FROM patches) WHERE r = 1")
def w06_argmax_partition(spark, d):
    best = F.max_by(F.struct("row", "col"), F.struct(F.round(F.col("desc")[0], 9), -F.col("p")))
    return X.patches(spark, d).groupBy("image_idx").agg(best.alias("b")).select("image_idx", F.col("b.row").cast("long").alias("row"), F.col("b.col").cast("long").alias("col"))


@query(f"""{_RANK}{_POS}, first AS (SELECT r.query_id, r.db_id, g.gt, (r.db_id = g.gt) AS ok, EXISTS (SELECT 1 FROM ranking x WHERE x.query_id = r.query_id AND x.db_id = g.gt) AS inside FROM ranking r JOIN gt g USING (query_id) WHERE rank = 1)
SELECT CASE WHEN ok THEN 'correct' ELSE 'error' END AS kind, query_id, db_id, gt FROM (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY (CASE WHEN inside THEN 0 ELSE 1 END), query_id) AS r FROM first) WHERE r = 1""")
def w08_pick_example(spark, d):
    """The first correct query; the first wrong one, those with the truth inside the ranking before others."""
    r, gt = stored(ranking(spark, d), "ranking"), lowest_positive(spark, d)
    inside = r.join(gt, "query_id").groupBy("query_id").agg(F.max((F.col("db_id") == F.col("gt")).cast("int")).alias("inside"))
    first = r.where("rank = 1").join(gt, "query_id").join(inside, "query_id").withColumn("kind", F.when(F.col("db_id") == F.col("gt"), "correct").otherwise("error"))
    w = Window.partitionBy("kind").orderBy(F.desc("inside"), "query_id")
    return first.withColumn("r", F.row_number().over(w)).where("r = 1").select("kind", "query_id", "db_id", "gt")


@query(f"{_RANK} SELECT query_id, db_id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS r FROM ranking) WHERE r = 1")
def w09_first_wins_dedup(spark, d):
    labels = X.vectors(spark, d).select(F.col("vec_id").alias("db_id"), "label")
    first = ranking(spark, d).join(labels, "db_id").groupBy("query_id", "label").agg(F.min_by("db_id", "rank").alias("db_id"), F.min("rank").alias("rank"))
    return first.select("query_id", "db_id", "rank")


_KS = [1, 5, 10, 20]


@query(f"{_RANK}{_POS}, h AS (SELECT g.query_id, min(CASE WHEN r.db_id = g.gt THEN r.rank END) AS hit FROM gt g JOIN ranking r USING (query_id) GROUP BY 1) SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN hit <= k THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n_valid FROM h, (SELECT unnest([1, 5, 10, 20]) AS k) GROUP BY 1")
def e01_recall_at_k(spark, d):
    return E.recall_at_k(ranking(spark, d), lowest_positive(spark, d), _KS).select("k", F.round("recall", 6).alias("recall"), "n_valid")


@query(f"{_RANK}{_POS} SELECT round(avg(CASE WHEN r.db_id = g.gt THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_valid FROM ranking r JOIN gt g USING (query_id) WHERE rank = 1")
def e02_top1_accuracy(spark, d):
    return E.recall_at_k(ranking(spark, d), lowest_positive(spark, d), [1]).select(F.round("recall", 6).alias("accuracy"), "n_valid")


@query(f"{_RANK}, h AS (SELECT query_id, min(CASE WHEN label = q_label THEN rank END) AS hit FROM ranking GROUP BY 1) SELECT CAST(k AS BIGINT) AS k, CAST(sum(CASE WHEN hit <= k THEN 1 ELSE 0 END) AS BIGINT) AS n_hit, round(avg(CASE WHEN hit <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM h, (SELECT unnest([1, 5, 10, 20]) AS k) GROUP BY 1")
def e03_recall_any_positive(spark, d):
    r = stored(ranking(spark, d), "ranking")
    return E.recall_any(r, positives(spark, d, r), _KS).select("k", "n_hit", F.round("recall", 6).alias("recall"))


@query(f"""{_RANK}{_POS}, m AS (SELECT query_id, rank, label = q_label AS hit, sum(CASE WHEN label = q_label THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM ranking),
n AS (SELECT query_id, count(*) AS n FROM pos GROUP BY 1), ap AS (SELECT n.query_id, coalesce((SELECT sum(hits / rank) FROM m WHERE m.query_id = n.query_id AND hit), 0) / least(n, 20) AS ap FROM n)
SELECT round(avg(ap), 6) AS map, count(*) AS n_valid FROM ap""")
def e04_map_at_k(spark, d):
    r = stored(ranking(spark, d), "ranking")
    return E.map_at_k(r, positives(spark, d, r), 20, of_label(spark, d)).select(F.round("map", 6).alias("map"), "n_valid")


@query(f"{_RANK}{_POS} SELECT round(avg(coalesce(1.0 / r.rank, 0)), 6) AS mrr, count(*) AS n_valid FROM gt g LEFT JOIN ranking r ON r.query_id = g.query_id AND r.db_id = g.gt")
def e05_single_gt_map(spark, d):
    return E.mean_reciprocal_rank(ranking(spark, d), lowest_positive(spark, d), 20).select(F.round("mrr", 6).alias("mrr"), "n_valid")


def predictions(spark, d):
    """A made-up prediction for each query: the right tile for every other one, and a shifted offset."""
    g = X.query_geo(spark, d)
    return g.select("query_idx", F.when(F.col("query_idx") % 8 == 0, F.col("gt_tile")).otherwise(F.col("gt_tile") - 1).alias("tile"), (F.col("dx") + F.col("query_idx") % 50).alias("px"), (F.col("dy") - F.col("query_idx") % 30).alias("py"))


_PRED = f"{with_views('query_geo')}, pred AS (SELECT query_idx, CASE WHEN query_idx % 8 = 0 THEN gt_tile ELSE gt_tile - 1 END AS tile, dx + query_idx % 50 AS px, dy - query_idx % 30 AS py FROM query_geo)"
_SUMMARY = ", ".join(["round(avg(err), 6) AS e_mean", "round(median(err), 6) AS e_median", "count(err) AS e_count", *[f"round(avg(CASE WHEN err <= {t} THEN 1.0 ELSE 0.0 END), 6) AS e_sr{t}" for t in (16, 32, 64)]])


def _summary(errors):
    s = E.error_summary(errors, [16, 32, 64], "e")
    return s.select(*[F.round(c, 6).alias(c) if c != "e_count" else F.col(c) for c in s.columns])


@query(f"{_PRED}, err AS (SELECT sqrt((px - dx) ** 2 + (py - dy) ** 2) AS err FROM pred JOIN query_geo USING (query_idx)) SELECT {_SUMMARY} FROM err")
def e06_offset_error(spark, d):
    return _summary(E.offset_errors(predictions(spark, d), X.query_geo(spark, d)))


@query(f"""{_PRED}, err AS (SELECT CASE WHEN t.image_idx % 5 = 4 OR g.image_idx % 5 = 4 THEN CASE WHEN tile = gt_tile THEN sqrt((px - dx) ** 2 + (py - dy) ** 2) END
ELSE sqrt((t.cx + px - g.cx - dx) ** 2 + (t.cy + py - g.cy - dy) ** 2) END AS err FROM pred JOIN query_geo USING (query_idx) JOIN tile_geo t ON t.image_idx = tile JOIN tile_geo g ON g.image_idx = gt_tile)
SELECT {_SUMMARY} FROM err WHERE err IS NOT NULL""")
def e07_localization_error(spark, d):
    """Every fifth tile has no centre."""
    t = X.tile_geo(spark, d)
    some = t.select("image_idx", *[F.when(F.col("image_idx") % 5 != 4, F.col(c)).alias(c) for c in ("cx", "cy")])
    return _summary(E.localization_errors(predictions(spark, d), X.query_geo(spark, d), some))


@query(f"{with_views('vec_query', 'vec_db')} SELECT query_id, CAST(rank AS BIGINT) AS rank, db_id, round(dist, 6) AS dist FROM (SELECT query_id, db_id, round(list_distance(q, e), 9) AS dist, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(q, e), 9), db_id) AS rank FROM vec_query, vec_db) WHERE rank <= 10")
def m08_flat_index_search(spark, d):
    q, db = X.split_vectors(spark, d)
    near = R.top_k_blocks(q, db, 10, metric="l2")
    return near.select("query_id", "rank", "db_id", F.round(-F.col("sim"), 6).alias("dist"))
