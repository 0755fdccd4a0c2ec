"""Score maps, geometry, masks, learning and sampling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import geometry as G
from tessella.functions.vector import r6
from tessella.operators import learning as L
from tessella.operators import maps as A
from tessella.operators import masks as K
from tessella.operators import mining as T
from tessella.operators import segments as S
from tessella.plans import fixtures as X
from tessella.plans.fixtures import with_views
from tessella.queries.pools import adjacency  # noqa: F401
from tessella.queries.registry import doubles, query

_PAIRS = with_views("patches") + ", pairs AS (SELECT DISTINCT image_idx AS query_idx, image_idx + 1 AS tile_idx FROM patches WHERE image_idx % 4 = 0)"
_SIMS = _PAIRS + ', sims AS (SELECT query_idx, tile_idx, q.p AS qp, t.p AS tp, list_cosine_similarity(q."desc", t."desc") AS sim FROM pairs JOIN patches q ON q.image_idx = query_idx JOIN patches t ON t.image_idx = tile_idx)'
_MAP = _SIMS + ", map AS (SELECT query_idx, tile_idx, tp, avg(sim) AS v FROM (SELECT *, row_number() OVER (PARTITION BY query_idx, tile_idx, tp ORDER BY sim DESC) AS r FROM sims) WHERE r <= 8 GROUP BY 1, 2, 3)"


def pairs(spark, d):
    return X.patches(spark, d).where("image_idx % 4 = 0").select(F.col("image_idx").alias("query_idx"), (F.col("image_idx") + 1).alias("tile_idx")).distinct()


def sides(spark, d):
    p = X.patches(spark, d)
    return pairs(spark, d), p, p


@query(f"{_SIMS} SELECT query_idx, tile_idx, qp, tp, round(sim, 6) + 0.0 AS sim FROM sims")
def j12_patch_pair_similarity(spark, d):
    return A.patch_pairs(*sides(spark, d)).withColumn("sim", r6(F.col("sim")))


@query(f"""{_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_idx, tile_idx, qp ORDER BY round(sim, 9) DESC, tp) AS b, row_number() OVER (PARTITION BY query_idx, tile_idx, tp ORDER BY round(sim, 9) DESC, qp) AS a FROM sims)
SELECT query_idx, tile_idx, round(coalesce(avg(CASE WHEN a = 1 AND b = 1 THEN sim END), avg(CASE WHEN b = 1 THEN sim END)), 6) AS score, count(CASE WHEN a = 1 AND b = 1 THEN 1 END) AS n_mutual FROM r GROUP BY 1, 2""")
def j13_mutual_nn_join(spark, d):
    return A.mutual_nearest(*sides(spark, d)).withColumn("score", F.round("score", 6))


@query(f"{_MAP} SELECT query_idx, tile_idx, tp, round(v, 6) + 0.0 AS v FROM map")
def g07_similarity_map(spark, d):
    return A.similarity_map(*sides(spark, d), 8).withColumn("v", r6(F.col("v")))


@query(f"""{_MAP}, best AS (SELECT query_idx, tile_idx, qp, max(sim) AS s FROM sims GROUP BY 1, 2, 3), pool AS (SELECT query_idx, tile_idx, avg(s) AS cosine_pool FROM (SELECT *, row_number() OVER (PARTITION BY query_idx, tile_idx ORDER BY s DESC) AS r FROM best) WHERE r <= 8 GROUP BY 1, 2),
m AS (SELECT query_idx, tile_idx, avg(v) AS sim_map FROM (SELECT *, row_number() OVER (PARTITION BY query_idx, tile_idx ORDER BY v DESC) AS r FROM map) WHERE r <= 8 GROUP BY 1, 2) SELECT query_idx, tile_idx, round(cosine_pool, 6) AS cosine_pool, round(sim_map, 6) AS sim_map FROM pool JOIN m USING (query_idx, tile_idx)""")
def g08_local_match_score(spark, d):
    s = sides(spark, d)
    a = A.match_scores(*s, "cosine_pool", 8).select(*A.PAIR, F.round("score", 6).alias("cosine_pool"))
    return a.join(A.match_scores(*s, "sim_map", 8).select(*A.PAIR, F.round("score", 6).alias("sim_map")), A.PAIR)


@query(f"{_MAP}, e AS (SELECT *, exp(15 * (v - max(v) OVER (PARTITION BY query_idx, tile_idx))) AS e FROM map) SELECT query_idx, tile_idx, round(sum(e * ((tp % 5 + 0.5) / 5 - 0.5)) / sum(e) * 512, 6) + 0.0 AS px, round(sum(e * ((tp // 5 + 0.5) / 5 - 0.5)) / sum(e) * 512, 6) + 0.0 AS py FROM e GROUP BY 1, 2")
def g09_softargmax_offset(spark, d):
    o = A.soft_argmax(A.similarity_map(*sides(spark, d), 8), 5, 5, 15.0, 512.0)
    return o.select(*A.PAIR, r6(F.col("px")).alias("px"), r6(F.col("py")).alias("py"))


_NCC = _PAIRS + """, unit AS (SELECT image_idx, p, row, col, list_transform("desc", lambda x: x / greatest(sqrt(list_dot_product("desc", "desc")), 1e-12)) AS u FROM patches),
qs AS (SELECT image_idx, sum(list_sum(u)) AS s, sum(list_dot_product(u, u)) AS s2, sum(len(u)) AS n FROM unit WHERE row < 3 AND col < 3 GROUP BY 1),
ncc AS (SELECT query_idx, tile_idx, CAST(dy AS BIGINT) AS dy, CAST(dx AS BIGINT) AS dx, (sum(list_dot_product(q.u, t.u)) - max(s / n) * sum(list_sum(t.u))) / (greatest(sqrt(greatest(max(s2 - s * s / n), 0)), 1e-6) * sqrt(greatest(sum(list_dot_product(t.u, t.u)) - sum(list_sum(t.u)) ** 2 / max(n), 1e-6))) AS v
FROM pairs JOIN unit q ON q.image_idx = query_idx AND q.row < 3 AND q.col < 3 JOIN qs ON qs.image_idx = query_idx, (SELECT unnest(range(0, 3)) AS dy), (SELECT unnest(range(0, 3)) AS dx), unit t WHERE t.image_idx = tile_idx AND t.row = q.row + dy AND t.col = q.col + dx GROUP BY 1, 2, 3, 4)"""


def ncc(spark, d):
    p = X.patches(spark, d)
    return A.ncc_map(pairs(spark, d), p.where("row < 3 and col < 3"), p, (3, 3), (5, 5))


@query(f"{_NCC} SELECT query_idx, tile_idx, dy, dx, round(v, 6) + 0.0 AS v FROM ncc")
def g10_ncc_map(spark, d):
    return ncc(spark, d).withColumn("v", r6(F.col("v")))


@query(f"{_NCC} SELECT query_idx, tile_idx, round(((dx + 1.5) / 5 - 0.5) * 512, 6) + 0.0 AS px, round(((dy + 1.5) / 5 - 0.5) * 512, 6) + 0.0 AS py FROM (SELECT *, row_number() OVER (PARTITION BY query_idx, tile_idx ORDER BY round(v, 9) DESC, dy, dx) AS r FROM ncc) WHERE r = 1")
def g11_ncc_offset(spark, d):
    return A.ncc_offset(ncc(spark, d), (3, 3), (5, 5), 512.0).select(*A.PAIR, r6(F.col("px")).alias("px"), r6(F.col("py")).alias("py"))


@query("SELECT p_partkey, (p_size * 20 // 14) * 14 AS h, (p_partkey % 500 + 20) // 14 * 14 AS w, p_size * 20 // 14 AS gh, (p_partkey % 500 + 20) // 14 AS gw FROM part".replace("p_size", "CAST(p_size AS BIGINT)"))
def g01_crop_to_stride(spark, d):
    out = G.crop_to_stride(F.col("p_size") * 20, F.col("p_partkey") % 500 + 20, 14)
    return X.table(spark, d, "part").select("p_partkey", *[c.alias(n) for c, n in zip(out, ("h", "w", "gh", "gw"))])


@query("SELECT p_partkey, least(greatest((p_partkey % 80 - 5) * 5 // 70, 0), 4) * 5 + least(greatest((p_size + 10) * 5 // 70, 0), 4) AS patch FROM part")
def g02_pixel_to_patch(spark, d):
    return X.table(spark, d, "part").select("p_partkey", S.pixel_to_patch(F.col("p_partkey") % 80 - 5, F.col("p_size") + 10, 70, 70, 5, 5).alias("patch"))


@query("SELECT p_partkey, (p_partkey % 500 + 60 - p_size) // 2 AS top, CAST(round_even(p_partkey + 0.5 - p_size / 2.0, 0) AS BIGINT) AS start FROM part")
def g03_center_crop_box(spark, d):
    top, _ = G.center_crop(F.col("p_partkey") % 500 + 60, F.lit(0), F.col("p_size"), F.lit(0))
    return X.table(spark, d, "part").select("p_partkey", top.alias("top"), G.center_crop_even(F.col("p_partkey") + 0.5, F.col("p_size").cast("double")).alias("start"))


@query()
def g05_adjacency_delaunay(spark, d):
    v = X.vectors(spark, d)
    cents = v.select(F.expr("vec_id div 25").alias("image_idx"), (F.col("vec_id") % 25).alias("seg"), F.col("e")[0].alias("cx"), F.col("e")[1].alias("cy"))
    return K.delaunay_adjacency(cents)


@query(f"{with_views('query_geo')} SELECT query_idx, round((dx / 512 + 0.5) * 36 - 0.5, 6) + 0.0 AS gx, round((-dy / 512 + 0.5) * 36 - 0.5, 6) + 0.0 AS gy, round(dx, 6) + 0.0 AS bx, round(-dy, 6) + 0.0 AS by_ FROM query_geo")
def g12_offset_grid_convert(spark, d):
    w = F.lit(512.0)
    gx, gy = G.offset_to_grid(F.col("dx"), F.col("dy"), w, w, 36, 36, flip_y=True)
    bx, by = G.grid_to_offset(gx, gy, w, w, 36, 36)
    return X.query_geo(spark, d).select("query_idx", r6(gx).alias("gx"), r6(gy).alias("gy"), r6(bx).alias("bx"), r6(by).alias("by_"))


_RUNS = """WITH b AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS bit FROM events), m AS (SELECT *, CASE WHEN bit <> lag(bit, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM b),
g AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m), r AS (SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n FROM g GROUP BY 1, 2),
runs AS (SELECT * FROM r UNION ALL SELECT DISTINCT user_id, CAST(0 AS BIGINT), 0 FROM b WHERE user_id NOT IN (SELECT user_id FROM r WHERE run = 0))"""


def runs(spark, d):
    bits = X.table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "click").cast("int").alias("bit")).where("user_id is not null")
    return K.rle_encode(bits, "user_id", "event_id", "bit")


@query(f"{_RUNS} SELECT user_id, run, n FROM runs WHERE user_id IS NOT NULL")
def w07_rle_encode(spark, d):
    return runs(spark, d)


@query(f"{_RUNS} SELECT user_id, pos FROM (SELECT user_id, bit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM b) WHERE bit = 1 AND user_id IS NOT NULL")
def g13_rle_decode(spark, d):
    return K.rle_decode(runs(spark, d), "user_id")


@query(f"{with_views('segments')}, m AS (SELECT * FROM segments WHERE image_idx % 3 <> 0) SELECT i.image_idx, i.seg, coalesce(min(col), 0) AS x, coalesce(min(row), 0) AS y, coalesce(max(col) - min(col), 0) AS w, coalesce(max(row) - min(row), 0) AS h FROM (SELECT DISTINCT image_idx, seg FROM segments) i LEFT JOIN m USING (image_idx, seg) GROUP BY 1, 2")
def g14_mask_bbox(spark, d):
    s = X.segments(spark, d)
    return K.mask_boxes(s.where("image_idx % 3 <> 0"), s.select("image_idx", "seg").distinct(), ["image_idx", "seg"])


def _greedy(source: str, threshold: float) -> str:
    """Suppression as recursion: each step takes the best box left of every group and drops what overlaps it."""
    return f""", RECURSIVE_n AS (SELECT grp, box_id, x0, y0, x1, y1, score, 0 AS step FROM {source} UNION ALL SELECT grp, box_id, x0, y0, x1, y1, score, step + 1 FROM (SELECT *, row_number() OVER w AS r, first_value(x0) OVER w AS a0, first_value(y0) OVER w AS b0, first_value(x1) OVER w AS a1, first_value(y1) OVER w AS b1 FROM RECURSIVE_n WINDOW w AS (PARTITION BY grp ORDER BY score DESC, box_id, x0, y0, x1, y1))
WHERE r > 1 AND NOT greatest(least(x1, a1) - greatest(x0, a0), 0) * greatest(least(y1, b1) - greatest(y0, b0), 0) > {threshold} * ((x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) - greatest(least(x1, a1) - greatest(x0, a0), 0) * greatest(least(y1, b1) - greatest(y0, b0), 0)))
SELECT grp, box_id FROM (SELECT grp, box_id, row_number() OVER (PARTITION BY grp, step ORDER BY score DESC, box_id, x0, y0, x1, y1) AS r FROM RECURSIVE_n) WHERE r = 1""".replace("RECURSIVE_n", "left_over")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(with_views("boxes") + _greedy("boxes", 0.5)))
def g15_nms(spark, d):
    return K.nms(X.boxes(spark, d), 0.5)


@query(_recursive(with_views("boxes") + ", crops AS (SELECT * REPLACE (CAST(1.0 AS DOUBLE) / CAST((20 + box_id % 4 * 20) * (30 + box_id % 3 * 10) AS DOUBLE) AS score) FROM boxes)" + _greedy("crops", 0.7)))
def g15_nms_across_crops(spark, d):
    """Boxes found in several crops: those of smaller crops come first."""
    size = lambda n, a, b: (a + F.col("box_id") % n * b).cast("double")
    return K.nms_across_crops(X.boxes(spark, d).withColumns({"crop_x0": F.lit(0.0), "crop_y0": F.lit(0.0), "crop_x1": size(4, 20, 20), "crop_y1": size(3, 30, 10)}), 0.7)


@query(_recursive(with_views("boxes") + ", marked AS (SELECT * REPLACE (CASE WHEN box_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS score) FROM boxes)" + _greedy("marked", 0.7)))
def g15_nms_after_cleanup(spark, d):
    """Masks that cleaning has not changed come first."""
    return K.nms_after_cleanup(X.boxes(spark, d).withColumn("changed", F.col("box_id") % 3 == 0), 0.7)


@query("""WITH l AS (SELECT unnest([1, 2]) AS layer), p AS (SELECT layer, CAST(2 ** layer AS BIGINT) AS n FROM l), o AS (SELECT layer, n, CAST(floor(0.3413333 * 480 * (2.0 / n)) AS BIGINT) AS over FROM p),
c AS (SELECT *, CAST(ceil((over * (n - 1) + 640) / n) AS BIGINT) AS cw, CAST(ceil((over * (n - 1) + 480) / n) AS BIGINT) AS ch FROM o)
SELECT CAST(0 AS BIGINT) AS layer, CAST(0 AS BIGINT) AS x0, CAST(0 AS BIGINT) AS y0, CAST(640 AS BIGINT) AS x1, CAST(480 AS BIGINT) AS y1
UNION ALL SELECT layer, i * (cw - over), j * (ch - over), least(i * (cw - over) + cw, 640), least(j * (ch - over) + ch, 480) FROM c, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j) WHERE i < n AND j < n""")
def g16_crop_pyramid(spark, d):
    return G.crop_pyramid(spark, 480, 640, 2, 0.3413333)


@query("SELECT r, c, (c + 0.5) / 8 AS x, (r + 0.5) / 8 AS y FROM (SELECT unnest(range(0, 8)) AS r), (SELECT unnest(range(0, 8)) AS c)")
def g17_point_grid(spark, d):
    return G.point_grid(spark, 8)


@query(f"{with_views('patches')} SELECT image_idx, round(count(CASE WHEN \"desc\"[1] > 0.02 THEN 1 END) * 1.0 / nullif(count(CASE WHEN \"desc\"[1] > -0.3 THEN 1 END), 0), 6) AS stability FROM patches GROUP BY 1")
def g18_stability_score(spark, d):
    v = X.patches(spark, d).select("image_idx", F.col("desc")[0].alias("v"))
    return K.stability(v, "image_idx", -0.14, 0.16).withColumn("stability", F.round("stability", 6))


@query(f"{with_views('boxes')} SELECT box_id, grp, (abs(x0 - 10) <= 20 AND NOT abs(x0) <= 20) OR (abs(y0 - 10) <= 20 AND NOT abs(y0) <= 20) OR (abs(x1 - 90) <= 20 AND NOT abs(x1 - 160) <= 20) OR (abs(y1 - 90) <= 20 AND NOT abs(y1 - 160) <= 20) AS near FROM boxes")
def g19_near_crop_edge(spark, d):
    f = lambda *v: [F.lit(float(x)) for x in v]
    return X.boxes(spark, d).select("box_id", "grp", G.near_crop_edge([F.col(c) for c in ("x0", "y0", "x1", "y1")], f(10, 10, 90, 90), f(0, 0, 160, 160)).alias("near"))


@query(f"{with_views('boxes')} SELECT box_id, grp, x0 + 7 AS ux0, y0 + 3 AS uy0, x1 + 7 AS ux1, y1 + 3 AS uy1 FROM boxes")
def g20_uncrop(spark, d):
    out = G.uncrop([F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(7.0), F.lit(3.0))
    return X.boxes(spark, d).select("box_id", "grp", *[c.alias(n) for c, n in zip(out, ("ux0", "uy0", "ux1", "uy1"))])


@query()
def g21_remove_small_regions(spark, d):
    cells = X.patches(spark, d).where(F.col("desc")[0] > 0).select(F.col("image_idx").alias("mask_id"), "row", "col")
    return K.small_regions(cells, 5, 5, 3, "islands")


@query()
def g21_clean_masks(spark, d):
    """Holes and islands of every image's mask, and the masks left by their boxes."""
    cells = X.patches(spark, d).where(F.col("desc")[0] > 0).select(F.expr("image_idx div 4").alias("image_idx"), F.col("image_idx").alias("mask_id"), "row", "col")
    return K.clean_masks(cells, 5, 5, 3)


@query(doubles("SELECT 'tile_r' || lpad(CAST(r AS VARCHAR), 2, '0') || '_c' || lpad(CAST(c AS VARCHAR), 2, '0') AS tile_id, r AS row, c AS col, (c + 0.5) * 512 AS cx, (r + 0.5) * 512 AS cy, c * 512 AS x0, r * 512 AS y0, (c + 1) * 512 AS x1, (r + 1) * 512 AS y1 FROM (SELECT unnest(range(0, 8)) AS r), (SELECT unnest(range(0, 8)) AS c)", "cx", "cy"))
def g22_tile_grid(spark, d):
    return G.tile_grid(spark, 8, 8, 512)


@query(doubles(f"{with_views('query_geo')}, t AS (SELECT query_idx, x, y, CAST(least(greatest(floor(y / 512), 0), 7) AS BIGINT) AS r, CAST(least(greatest(floor(x / 512), 0), 7) AS BIGINT) AS c FROM query_geo) SELECT query_idx, 'tile_r' || lpad(CAST(r AS VARCHAR), 2, '0') || '_c' || lpad(CAST(c AS VARCHAR), 2, '0') AS tile_id, x - (c + 0.5) * 512 AS ox, y - (r + 0.5) * 512 AS oy FROM t", "ox", "oy"))
def g23_point_to_tile(spark, d):
    _, _, t, ox, oy = G.point_to_tile(F.col("x"), F.col("y"), 512, 8, 8)
    return X.query_geo(spark, d).select("query_idx", t.alias("tile_id"), ox.alias("ox"), oy.alias("oy"))


@query("SELECT p_partkey, CAST(ceil(sqrt(CAST(p_size * p_size + p_partkey * p_partkey AS DOUBLE))) AS BIGINT) AS side FROM part")
def g24_rotation_support(spark, d):
    return X.table(spark, d, "part").select("p_partkey", G.rotation_support(F.col("p_size"), F.col("p_partkey")).alias("side"))


@query("SELECT unnest(range(0, 2977, 896)) AS start UNION SELECT 2976")
def g25_overlap_tiles(spark, d):
    return G.overlap_starts(spark, 4000, 1024, 128)


@query(doubles("SELECT s_suppkey, 53.9 - (s_nationkey * 256 + 0.25 * 128 + 256 - 2048) * 0.00001 AS lat, -1.1 + (s_suppkey * 256 + 0.5 * 128 + 256 - 2048) * 0.00002 AS lon FROM supplier", "lat", "lon"))
def g26_norm_to_latlon(spark, d):
    lat, lon = G.norm_to_latlon(F.col("s_suppkey"), F.col("s_nationkey"), F.lit(0.5), F.lit(0.25), 4096, 53.9, -1.1, 0.00001, 0.00002)
    return X.table(spark, d, "supplier").select("s_suppkey", lat.alias("lat"), lon.alias("lon"))


@query("""WITH k AS (SELECT 204.5 * 256 / (64 * 935) AS k) SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN k * 36.0 * 0.14 / p_size WHEN 1 THEN p_retailprice * p_size / (k * 0.14) WHEN 2 THEN k * 36.0 * 0.14 / p_retailprice ELSE p_retailprice * p_size / (k * 36.0) END, 6) AS v FROM part, k""")
def g27_altitude_formula(spark, d):
    i = F.col("p_partkey") % 4
    but = lambda n, c: F.when(i != n, c)
    v = G.altitude_formula(but(0, F.col("p_retailprice")), but(1, F.lit(36.0)), but(2, F.col("p_size").cast("double")), but(3, F.lit(0.14)))
    return X.table(spark, d, "part").select("p_partkey", F.round(v, 6).alias("v"))


@query("SELECT i, j, round(53.947228 + i * (36.0 / 111000), 6) AS lat, round(-1.155475 + j * (36.0 / 111000) / cos(radians(53.947228)), 6) AS lon FROM (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(range(0, 7)) AS j)")
def g28_latlon_grid(spark, d):
    return G.latlon_grid(spark, 53.947228, -1.155475, 6, 7, 36.0)


_FOOT = "36.0 / (2 * 111000)"


@query(f"""WITH g AS (SELECT i, j, round(53.947228 + (i - 2.5) * (36.0 / 111000), 6) AS lat FROM (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(range(0, 7)) AS j)), h AS (SELECT *, round(-1.155475 + (j - 3.0) * (36.0 / 111000) / cos(radians(lat)), 6) AS lon FROM g)
SELECT i, j, lat, lon, round(lon - {_FOOT} / cos(radians(lat)), 9) AS left_lon, round(lon + {_FOOT} / cos(radians(lat)), 9) AS right_lon, round(lat + {_FOOT}, 9) AS top_lat, round(lat - {_FOOT}, 9) AS bottom_lat, round(36.0 / (256 * 111000), 12) AS lat_per_pixel, round(36.0 / (256 * 111000) / cos(radians(lat)), 12) AS lon_per_pixel FROM h""".replace("36.0", "CAST(36 AS DOUBLE)"))
def g28_footprints(spark, d):
    """A lattice around its middle, each row with its own step of longitude, and what each image covers."""
    return G.footprints(G.centered_lattice(spark, 53.947228, -1.155475, 6, 7, 36.0), 36.0, 36.0, 256, 256)


@query(f"{with_views('patches')} SELECT image_idx, y, x, round(\"desc\"[1], 6) + 0.0 AS v FROM patches, (SELECT unnest(range(0, 15)) AS y), (SELECT unnest(range(0, 15)) AS x) WHERE row = y * 5 // 15 AND col = x * 5 // 15")
def g29_upsample_grid(spark, d):
    """Nearest: every pixel takes its patch."""
    p = X.patches(spark, d).select("image_idx", "p", F.col("desc")[0].alias("v"))
    px = p.select("image_idx").distinct().select("image_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("y")).select("image_idx", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("x"))
    return px.withColumn("p", S.pixel_to_patch(F.col("y"), F.col("x"), 15, 15, 5, 5)).join(p, ["image_idx", "p"]).select("image_idx", "y", "x", r6(F.col("v")).alias("v"))


@query(f"""{with_views('patches')}, px AS (SELECT i.image_idx, y, x, greatest((y + 0.5) * 5 / 15 - 0.5, 0) AS sy, greatest((x + 0.5) * 5 / 15 - 0.5, 0) AS sx FROM (SELECT DISTINCT image_idx FROM patches) i, (SELECT unnest(range(0, 15)) AS y), (SELECT unnest(range(0, 15)) AS x))
SELECT px.image_idx, y, x, round(sum("desc"[1] * greatest(1 - abs(least(sy, 4) - row), 0) * greatest(1 - abs(least(sx, 4) - col), 0)), 6) + 0.0 AS v FROM px JOIN patches USING (image_idx) GROUP BY 1, 2, 3""")
def g29_upsample_bilinear(spark, d):
    p = X.patches(spark, d).select("image_idx", "row", "col", F.col("desc")[0].alias("v"))
    return S.upsample_bilinear(p, (5, 5), (15, 15)).withColumn("v", r6(F.col("v")))


@query("SELECT p_partkey, CAST(floor(p_size * (1024.0 / greatest(p_size, p_partkey)) + 0.5) AS BIGINT) AS h, CAST(floor(p_partkey * (1024.0 / greatest(p_size, p_partkey)) + 0.5) AS BIGINT) AS w FROM part".replace("1024.0", "CAST(1024 AS DOUBLE)"))
def g31_resize_longest(spark, d):
    h, w = G.resize_longest(F.col("p_size"), F.col("p_partkey"), 1024)
    return X.table(spark, d, "part").select("p_partkey", h.alias("h"), w.alias("w"))


@query("SELECT row, col, pos, round(CASE WHEN (pos // 4) % 2 = 0 THEN sin(ang) ELSE cos(ang) END, 6) + 0.0 AS v FROM (SELECT row, col, pos, (CASE WHEN pos < 8 THEN col ELSE row END) / pow(10000.0, (pos % 4) / 4.0) AS ang FROM (SELECT unnest(range(0, 6)) AS row), (SELECT unnest(range(0, 6)) AS col), (SELECT unnest(range(0, 16)) AS pos))")
def v11_sincos_pe_2d(spark, d):
    return G.sincos_2d(spark, 16, 6).withColumn("v", r6(F.col("v")))


def _u(*parts: str) -> str:
    return "CAST('0x' || substr(sha1(" + " || ':' || ".join(parts) + "), 1, 12) AS BIGINT) / 281474976710656.0"


def _normal(*parts: str) -> str:
    u, v = _u(*parts, "'r'"), _u(*parts, "'a'")
    return f"sqrt(-2 * ln(CAST(1 - {u} AS DOUBLE))) * cos(2 * pi() * {v})"


@query(f"""WITH g AS (SELECT f, {_normal("'1:x'", "f")} AS gx, {_normal("'1:y'", "f")} AS gy FROM (SELECT unnest(range(0, 8)) AS f)), pt AS (SELECT r, c, (c + 0.5) / 4 AS x, (r + 0.5) / 4 AS y FROM (SELECT unnest(range(0, 4)) AS r), (SELECT unnest(range(0, 4)) AS c))
SELECT r, c, f, round(sin(2 * pi() * ((2 * x - 1) * gx + (2 * y - 1) * gy)), 6) + 0.0 AS s, round(cos(2 * pi() * ((2 * x - 1) * gx + (2 * y - 1) * gy)), 6) + 0.0 AS cs FROM pt, g""")
def v12_random_fourier_pe(spark, d):
    """sin and cos of 2 pi (2 c - 1) G for a seeded Gaussian G."""
    g = spark.range(8).select(F.col("id").alias("f"), L.gaussian("1:x", F.col("id")).alias("gx"), L.gaussian("1:y", F.col("id")).alias("gy"))
    a = 2 * math.pi * ((2 * F.col("x") - 1) * F.col("gx") + (2 * F.col("y") - 1) * F.col("gy"))
    return G.point_grid(spark, 4).join(F.broadcast(g), F.lit(True)).select("r", "c", "f", r6(F.sin(a)).alias("s"), r6(F.cos(a)).alias("cs"))  # eight frequencies


_ASSIGN = ", a AS (SELECT image_idx, p, \"desc\", k FROM (SELECT image_idx, p, \"desc\", k, row_number() OVER (PARTITION BY image_idx, p ORDER BY round(list_cosine_similarity(\"desc\", c), 9) DESC, k) AS r FROM patches, centers) WHERE r = 1)"


@query(f"{with_views('patches', 'centers')}{_ASSIGN} SELECT k, i - 1 AS pos, round(avg(\"desc\"[i]), 6) + 0.0 AS x FROM a, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2")
def m01_fit_vocabulary(spark, d):
    """One step from given centres; fit_vocabulary iterates to convergence."""
    return L.lloyd_step(X.patches(spark, d), X.centers(spark, d)).withColumn("x", r6(F.col("x")))


@query()
def m01_fitted(spark, d):
    """The fit itself: its centres, and what it leaves (tests hold that against other starts)."""
    p = X.patches(spark, d)
    return L.inertia(p.select("image_idx", "p", "desc"), L.fit_vocabulary(p, 8)).withColumn("inertia", F.round("inertia", 6))


@query()
def m02_merge_vocabulary(spark, d):
    """One vocabulary of two sets of descriptors: k, pos, x."""
    p = X.patches(spark, d)
    v = L.fit_vocabulary(p.where("image_idx % 2 = 0").select("desc").unionByName(p.where("image_idx % 2 = 1").select("desc")), 4)
    return v.select("k", F.posexplode("c").alias("pos", "x")).select("k", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("x"))


@query()
def m03_vocabulary_sweep(spark, d):
    """Vocabularies of 1, 4, 8, 16 and 64 tiles, as far as the tiles go, with what each leaves of all patches."""
    p, tiles = X.patches(spark, d), tile_files(spark).withColumn("image_idx", F.col("row") * 8 + F.col("col"))
    swept = L.vocabulary_sweep(p, tiles, 8, (1, 4, 8, 16, 64), 2)
    out = [L.inertia(p.select("image_idx", "p", "desc"), swept.where(F.col("tiles") == n).select("k", "c")).select(F.lit(n).cast("long").alias("tiles"), F.round("inertia", 6).alias("inertia")) for n in (1, 4, 8, 16, 64)]
    return reduce(lambda a, b: a.unionByName(b), out)


def tile_files(spark):
    return G.tile_grid(spark, 8, 8, 512).select("tile_id", "row", "col")


@query("""SELECT tile_id, row, col FROM (SELECT *, row_number() OVER (PARTITION BY row // 2, col // 2 ORDER BY sha1('42:' || tile_id), tile_id) AS r FROM
(SELECT 'tile_r' || lpad(CAST(r AS VARCHAR), 2, '0') || '_c' || lpad(CAST(c AS VARCHAR), 2, '0') AS tile_id, r AS row, c AS col FROM (SELECT unnest(range(0, 8)) AS r), (SELECT unnest(range(0, 8)) AS c))) WHERE r = 1""")
def m04_block_sample(spark, d):
    return L.block_sample(tile_files(spark), 16, 8, 42)


@query(f"""{with_views('patches')}, f AS (SELECT image_idx FROM (SELECT *, row_number() OVER (ORDER BY sha1('7:' || image_idx), image_idx) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT image_idx FROM patches)) WHERE r <= greatest(1, CAST(round_even(n * 0.5, 0) AS BIGINT))),
e AS (SELECT image_idx, p, row_number() OVER (PARTITION BY image_idx ORDER BY sha1('7:' || image_idx || ':' || p), p) AS r FROM patches JOIN f USING (image_idx))
SELECT image_idx, p FROM e WHERE r <= 9 ORDER BY sha1('7:' || image_idx || ':' || p), image_idx, p LIMIT 60""")
def m05_ratio_sample(spark, d):
    """Half of the images, nine patches of each at most, sixty in all."""
    return L.ratio_sample(X.patches(spark, d).select("image_idx", "p"), "image_idx", "p", 0.5, 9, 60, 7)


@query()
def m06_pca_reduce(spark, d):
    v = X.vectors(spark, d)
    return L.pca(v.where("vec_id % 10 <> 0"), "e", 8, whiten=True)(v.select("vec_id", "e")).select("vec_id", F.posexplode("e").alias("pos", "x"))


@query()
def m07_pca_low_factor(spark, d):
    v = X.vectors(spark, d)
    return L.pca(v, "e", 8, low_factor=0.25)(v.select("vec_id", "e")).select("vec_id", F.posexplode("e").alias("pos", "x"))


_PTS = "WITH pt AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings)"


_MINING = f"""{_PTS}, pr AS (SELECT q.vec_id AS query_id, b.vec_id AS db_id, round(list_distance(q.e, b.e), 9) AS d, (q.x - b.x) ** 2 + (q.y - b.y) ** 2 AS m FROM pt q JOIN pt b ON q.vec_id % 10 = 0 AND b.vec_id % 10 <> 0),
pos AS (SELECT query_id, db_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, db_id) AS r FROM pr WHERE m <= 36.0) WHERE r = 1),"""


@query(f"""{_MINING} neg AS (SELECT query_id, db_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, db_id) AS r FROM pr WHERE NOT m <= 144.0) WHERE r <= 10)
SELECT p.query_id, p.db_id AS positive, n.db_id AS negative FROM pos p JOIN neg n USING (query_id)""")
def m09_triplet_mining(spark, d):
    """The nearest positive within the hard radius, and the ten nearest of all beyond the soft one."""
    return mined(spark, d, "full")


@query(f"""{_MINING} drawn AS (SELECT vec_id AS db_id FROM pt WHERE vec_id % 10 <> 0 ORDER BY sha1('3:' || vec_id), vec_id LIMIT 100),
neg AS (SELECT query_id, db_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, db_id) AS r FROM pr JOIN drawn USING (db_id) WHERE NOT m <= 144.0) WHERE r <= 10)
SELECT p.query_id, p.db_id AS positive, n.db_id AS negative FROM pos p JOIN neg n USING (query_id)""")
def m09_triplet_mining_partial(spark, d):
    """The ten nearest negatives among a hundred database rows drawn for all queries."""
    return mined(spark, d, "partial", samples=100)


@query()
def m09_triplet_mining_random(spark, d):
    """Ten negatives drawn for each query."""
    return mined(spark, d, "random")


def mined(spark, d, mode, samples=1000):
    p = X.vectors(spark, d).select("vec_id", "e", (F.col("e")[0] * 100).alias("x"), (F.col("e")[1] * 100).alias("y"))
    q, b = p.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), p.where("vec_id % 10 <> 0").withColumnRenamed("vec_id", "db_id")
    return T.mine_triplets(q, b, 6.0, 12.0, mode=mode, negatives=10, samples=samples, seed=3)


@query()
def m07_pca_fallback(spark, d):
    """Fewer training rows than dimensions: both sides are first reduced together."""
    v = X.vectors(spark, d).select("vec_id", "e")
    train, test = L.reduce_pca(v.where("vec_id % 10 = 0").limit(40), v.where("vec_id % 10 <> 0"), "e", 8, low_factor=0.25, fallback=20)
    return train.unionByName(test).select("vec_id", F.posexplode("e").alias("pos", "x"))


def _centers_sql(rows: int, cols: int, th: int, tw: int) -> str:
    return f"""WITH u AS (SELECT id, {_u("'42'", "id", "'x'")} AS ux, {_u("'42'", "id", "'y'")} AS uy, CAST(floor({_u("'42'", "id", "'tile'")} * {rows * cols}) AS BIGINT) AS t FROM (SELECT unnest(range(0, 2000)) AS id)),
p AS (SELECT id, CAST(t % {cols} * {tw} + 168 + ux * {tw - 336} AS DOUBLE) AS cx, CAST(t // {cols} * {th} + 168 + uy * {th - 336} AS DOUBLE) AS cy FROM u)
SELECT id, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY round_even(cx, 0), round_even(cy, 0) ORDER BY id) AS r FROM p) WHERE r = 1 ORDER BY id LIMIT 100"""


@query(f"SELECT id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM ({_centers_sql(1, 1, 4096, 4096)})")
def m11_sample_query_centers(spark, d):
    return _rounded(L.sample_points(spark, 100, (4096, 4096), (336, 336), 42))


@query(f"SELECT id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM ({_centers_sql(8, 8, 512, 512)})")
def m11_sample_inside_tiles(spark, d):
    """Each query inside one tile."""
    return _rounded(L.sample_points(spark, 100, (4096, 4096), (336, 336), 42, tile=(512, 512)))


def _rounded(p):
    return p.select("id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query()
def x14_pipeline_mains(spark, d):
    """A whole run over the small grids: vectors, search, re-ranking, offsets, metrics."""
    from tessella.config import PipelineConfig
    from tessella.plans.pipeline import retrieve

    p = X.patches(spark, d)
    gt = pairs(spark, d).select(F.col("query_idx").alias("query_id"), F.col("tile_idx").alias("gt"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    config = PipelineConfig(aggregation="gap", top_k_vals=(1, 5), coarse_top_k=5, top_m=8)
    return retrieve(p.where("image_idx % 4 = 0"), p.where("image_idx % 4 <> 0"), gt, config, (5, 5)).metrics


@query()
def x14_segment_run(spark, d):
    """A whole run by segments: residual vectors with position encodings, weighted votes, re-ranking, offsets, metrics."""
    from tessella.config import PipelineConfig
    from tessella.plans.pipeline import retrieve_segments

    p, m = X.patches(spark, d), X.segments(spark, d).select("image_idx", "seg", "p")
    gt = pairs(spark, d).select(F.col("query_idx").alias("query_id"), F.col("tile_idx").alias("gt"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    config = PipelineConfig(aggregation="vlad", top_k_vals=(1, 5), coarse_top_k=5, top_m=8, segment_top_k=10, vote="revisit_weighted_borda_image", centroid_weight=0.2, context_weight=0.1)
    return retrieve_segments(p.where("image_idx % 4 = 0"), p.where("image_idx % 4 <> 0"), m, m, gt, config, (5, 5), centers=X.centers(spark, d)).metrics


@query()
def x01_extractor_interface(spark, d):
    """The plug-in without a network, over made-up pixels."""
    from tessella.models import extract

    images = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_idx"), F.lit(28).alias("height"), F.lit(42).alias("width"), F.lit(3).alias("channels"), F.encode(F.rpad(F.repeat("s_name", 300), 28 * 42 * 3, "x"), "utf-8").alias("pixels"))
    return extract(images, "patch_stats").select("image_idx", "p", "row", "col", F.size("desc").alias("dims"))
