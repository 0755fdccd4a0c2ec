"""Sources, projections, joins of truth, and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessella.functions import paths as N
from tessella.operators import evaluation as E
from tessella.operators import joins as J
from tessella.operators import retrieval as R
from tessella.operators import segments as S
from tessella.plans import fixtures as X
from tessella.plans.fixtures import with_views
from tessella.queries.registry import doubles, query
from tessella.queries.search import lowest_positive, ranking
from tessella.sinks import tables as W
from tessella.sources import files as FS
from tessella.sources import manifests as M
from tessella.stages import fresh, stored


def manifest_text(spark, d, wrapper=None):
    """A manifest made of the suppliers: odd ones without an id, centres in three spellings."""
    s = X.table(spark, d, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    center = F.when(k % 3 == 0, F.to_json(F.struct(n.alias("x"), k.alias("y")))).when(k % 3 == 1, F.to_json(F.struct(n.alias("dx"), k.alias("dy")))).otherwise(F.concat(F.lit("["), n, F.lit(","), k, F.lit("]")))
    item = F.concat(F.lit('{"image":"img/'), k, F.lit('.png","center":'), F.when(k % 7 == 0, F.lit("null")).otherwise(center), F.when(k % 2 == 0, F.concat(F.lit(',"tile_id":"t'), k, F.lit('"'))).otherwise(F.lit("")), F.lit(',"positives":["t2","t'), k, F.lit('"]}'))
    text = s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, item.alias("j")))), lambda x: x["j"]), ",").alias("j"))
    return text.select((F.concat(F.lit(f'{{"{wrapper}":['), "j", F.lit("]}")) if wrapper else F.concat(F.lit("["), "j", F.lit("]"))).alias("json"))


_SUP = "WITH s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier)"


@query(f"{_SUP} SELECT pos, 'img/' || s_suppkey || '.png' AS image FROM s")
def s01_scan_manifest(spark, d):
    return M.manifest_entries(manifest_text(spark, d, "tiles")).select("pos", M.get(F.col("entry"), "image").alias("image"))


@query(f"{_SUP} SELECT pos AS tile_idx, CASE WHEN s_suppkey % 2 = 0 THEN 't' || s_suppkey ELSE 'tile_' || lpad(CAST(pos AS VARCHAR), 6, '0') END AS tile_id, 't2' AS gt_tile_id, 'query_' || lpad(CAST(pos AS VARCHAR), 6, '0') AS query_id FROM s")
def s02_load_tiles_queries(spark, d):
    e = M.manifest_entries(manifest_text(spark, d))
    return M.tiles_of(e).select("tile_idx", "tile_id").join(M.queries_of(e).select(F.col("query_idx").alias("tile_idx"), "gt_tile_id", "query_id"), "tile_idx")


@query(f"{_SUP} SELECT pos, CAST(CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey END AS DOUBLE) AS x, CAST(CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey END AS DOUBLE) AS y FROM s")
def s03_coerce_xy(spark, d):
    e = M.manifest_entries(manifest_text(spark, d, "data"))
    x, y = M.coerce_xy(F.try_variant_get("entry", "$.center", "variant"))
    return e.select("pos", x.alias("x"), y.alias("y"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '/abs/' || s_name ELSE '/data/root/' || s_name END AS path FROM supplier")
def s04_resolve_paths(spark, d):
    s = X.table(spark, d, "supplier")
    path = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/abs/"), "s_name")).otherwise(F.col("s_name"))
    return s.select("s_suppkey", N.resolve_path(path, "/data/root/").alias("path"))


@query("SELECT s_suppkey, '/data/root/m/' || s_name AS image, '/data/root/masks/' || s_name AS mask_path, '/abs/' || s_name AS masks_path, 'x/' || s_name AS other FROM supplier")
def s04_resolve_metadata(spark, d):
    """Real paths, also of the metadata's mask paths; other values stay."""
    s = X.table(spark, d, "supplier")
    below = lambda prefix: F.concat(F.lit(prefix), "s_name")
    meta = N.resolve_metadata(F.create_map(F.lit("mask_path"), below("a/../masks/./"), F.lit("masks_path"), below("/abs/"), F.lit("other"), below("x/")), "/data/root")
    image = N.real_path(N.resolve_path(below("./m//"), "/data/root/"))
    return s.select("s_suppkey", image.alias("image"), *[meta[k].alias(k) for k in ("mask_path", "masks_path", "other")])


def utm_paths(spark, d):
    return X.table(spark, d, "part").select("p_partkey", F.concat(F.lit("/img/@"), "p_retailprice", F.lit("@"), "p_size", F.lit("@"), "p_partkey", F.lit("@.jpg")).alias("path"))


@query("SELECT p_partkey, p_retailprice AS easting, CAST(p_size AS DOUBLE) AS northing FROM part")
def s07_parse_utm_from_path(spark, d):
    e, n = N.utm_from_path(F.col("path"))
    return utm_paths(spark, d).select("p_partkey", e.alias("easting"), n.alias("northing"))


@query("SELECT o.o_custkey // 2 AS query_idx, (o.o_orderkey % 500) // 5 AS db_idx FROM orders o WHERE o.o_custkey % 2 = 0 AND (o.o_orderkey % 500) % 5 = 0")
def s08_load_gt_lists(spark, d):
    """Truth by file number, for every other query file and every fifth database file."""
    truth = X.table(spark, d, "orders").select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 500).alias("positive"))
    q = truth.select("query").distinct().where("query % 2 = 0").withColumn("idx", F.expr("query div 2"))
    p = truth.select("positive").distinct().where("positive % 5 = 0").withColumn("idx", F.expr("positive div 5"))
    return M.remap_truth(truth, q, p)


@query(doubles("SELECT s_name AS name, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y, CAST(s_suppkey AS DOUBLE) AS z, round(s_nationkey * 5.0, 6) + 0.0 AS yaw, 0.0 AS pitch, 0.0 AS roll FROM supplier", "yaw", "pitch", "roll"))
def s09_parse_camera_pose(spark, d):
    s = X.table(spark, d, "supplier")
    a = F.radians(F.col("s_nationkey") * 5.0)
    row = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    text = F.concat_ws("\n", F.lit("h1"), F.lit("h2"), F.lit("h3"), row(F.cos(a), -F.sin(a), F.lit(0.0)), row(F.sin(a), F.cos(a), F.lit(0.0)), F.lit("0 0 1"), row(F.col("s_acctbal"), F.col("s_nationkey"), F.col("s_suppkey")), F.lit("end"))
    p = M.camera_pose(s.select(F.col("s_name").alias("name"), text.alias("text")))
    return p.select("name", "x", "y", "z", *[(F.round(c, 6) + 0.0).alias(c) for c in ("yaw", "pitch", "roll")])


@query("SELECT p_partkey AS query_ind, CAST(i AS BIGINT) AS rank, (p_partkey * i) % 97 AS ref FROM part, (SELECT unnest(range(1, 6)) AS i)")
def s11_unpivot_gt_csv(spark, d):
    wide = X.table(spark, d, "part").select(F.col("p_partkey").alias("query_ind"), *[((F.col("p_partkey") * i) % 97).alias(f"top_{i}_ref_ind") for i in range(1, 6)])
    return M.unpivot_truth(wide)


@query("SELECT o_orderkey - 101 AS query_idx, o_custkey + i AS db_idx FROM orders, (SELECT unnest(range(0, 3)) AS i) WHERE o_orderkey >= 101")
def s12_gt_object_array(spark, d):
    t = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.expr("array(o_custkey, o_custkey + 1, o_custkey + 2)").alias("positives"))
    return M.truth_rows(t, 101)


@query("SELECT 'db' AS role, vec_id AS i, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE vec_id < 76 UNION ALL SELECT 'query', vec_id - 76, CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE) FROM embeddings WHERE vec_id >= 76 AND vec_id < 151")
def s13_pose_slice(spark, d):
    poses = X.vectors(spark, d).select(F.col("vec_id").alias("idx"), F.col("e")[0].alias("x"), F.col("e")[1].alias("y"))
    return M.pose_slice(poses, (0, 76), (76, 151))


@query("SELECT s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y, CAST(s_suppkey AS DOUBLE) AS z FROM supplier")
def s14_parse_pose_text(spark, d):
    s = X.table(spark, d, "supplier")
    return M.pose_lines(s.select(F.concat_ws("  ", "s_name", "s_acctbal", "s_nationkey", "s_suppkey").alias("value")).select(F.regexp_replace("value", "Supplier#", "S").alias("value")))


@query("SELECT 'train' AS split, c_mktsegment AS view, CAST(c_nationkey AS VARCHAR) AS class_id, replace('train_' || c_mktsegment || '_' || c_nationkey || '_' || replace(c_name, '#', ' '), ' ', '_') AS name, count(*) AS n FROM customer GROUP BY ALL")
def s16_scan_labeled_tree(spark, d):
    path = F.concat(F.lit("root/train/"), "c_mktsegment", F.lit("/"), "c_nationkey", F.lit("/"), F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(".jpg"))
    return M.labeled_names(X.table(spark, d, "customer").select(path.alias("path"))).groupBy("split", "view", "class_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS dims FROM embeddings")
def s18_load_descriptors(spark, d):
    return M.load_descriptors(X.vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("e").alias("desc"))).agg(F.count("desc").alias("n"), F.max(F.size("desc")).cast("long").alias("dims"))


_RJ = with_views("ranking")


@query(f"{_RJ} SELECT query_id // 10 AS query_row, CAST(rank AS BIGINT) AS rank, db_id AS pos FROM ranking")
def s19_scan_result_json(spark, d):
    """The rankings of a saved run, from its JSON."""
    each = ranking(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "db_id"))), lambda x: x["db_id"]).alias("ids"))
    doc = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "ids"))), lambda x: x["ids"]).alias("r"))
    text = doc.select(F.concat(F.lit('{"Coarse-Indices": [[0]], "Final-Indices": '), F.to_json("r"), F.lit("}")).alias("json"))
    return M.rankings_of(text)


@query("SELECT s_name AS image, CAST(0 AS BIGINT) AS seg, CAST(s_suppkey % 3 AS BIGINT) AS row, CAST(s_nationkey % 4 AS BIGINT) AS col FROM supplier")
def s05_scan_masks(spark, d):
    """A JSON file for each supplier, with one mask of one set cell."""
    cell = lambda r, c: F.when((F.col("s_suppkey") % 3 == r) & (F.col("s_nationkey") % 4 == c), F.lit("1")).otherwise(F.lit("0"))
    grid = F.concat_ws(",", *[F.concat(F.lit("["), F.concat_ws(",", *[cell(r, c) for c in range(4)]), F.lit("]")) for r in range(3)])
    text = F.concat(F.lit('{"masks": [{"segmentation": ['), grid, F.lit("]}]}"))
    return FS.parse_masks(X.table(spark, d, "supplier").select(F.concat(F.lit("/m/"), "s_name", F.lit(".json")).alias("path"), F.encode(text, "utf-8").alias("content")))


@query("SELECT s_name AS path, CAST(2 AS INTEGER) AS height, CAST(2 AS INTEGER) AS width, round((97 / 255.0 - 0.485) / 0.229, 6) AS r, round((98 / 255.0 - 0.456) / 0.224, 6) AS g, round((99 / 255.0 - 0.406) / 0.225, 6) AS b FROM supplier")
def s20_decode_image(spark, d):
    """Made-up pixels of one colour; files go through decode_images."""
    data = F.encode(F.repeat(F.lit("cba"), 4), "utf-8")  # blue, green, red
    images = X.table(spark, d, "supplier").select(F.col("s_name").alias("origin"), F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    return FS.normalized_pixels(images).select("path", "height", "width", *[F.round(c, 6).alias(c) for c in "rgb"])


@query("SELECT s_name AS path, CAST(t.h AS INTEGER) AS height, CAST(t.w AS INTEGER) AS width, t.transform, t.n AS crops FROM supplier, (VALUES ('none', 6, 9, 1), ('hard_resize', 4, 4, 1), ('shorter_side', 4, 6, 1), ('central_crop', 4, 4, 1), ('five_crops', 4, 4, 5)) t(transform, h, w, n)")
def s20_transforms(spark, d):
    """Sizes of what each transform to 4 by 4 makes of images of 6 by 9."""
    images = X.table(spark, d, "supplier").select(F.col("s_name").alias("origin"), F.lit(6).alias("height"), F.lit(9).alias("width"), F.lit(3).alias("nChannels"), F.encode(F.repeat(F.lit("cba"), 54), "utf-8").alias("data"))
    each = [FS.normalized_images(images, t, (4, 4)).groupBy("path", "height", "width").agg(F.count(F.lit(1)).alias("n")).select("path", "height", "width", F.lit(t).alias("transform"), F.col("n").cast("int").alias("crops")) for t in FS.TRANSFORMS]
    return reduce(lambda a, b: a.unionByName(b), each)


@query("SELECT s_name AS path, s_suppkey AS idx, CAST(2 AS INTEGER) AS height FROM supplier")
def s22_image_loader_thin(spark, d):
    """A listing's images, decoded, under their index."""
    s = X.table(spark, d, "supplier")
    images = s.select(F.col("s_name").alias("origin"), F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(3).alias("nChannels"), F.encode(F.repeat(F.lit("cba"), 4), "utf-8").alias("data"))
    return FS.indexed_images(s.select(F.col("s_name").alias("path"), F.col("s_suppkey").alias("idx")), FS.normalized_pixels(images)).select("path", "idx", "height")


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN '/x/queries/im' ELSE '/x/database/im' END || s_suppkey || '.jpg' AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'query' ELSE 'db' END AS role, row_number() OVER (PARTITION BY s_suppkey % 3 = 0 ORDER BY s_suppkey) - 1 AS idx FROM supplier")
def s06_scan_image_folder(spark, d):
    paths = X.table(spark, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "/x/queries/").otherwise("/x/database/"), F.lit("im"), "s_suppkey", F.lit(".jpg")).alias("path"))
    return FS.image_folder(paths)


@query("SELECT s_name AS path, 'db' AS role FROM supplier UNION ALL SELECT n_name, 'db' FROM nation")
def s15_scan_distractors(spark, d):
    tiles = X.table(spark, d, "supplier").select(F.col("s_name").alias("path"), F.lit("db").alias("role"))
    return FS.with_distractors(tiles, X.table(spark, d, "nation").select(F.col("n_name").alias("path")))


@query("SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS file")
def s17_list_feature_files(spark, d):
    """The files of the test tables' folder itself (a table may also be a folder)."""
    name = F.regexp_extract("path", r"([^/]+\.parquet)(/[^/]*)?$", 1)
    return FS.list_files(spark, d, (".parquet",)).select(name.alias("file")).distinct()


@query("SELECT s_name AS image, CASE WHEN s_suppkey % 2 = 0 THEN 'manifest' WHEN s_suppkey % 3 = 0 THEN 'cache' ELSE 'none' END AS source FROM supplier")
def s23_mask_source_policy(spark, d):
    i = X.table(spark, d, "supplier").select(F.col("s_name").alias("image"), "s_suppkey")
    return FS.choose_masks(i, i.where("s_suppkey % 2 = 0"), i.where("s_suppkey % 3 = 0"))


@query("SELECT s_name AS image, CASE WHEN s_suppkey % 2 = 0 THEN 'manifest' WHEN s_suppkey % 3 = 0 THEN 'cache' ELSE 'generated' END AS source FROM supplier")
def s23_mask_source_generated(spark, d):
    i = X.table(spark, d, "supplier").select(F.col("s_name").alias("image"), "s_suppkey")
    return FS.choose_masks(i, i.where("s_suppkey % 2 = 0"), i.where("s_suppkey % 3 = 0"), "generate", generator=True)


@query(f"{with_views('patches')} SELECT image_idx, p FROM patches WHERE image_idx % 3 = 0 AND p % 4 = 0")
def p01_subsample_stride(spark, d):
    return X.patches(spark, d).where("image_idx % 3 = 0 and p % 4 = 0").select("image_idx", "p")


@query("SELECT page_id, array_to_string(list_slice(string_split(url, '/'), -2, -1), '/') AS rel FROM pages")
def p02_relpath_suffix(spark, d):
    return X.table(spark, d, "pages").select("page_id", N.relpath_suffix(F.col("url"), 2).alias("rel"))


@query(f"{with_views('vectors')} SELECT vec_id, i - 1 AS pos, round(e[21 + i], 6) + 0.0 AS x FROM vectors, (SELECT unnest(range(1, 22)) AS i) WHERE vec_id % 25 > 0")
def p03_facet_slice(spark, d):
    """The key facet (second third) of the patch tokens; token 0 is left out."""
    v = X.vectors(spark, d).where("vec_id % 25 > 0").select("vec_id", F.posexplode(F.slice("e", 1 + 21, 21)).alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@query(f"{with_views('segments')}, m AS (SELECT * FROM segments WHERE image_idx % 2 = 0 OR p % 7 = 0), ok AS (SELECT image_idx, seg FROM m GROUP BY 1, 2 HAVING count(*) / 25.0 >= 0.2), i AS (SELECT DISTINCT image_idx FROM segments) SELECT image_idx, seg, p FROM m JOIN ok USING (image_idx, seg) UNION ALL SELECT image_idx, 0, p FROM i, (SELECT unnest(range(0, 25)) AS p) WHERE image_idx NOT IN (SELECT image_idx FROM ok)")
def p04_min_area_filter(spark, d):
    s = X.segments(spark, d)
    m = s.where("image_idx % 2 = 0 or p % 7 = 0").select("image_idx", "seg", "p")
    return S.min_area(m, s.select("image_idx").distinct(), 25, 0.2)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.02 AND l_tax >= 0.04 AND l_quantity > 10")
def p05_quality_filters(spark, d):
    """Predicted IoU above, stability at or above, area above a bound."""
    return X.table(spark, d, "lineitem").where((F.col("l_discount") > 0.02) & (F.col("l_tax") >= 0.04) & (F.col("l_quantity") > 10)).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'fire') THEN 'wildfire' WHEN contains(lower(text), 'tornado') THEN 'tornado' WHEN contains(lower(text), 'quake') THEN 'earthquake' END AS class FROM documents")
def p06_keyword_class(spark, d):
    return X.table(spark, d, "documents").select("doc_id", N.keyword_class(F.col("text"), N.DISASTERS).alias("class"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END, 'default') AS value FROM orders")
def p07_coalesce_config(spark, d):
    o = F.col("o_orderkey")
    return X.table(spark, d, "orders").select("o_orderkey", F.coalesce(F.when(o % 3 == 0, F.col("o_orderpriority")), F.when(o % 3 == 1, F.col("o_orderstatus")), F.lit("default")).alias("value"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_nationkey AS INTEGER) END AS r, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 10 AS INTEGER) END AS c FROM supplier")
def p08_parse_row_col(spark, d):
    name = F.when(F.col("s_suppkey") % 4 == 0, "plain.png").otherwise(F.concat(F.lit("tile_r"), "s_nationkey", F.lit("_c"), F.col("s_suppkey") % 10, F.lit(".png")))
    r, c = N.parse_row_col(name)
    return X.table(spark, d, "supplier").select("s_suppkey", r.alias("r"), c.alias("c"))


@query(f"{with_views('query_geo')} SELECT count(*) AS n, bool_or(dx IS NOT NULL) AS has_offset, bool_or(x IS NOT NULL) AS has_coord FROM query_geo")
def p09_accessors(spark, d):
    return X.query_geo(spark, d).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("dx").isNotNull()).alias("has_offset"), F.bool_or(F.col("x").isNotNull()).alias("has_coord"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS h, CAST(p_partkey % 90 AS INTEGER) AS w FROM part")
def p10_size_parse(spark, d):
    h, w = N.parse_size(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_size", F.lit("X"), F.col("p_partkey") % 90)).otherwise(F.concat("p_size", F.lit(", "), F.col("p_partkey") % 90)))
    return X.table(spark, d, "part").select("p_partkey", h.alias("h"), w.alias("w"))


@query("SELECT p_partkey, true AS ok FROM part")
def p10_size_checks(spark, d):
    """Sizes that are as expected and divide the canvas; others are errors."""
    h, w = N.parse_size(F.concat(F.lit("512x"), F.when(F.col("p_partkey") % 2 == 0, 512).otherwise(256)))
    return X.table(spark, d, "part").select("p_partkey", N.checked_size(h, w, parts_of=(4096, 4096)).alias("ok"))


_PTS = "WITH pt AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z, CAST(embedding[4] AS DOUBLE) * 100 AS u, CAST(embedding[5] AS DOUBLE) * 100 AS v, CAST(embedding[6] AS DOUBLE) * 100 AS w FROM embeddings)"


def points(spark, d):
    return X.vectors(spark, d).select("vec_id", *[(F.col("e")[i] * 100).alias(c) for i, c in enumerate("xyzuvw")])


def _renamed(p, name):
    return p.withColumnRenamed("vec_id", name)


def _sides(p):
    """Queries (every tenth) and database (all others)."""
    return _renamed(p.where("vec_id % 10 = 0"), "query_id"), _renamed(p.where("vec_id % 10 <> 0"), "db_id")


@query(f"{_PTS} SELECT a.vec_id AS query_id, b.vec_id AS db_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS dist FROM pt a JOIN pt b ON a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 25.0")
def j03_radius_join(spark, d):
    p = points(spark, d)
    return J.radius_join(*_sides(p), 5.0, ["x", "y"], "query_id", "db_id").withColumn("dist", F.round("dist", 6))


@query(f"{_PTS} SELECT a.vec_id AS query_id, b.vec_id AS db_id FROM pt a JOIN pt b ON a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 100.0 WHERE (abs(a.u - b.u) + abs(a.v - b.v) + abs(a.w - b.w)) / 3 < 12")
def j04_radius_angle_join(spark, d):
    p = points(spark, d)
    near = J.radius_join(*_sides(p), 10.0, ["x", "y", "z"], "query_id", "db_id")
    a = p.select(F.col("vec_id").alias("query_id"), F.col("u").alias("au"), F.col("v").alias("av"), F.col("w").alias("aw"))
    b = p.select(F.col("vec_id").alias("db_id"), "u", "v", "w")
    return J.angle_filter(near.join(a, "query_id").join(b, "db_id"), ["au", "av", "aw"], ["u", "v", "w"], 12).select("query_id", "db_id")


@query(f"{_PTS} SELECT a.vec_id AS a, b.vec_id AS b FROM pt a JOIN pt b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4.0")
def j05_radius_self_join(spark, d):
    p = points(spark, d)
    return J.radius_join(_renamed(p, "a"), _renamed(p, "b"), 2.0, ["x", "y"], "a", "b").select("a", "b")


_PJ = "WITH t AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS tile_idx, s_suppkey FROM supplier), q AS (SELECT c_custkey AS query_idx, c_custkey % (SELECT count(*) FROM supplier) AS g FROM customer), p AS (SELECT query_idx, tile_idx FROM q JOIN t ON tile_idx = g UNION SELECT query_idx, tile_idx FROM q JOIN t ON s_suppkey IN (query_idx % 13, query_idx % 29))"


def _truth(spark, d):
    tiles = M.with_index(X.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "tile_idx").select("tile_idx", F.concat(F.lit("t"), "s_suppkey").alias("tile_id"), "s_suppkey")
    n = tiles.count()
    first = tiles.select(F.col("tile_idx").alias("g"), F.col("tile_id").alias("gt_tile_id"))
    q = X.table(spark, d, "customer").select(F.col("c_custkey").alias("query_idx"), (F.col("c_custkey") % n).alias("g"), F.array(F.concat(F.lit("t"), F.col("c_custkey") % 13), F.concat(F.lit("t"), F.col("c_custkey") % 29)).alias("candidates"))
    return q.join(first, "g"), tiles.select("tile_idx", "tile_id")


@query(f"{_PJ} SELECT * FROM p")
def j06_positives_join(spark, d):
    return J.positives_join(*_truth(spark, d))


@query(f"{_PJ} SELECT query_idx, count(*) AS n, min(tile_idx) AS gt FROM p GROUP BY 1")
def u02_distinct_positives(spark, d):
    p = J.positives_join(*_truth(spark, d)).groupBy("query_idx").agg(F.array_sort(F.collect_set("tile_idx")).alias("p"))
    return p.select("query_idx", F.size("p").cast("long").alias("n"), F.col("p")[0].alias("gt"))


@query(f"{_PJ} SELECT query_idx, min(CASE WHEN tile_idx % 2 = 0 THEN tile_idx // 2 END) AS gt FROM p GROUP BY 1")
def j10_gt_to_bank_join(spark, d):
    q, t = _truth(spark, d)
    return J.gt_to_bank(J.positives_join(q, t), t.where("tile_idx % 2 = 0").select("tile_idx", F.expr("tile_idx div 2").alias("pos")))


@query(f"{_RJ} SELECT query_id, CAST(rank AS BIGINT) AS rank, CASE WHEN db_id % 3 = 0 THEN db_id + 1000 ELSE db_id END AS tile_idx FROM ranking")
def j07_ranking_backmap(spark, d):
    r = ranking(spark, d).select("query_id", "rank", F.col("db_id").alias("pos"))
    bank = X.vectors(spark, d).select(F.col("vec_id").alias("pos"), F.concat(F.lit("im/"), "vec_id").alias("relpath"))
    man = X.vectors(spark, d).where("vec_id % 3 = 0").select(F.concat(F.lit("im/"), "vec_id").alias("relpath"), (F.col("vec_id") + 1000).alias("tile_idx"))
    return J.ranking_back(r, bank, man)


@query("SELECT query_row, CAST(CASE query_row % 3 WHEN 2 THEN query_row ELSE query_row * 2 END AS BIGINT) AS query_idx FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS query_row FROM supplier)")
def j07_queries_back(spark, d):
    """Queries of a saved run in the manifest: by path, by file name, or by their place."""
    row = M.with_index(X.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "query_row").select("query_row")
    manifest = row.select((F.col("query_row") * 2).alias("query_idx"), F.concat(F.lit("q/im"), "query_row", F.lit(".png")).alias("relpath"))
    i = F.col("query_row")
    told = F.when(i % 3 == 0, F.concat(F.lit("./q\\im"), i, F.lit(".png"))).when(i % 3 == 1, F.concat(F.lit("elsewhere/im"), i, F.lit(".png")))
    return J.queries_back(row.select("query_row", told.alias("relpath")), manifest)


@query("SELECT c_custkey AS query_id, CAST(c_nationkey AS BIGINT) AS class_id, count(s_suppkey) AS n, min(s_suppkey) AS gt FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1, 2")
def j08_class_join(spark, d):
    q = X.table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").cast("long").alias("class_id"))
    t = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile_id"), F.col("s_nationkey").cast("long").alias("class_id"), F.col("s_suppkey").alias("pos"))
    return J.class_truth(q, t)


@query("SELECT c_custkey AS query_id, CAST(c_nationkey AS BIGINT) AS class_id, s_suppkey AS tile_id FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey")
def j08_class_pairs(spark, d):
    q = X.table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").cast("long").alias("class_id"))
    return J.class_join(q, X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile_id"), F.col("s_nationkey").cast("long").alias("class_id")))


@query("""WITH RECURSIVE sat AS (SELECT s_suppkey AS sat_id, CAST(s_nationkey AS BIGINT) AS class_id, s_suppkey % 3 AS view, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
uav AS (SELECT c_custkey AS uav_id, CAST(c_nationkey AS BIGINT) AS class_id, c_custkey % 3 AS view FROM customer),
run AS (SELECT class_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS sat_id, CAST(NULL AS BIGINT) AS uav_id FROM (SELECT DISTINCT class_id FROM sat)
UNION ALL SELECT class_id, i, list_append(used, uav_id), sat_id, uav_id FROM (SELECT r.class_id, s.i, r.used, s.sat_id, coalesce(min(CASE WHEN u.view = s.view THEN u.uav_id END), min(u.uav_id)) AS uav_id FROM run r JOIN sat s ON s.class_id = r.class_id AND s.i = r.i + 1 LEFT JOIN uav u ON u.class_id = s.class_id AND NOT list_contains(r.used, u.uav_id) GROUP BY 1, 2, 3, 4))
SELECT sat_id, class_id, uav_id FROM run WHERE i > 0""")
def j09_greedy_one_to_one(spark, d):
    sat = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("sat_id"), F.col("s_nationkey").cast("long").alias("class_id"), (F.col("s_suppkey") % 3).alias("view"))
    uav = X.table(spark, d, "customer").select(F.col("c_custkey").alias("uav_id"), F.col("c_nationkey").cast("long").alias("class_id"), (F.col("c_custkey") % 3).alias("view"))
    return J.one_to_one(sat, uav)


@query(f"""{_PTS}, b AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM pt WHERE vec_id % 10 <> 0),
drawn AS (SELECT DISTINCT q.vec_id AS query_id, q.x, q.y, CAST('0x' || substr(sha1('5:' || q.vec_id || ':' || i), 1, 12) AS BIGINT) % (SELECT max(n) FROM b) AS pos FROM pt q, (SELECT unnest(range(0, 40)) AS i) WHERE q.vec_id % 10 = 0)
SELECT query_id, vec_id AS db_id FROM drawn JOIN b USING (pos) WHERE NOT ((drawn.x - b.x) ** 2 + (drawn.y - b.y) ** 2 <= 25.0)""")
def j11_negatives_anti_join(spark, d):
    """Forty seeded draws from the database for each query, without its positives."""
    q, b = _sides(points(spark, d))
    pos = J.radius_join(q, b, 5.0, ["x", "y"], "query_id", "db_id").select("query_id", "db_id")
    return J.sampled_negatives(q.select("query_id"), b.select("db_id"), pos, 40, 5)


@query(doubles(f"{_RJ} SELECT query_id, db_id, 512.0 AS ew, CASE WHEN db_id % 5 = 0 THEN 0.0 ELSE (db_id % 8 + 0.5) * 512 END AS cx FROM ranking WHERE rank = 1", "ew", "cx"))
def j14_top1_attribute_join(spark, d):
    """Extent and centre of the first tile; every fifth has none and takes the given defaults."""
    attr = X.vectors(spark, d).where("vec_id % 5 <> 0").select(F.col("vec_id").alias("db_id"), F.lit(512.0).alias("ew"), ((F.col("vec_id") % 8 + 0.5) * 512).cast("double").alias("cx"))
    return ranking(spark, d, 1).join(attr, "db_id", "left").select("query_id", "db_id", F.coalesce("ew", F.lit(512.0)).alias("ew"), F.coalesce("cx", F.lit(0.0)).alias("cx"))


@query("SELECT s_suppkey AS idx, 'db' AS role, s_name AS name FROM supplier UNION ALL SELECT c_custkey + (SELECT count(*) FROM supplier), 'query', c_name FROM customer")
def u01_db_then_queries(spark, d):
    s, c = X.table(spark, d, "supplier"), X.table(spark, d, "customer")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    q = c.join(F.broadcast(n), F.lit(True)).select((F.col("c_custkey") + F.col("n")).alias("idx"), F.lit("query").alias("role"), F.col("c_name").alias("name"))  # one row
    return s.select(F.col("s_suppkey").alias("idx"), F.lit("db").alias("role"), F.col("s_name").alias("name")).unionByName(q)


@query("SELECT s_nationkey AS key FROM supplier UNION SELECT c_nationkey FROM customer")
def u03_union_distinct(spark, d):
    return X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).union(X.table(spark, d, "customer").select("c_nationkey")).distinct()


@query("SELECT DISTINCT c_nationkey AS key FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)")
def u04_set_difference(spark, d):
    s = X.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("key"))
    return X.table(spark, d, "customer").select(F.col("c_nationkey").alias("key")).subtract(s)


@query("SELECT label % 2 AS part, count(*) AS n FROM embeddings GROUP BY 1")
def u05_concat_descriptors(spark, d):
    v = X.vectors(spark, d)
    return v.where("label % 2 = 0").unionByName(v.where("label % 2 = 1")).groupBy((F.col("label") % 2).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT c_nationkey AS missing FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def u06_missing_classes(spark, d):
    s = X.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("class_id"))
    return J.missing_classes(X.table(spark, d, "customer").select(F.col("c_nationkey").alias("class_id")), s).withColumnRenamed("class_id", "missing")


@query("SELECT DISTINCT event_type AS label, 'run_' || user_id % 7 AS path FROM events")
def u07_spec_dedup(spark, d):
    return X.table(spark, d, "events").select(F.col("event_type").alias("label"), F.concat(F.lit("run_"), F.col("user_id") % 7).alias("path")).dropDuplicates(["path", "label"])


@query(f"{with_views('boxes')} SELECT grp, box_id, score FROM boxes WHERE score > 50000 UNION ALL SELECT grp, box_id, score FROM boxes WHERE box_id % 7 = 0")
def u08_batch_filter_cat(spark, d):
    b = X.boxes(spark, d).select("grp", "box_id", "score")
    return b.where("score > 50000").unionByName(b.where("box_id % 7 = 0"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS pos FROM part")
def t05_natural_sort(spark, d):
    """Places in natural order: im2_10 comes before im10_2."""
    named = X.table(spark, d, "part").select("p_partkey", N.natural_key(F.concat(F.lit("im"), "p_size", F.lit("_"), "p_partkey", F.lit(".jpg"))).alias("key"))
    return M.with_index(named, "key", "pos").select("p_partkey", "pos")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 7")
def t07_limit_scan(spark, d):
    return X.table(spark, d, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey").limit(7)


@query("SELECT s_suppkey, substr(sha1('root::test::' || s_name || '::q.json'), 1, 12) AS id FROM supplier")
def v15_sha1_cache_id(spark, d):
    return X.table(spark, d, "supplier").select("s_suppkey", N.cache_id(F.lit("root"), F.lit("test"), F.col("s_name"), F.lit("q.json")).alias("id"))


@query("SELECT page_id, replace(url, '/', '__') || '__' || substr(sha1(url), 1, 16) || '.npz' AS name, url AS back, page_id % 5 AS row, page_id % 7 AS col FROM pages")
def k03_write_masks(spark, d):
    """Masks written under their cache names and read back, with the path that each name tells."""
    path = fresh(spark, "masks")
    masks = X.table(spark, d, "pages").select("page_id", N.mask_cache_name(F.col("url")).alias("name"), (F.col("page_id") % 5).alias("row"), (F.col("page_id") % 7).alias("col"))
    W.write_masks(masks, path)
    got = spark.read.option("header", True).schema(masks.schema).csv(path)
    return got.withColumn("back", N.mask_cache_path(F.col("name")))


@query(f"{_RJ}, pos AS (SELECT query_id, db_id FROM vec_query JOIN vec_db ON q_label = label), gt AS (SELECT query_id, min(db_id) AS gt FROM pos GROUP BY 1) SELECT 'Coarse-R@' || k AS name, round(avg(CASE WHEN EXISTS (SELECT 1 FROM ranking r WHERE r.query_id = gt.query_id AND r.db_id = gt.gt AND r.rank <= k) THEN 1.0 ELSE 0.0 END), 6) AS value FROM gt, (SELECT unnest([1, 5, 10]) AS k) GROUP BY k")
def k04_write_run_result(spark, d):
    """Metrics of a run, written with its configuration and ranking and read back from the JSON."""
    r, path = stored(ranking(spark, d), "ranking"), fresh(spark, "run")
    rows = E.recall_at_k(r, lowest_positive(spark, d), [1, 5, 10]).collect()  # three rows
    W.write_run({"k": 20}, {f"Coarse-R@{x['k']}": x["recall"] for x in rows}, r, path)
    result, _ = W.read_run(spark, path)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in result.items() if k != "Run-Config"], "name string, value double")


@query(f"{_RJ} SELECT query_id, CAST(rank AS BIGINT) AS rank, db_id, round(sim, 6) + 0.0 AS sim FROM ranking")
def k04_read_ranking(spark, d):
    """The ranking of a written run, from its nested JSON."""
    path = fresh(spark, "run")
    W.write_run({}, {}, stored(ranking(spark, d), "ranking"), path)
    nested = spark.read.schema("query_id long, results array<struct<rank: long, db_id: long, sim: double>>").json(f"{path}/ranking_json")
    return nested.select("query_id", F.explode("results").alias("r")).select("query_id", "r.rank", "r.db_id", (F.round("r.sim", 6) + 0.0).alias("sim"))


@query("SELECT s_suppkey AS image_id, 'tile_r' || lpad(CAST(r AS VARCHAR), 2, '0') || '_c' || lpad(CAST(c AS VARCHAR), 2, '0') AS tile_id, c * 14 AS x0, r * 14 AS y0, (c + 1) * 14 AS x1, (r + 1) * 14 AS y1, CAST(c * 14 + 7 AS DOUBLE) AS cx, CAST(r * 14 + 7 AS DOUBLE) AS cy, chr(CAST(97 + s_suppkey % 26 AS INTEGER)) AS pixel, 588 AS n FROM supplier, (SELECT unnest(range(0, 2)) AS r), (SELECT unnest(range(0, 3)) AS c)")
def k08_write_tiles(spark, d):
    """Tiles cut from made-up images, written, and read back beside their manifest."""
    path = fresh(spark, "tiles")
    pixel = F.chr((97 + F.col("s_suppkey") % 26).cast("int"))
    images = X.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("image_id"), F.lit(30).alias("height"), F.lit(42).alias("width"), F.lit(3).alias("channels"), F.encode(F.repeat(pixel, 30 * 42 * 3), "utf-8").alias("pixels"))
    W.write_tiles(images, (14, 14), path)
    told = spark.read.schema("image_id long, tile_id string, bbox array<long>, center array<double>").json(f"{path}/manifest")
    tiles = spark.read.parquet(f"{path}/tiles").select(F.col("image_id").cast("long").alias("image_id"), "tile_id", F.decode(F.substring("pixels", 1, 1), "utf-8").alias("pixel"), F.octet_length("pixels").alias("n"))
    both = told.join(tiles, ["image_id", "tile_id"])
    return both.select("image_id", "tile_id", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.col("center")[0].alias("cx"), F.col("center")[1].alias("cy"), "pixel", "n")


@query(f"{with_views('boxes')} SELECT box_id AS id, (x1 - x0) * (y1 - y0) AS area, x0 AS bbox_x0, y0 AS bbox_y0, x1 - x0 AS bbox_w, y1 - y0 AS bbox_h, score AS predicted_iou FROM boxes")
def k09_write_mask_table(spark, d):
    """The table of masks, written as CSV and read back by its header."""
    path, w, h = fresh(spark, "mask-table"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    zero = {c: F.lit(0.0) for c in W.MASK_COLUMNS}
    known = {"id": F.col("box_id"), "area": w * h, "bbox_x0": F.col("x0"), "bbox_y0": F.col("y0"), "bbox_w": w, "bbox_h": h, "predicted_iou": F.col("score")}
    W.write_mask_table(X.boxes(spark, d).select(*[c.alias(n) for n, c in (zero | known).items()]), path)
    got = spark.read.option("header", True).schema(", ".join(f"{c} {'long' if c == 'id' else 'double'}" for c in W.MASK_COLUMNS)).csv(f"{path}/metadata")
    return got.select("id", "area", "bbox_x0", "bbox_y0", "bbox_w", "bbox_h", "predicted_iou")


@query(f"{with_views('query_geo')} SELECT query_idx, round(sqrt((x - (t.cx + dx)) ** 2 + (y - (t.cy + dy)) ** 2), 6) AS consistency, abs(dx) <= t.ew / 2 AND abs(dy) <= t.eh / 2 AS inside FROM query_geo JOIN tile_geo t ON t.image_idx = gt_tile")
def k11_write_offset_diagnostics(spark, d):
    """Diagnostics of each query, written as JSON lines and read back."""
    t = X.tile_geo(spark, d).withColumnRenamed("image_idx", "gt_tile")
    c = F.sqrt((F.col("x") - F.col("cx") - F.col("dx")) ** 2 + (F.col("y") - F.col("cy") - F.col("dy")) ** 2)
    out = X.query_geo(spark, d).join(t, "gt_tile").select("query_idx", F.round(c, 6).alias("consistency"), ((F.abs("dx") <= F.col("ew") / 2) & (F.abs("dy") <= F.col("eh") / 2)).alias("inside"))
    path = fresh(spark, "offsets")
    out.write.json(path)
    return spark.read.schema(out.schema).json(path)
