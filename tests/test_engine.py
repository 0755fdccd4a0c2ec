"""Hand-made cases: sources, sinks, traps of the semantics, the pipeline façade."""

import json
import tracemalloc

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tessella import models
from tessella.config import PipelineConfig
from tessella.functions import paths as N
from tessella.functions import vector as V
from tessella.operators import evaluation as E
from tessella.operators import joins as J
from tessella.operators import learning as L
from tessella.operators import masks as K
from tessella.operators import mining as T
from tessella.operators import pooling as P
from tessella.operators import retrieval as R
from tessella.operators import segments as S
from tessella.plans import fixtures as X
from tessella.plans.pipeline import image_vectors, retrieve_segments, segment_vectors
from tessella.profile import Profile
from tessella.queries import ORACLE, QUERIES
from tessella.queries import search as S_
from tessella.sinks import tables as W
from tessella.sources import files as FS
from tessella.sources import manifests as M
from tessella.sources import registry

SF = "/root/testdata/sf0.001"


def test_config():
    assert PipelineConfig().width == 20 and PipelineConfig().key() != PipelineConfig(gem_p=2.0).key()
    with pytest.raises(ValueError):
        PipelineConfig(matcher="none")


def test_unnormalised_center(spark):
    """Assignment is by direction, the residual by the centre as it is."""
    p = spark.createDataFrame([(0, 0, [1.0, 0.0])], "image_idx long, p long, desc array<double>")
    c = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 1.0])], "k long, c array<double>")
    got = {(r["k"], r["pos"]): r["x"] for r in P.vlad(P.assign(p, c), ["image_idx"]).collect()}
    assert got == {(0, 0): -1.0, (0, 1): 0.0}


def test_soft_sums_all_residuals(spark):
    p = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "image_idx long, p long, desc array<double>")
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "k long, c array<double>")
    own = {(r["k"], r["pos"]): round(r["x"], 6) for r in P.vlad_soft(p, c).collect()}
    book = {(r["k"], r["pos"]): round(r["x"], 6) for r in P.vlad_soft(p, c, textbook=True).collect()}
    w = np.exp([1, 0]) / np.exp([1, 0]).sum()
    x, cs = np.eye(2), np.eye(2)
    want = [sum(w[abs(q - k)] * (2 * x[q] - cs.sum(0)) for q in range(2)) for k in range(2)]
    want = [v / np.linalg.norm(v) for v in want]
    want = np.concatenate(want) / np.linalg.norm(np.concatenate(want))
    assert [own[k, i] for k in range(2) for i in range(2)] == [round(float(v), 6) for v in want]
    assert own != book


def test_signed_root(spark):
    p = spark.createDataFrame([(0, [-1.0, 8.0]), (0, [0.0, 0.0])], "image_idx long, desc array<double>")
    got = [r["x"] for r in P.pool(p, "gem", ["image_idx"]).orderBy("pos").collect()]
    assert got[0] < 0 < got[1]


def test_votes(spark):
    hits = spark.createDataFrame([(1, 0, 10, -0.5), (1, 1, 11, -0.1), (1, 0, 11, -0.4)], "query_idx long, q_seg long, image_idx long, sim double")
    images = spark.createDataFrame([(10,), (11,), (12,)], "image_idx long")
    by = lambda v: [(r["image_idx"], round(r["score"], 6)) for r in R.rank_votes(v, images, 3).orderBy("rank").collect()]
    assert by(R.vote_sum(hits)) == [(12, 0.0), (10, -0.25), (11, -0.25)]  # without a hit: 0, above negative sums
    assert by(R.vote_weighted(hits)) == [(11, 1.25), (10, 0.0), (12, 0.0)]
    assert [r["image_idx"] for r in R.rank_votes(R.vote_sum(hits), images, 1).collect()] == [12]


def test_recall_skips_queries_without_truth(spark):
    ranking = spark.createDataFrame([(q, r, d) for q in (1, 2, 3) for r, d in ((1, 10), (2, 20), (3, 30))], "query_id long, rank long, db_id long")
    gt = spark.createDataFrame([(1, 10), (2, 30), (3, None)], "query_id long, gt long")
    got = {r["k"]: (r["recall"], r["n_valid"]) for r in E.recall_at_k(ranking, gt, [1, 2, 3, 9]).collect()}
    assert got == {1: (0.5, 2), 2: (0.5, 2), 3: (1.0, 2), 9: (1.0, 2)}


def test_localization_without_centres(spark):
    pred = spark.createDataFrame([(1, 5, 1.0, 0.0), (2, 6, 0.0, 0.0), (3, 5, 0.0, 3.0)], "query_idx long, tile long, px double, py double")
    gt = spark.createDataFrame([(1, 5, 0.0, 0.0), (2, 5, 0.0, 0.0), (3, 7, 0.0, 0.0)], "query_idx long, gt_tile long, dx double, dy double")
    tiles = spark.createDataFrame([(5, 0.0, 0.0), (6, None, None), (7, 4.0, 0.0)], "image_idx long, cx double, cy double")
    got = {r["query_idx"]: r["err"] for r in E.localization_errors(pred, gt, tiles).collect()}
    assert got == {1: 1.0, 2: None, 3: 5.0}


def test_rle(spark):
    masks = {0: "0000", 1: "1111", 2: "1001", 3: "0", 4: "1"}
    bits = spark.createDataFrame([(m, i, int(b)) for m, s in masks.items() for i, b in enumerate(s)], "m long, i long, bit int")
    runs = K.rle_encode(bits, "m", "i", "bit")
    got = {}
    for r in runs.orderBy("m", "run").collect():
        got.setdefault(r["m"], []).append(r["n"])
    assert got == {0: [4], 1: [0, 4], 2: [0, 1, 2, 1], 3: [1], 4: [0, 1]}
    assert {(r["m"], r["pos"]) for r in K.rle_decode(runs, "m").collect()} == {(m, i) for m, s in masks.items() for i, b in enumerate(s) if b == "1"}


def test_nms_chain(spark):
    rows = [(0, 1, 0.0, 0.0, 10.0, 10.0, 3.0), (0, 2, 4.0, 0.0, 14.0, 10.0, 2.0), (0, 3, 8.0, 0.0, 18.0, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "grp long, box_id long, x0 double, y0 double, x1 double, y1 double, score double")
    assert {r["box_id"] for r in K.nms(df, 0.3).collect()} == {1, 3}


def test_delaunay_has_no_crossings():
    rng = np.random.default_rng(3)
    pts = [tuple(p) for p in rng.random((12, 2))]
    edges = K.triangulate(pts)
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for i, j in edges:
        for k, m in edges:
            if len({i, j, k, m}) == 4:
                a, b, c, d = pts[i], pts[j], pts[k], pts[m]
                assert not (cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0)
    assert len(edges) >= 2 * len(pts) - 3


def test_both_search_paths_agree(spark):
    q, db = X.split_vectors(spark, SF)
    one = R.top_k(R.cosine_pairs(q, db), 5).select("query_id", "rank", "db_id").collect()
    for most in (0, 1 << 20):
        two = R.top_k_blocks(q, db, 5, block_rows=100, query_rows=7, broadcast_bytes=most).select("query_id", "rank", "db_id").collect()
        assert set(one) == set(two)


def test_large_databases_bypass_the_driver(spark, monkeypatch):
    """18 MB of vectors meet their queries in cells, with the same result as if they were sent."""
    e = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i))
    q = spark.range(5).select(F.col("id").alias("query_id"), e.alias("q"))
    db = spark.range(100, 36100).select(F.col("id").alias("db_id"), e.alias("e"))
    want = R.top_k_blocks(q, db, 4, broadcast_bytes=1 << 26).collect()
    monkeypatch.setattr(R, "_sent", None)
    got = R.top_k_blocks(q, db, 4)
    assert set(got.select("query_id", "db_id", "sim", "rank").collect()) == set(want) and len(want) == 20


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("odd", [float("nan"), float("inf")])
def test_an_odd_vector_does_not_order_all(monkeypatch, metric, odd):
    """One vector that compares with nothing among many: other queries order few entries, and find what they found."""
    ordered, best_of = [], R._best_of
    monkeypatch.setattr(R, "_best_of", lambda row, *a: ordered.append(len(row)) or best_of(row, *a))
    rng = np.random.default_rng(3)
    q, m = R._unit(rng.normal(size=(20, 8))), R._unit(rng.normal(size=(2000, 8)))
    row, place, score, rank = R._best(q, m, 5, metric)
    with np.errstate(all="ignore"):
        odd_q, odd_m = np.vstack([q, np.full((1, 8), odd)]), np.vstack([m, np.full((1, 8), odd)])
        a, b = (R._unit(odd_q), R._unit(odd_m)) if metric == "cosine" else (odd_q, odd_m)
        found = R._best(a, b, 5, metric)
    of = found[0] < 20
    assert all((x[of] == y).all() for x, y in zip(found, (row, place, score, rank)))
    assert (~of).sum() == 5 and ordered[1] < 2001 + 20 * 200


def test_manifests_and_sinks(spark, tmp_path):
    (tmp_path / "tiles_test.json").write_text(json.dumps({"tiles": [{"image": "a.png", "center": [1, 2]}, {"image": "b.png", "tile_id": "x", "extent": {"x": 3, "y": 4}}]}))
    (tmp_path / "queries.json").write_text(json.dumps([{"image": "q.png", "positives": ["x", "y"], "offset": {"dx": 1, "dy": -1}}]))
    tiles, queries = registry.load("cvgl", spark, root=str(tmp_path))
    assert [(r["tile_id"], r["cx"], r["ew"]) for r in tiles.orderBy("tile_idx").collect()] == [("tile_000000", 1.0, None), ("x", None, 3.0)]
    r = queries.first()
    assert (r["query_id"], r["gt_tile_id"], r["dx"], r["dy"]) == ("query_000000", "x", 1.0, -1.0)
    W.write_manifests(tiles, queries, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out/summary")).first()[0]) == {"queries": 1, "tiles": 2}
    with pytest.raises(Exception, match="list"):
        M.manifest_entries(spark.createDataFrame([('{"other": 1}',)], "json string")).collect()


def test_mask_files(spark, tmp_path):
    m = np.zeros((2, 4, 4), bool)
    m[0, 1, 2] = m[1, 3, 3] = True
    np.savez(tmp_path / "one.npz", masks=m)
    (tmp_path / "two.json").write_text(json.dumps({"masks": [{"segmentation": [[0, 1], [0, 0]]}]}))
    got = {tuple(r) for r in FS.scan_masks(spark, str(tmp_path)).collect()}
    assert got == {("one", 0, 1, 2), ("one", 1, 3, 3), ("two", 0, 0, 1)}


def test_vectors_of_images(spark):
    p = X.patches(spark, SF).where("image_idx < 3")
    for how in ("gap", "gmp", "gem", "cls", "vlad"):
        got = image_vectors(p, PipelineConfig(aggregation=how), X.centers(spark, SF)).select(F.round(V.norm(F.col("v")), 6).alias("n"), F.size("v").alias("d")).collect()
        assert {r["n"] for r in got} == {1.0} and {r["d"] for r in got} == {640 if how == "vlad" else 64}


def test_extractors():
    with pytest.raises(ValueError, match="plugged in"):
        models.build("dinov2")
    assert models.build("patch_stats", patch_stride=2)(np.zeros((1, 5, 4, 3))).shape == (1, 4, 12)


def test_queries_without_sql_take_all_rows(spark):
    from tessella.queries import QUERIES

    want = set()
    for _, g in X.boxes(spark, SF).toPandas().groupby("grp"):
        left = g.sort_values(["score", "box_id"], ascending=[False, True]).to_dict("records")
        while left:
            a, *left = left
            want.add((a["grp"], a["box_id"]))
            area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
            both = lambda b: max(min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), 0) * max(min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]), 0)
            left = [b for b in left if both(b) / (area(a) + area(b) - both(b)) <= 0.5]
    assert {(r["grp"], r["box_id"]) for r in QUERIES["g15_nms"](spark, SF).collect()} == want
    images = QUERIES["x01_extractor_interface"](spark, SF).select("image_idx").distinct().count()
    assert images == X.table(spark, SF, "supplier").count() > 5


def _matrix(df, key="vec_id", vec="e"):
    rows = df.select(key, vec).orderBy(key).collect()
    return np.array([r[vec] for r in rows])


def test_pca_against_numpy(spark):
    """Same subspace, same scores up to sign; whitened scores have unit spread before unit length."""
    v = X.vectors(spark, SF)
    train, every = _matrix(v.where("vec_id % 10 <> 0")), _matrix(v)
    got = _matrix(L.pca(v.where("vec_id % 10 <> 0"), "e", 8, whiten=True)(v.select("vec_id", "e")))
    _, s, axes = np.linalg.svd(train - train.mean(0), full_matrices=False)
    want = (every - train.mean(0)) @ axes[:8].T / (s[:8] / np.sqrt(len(train) - 1))
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    low = _matrix(L.pca(v, "e", 8, low_factor=0.25)(v.select("vec_id", "e")))
    _, _, axes = np.linalg.svd(every - every.mean(0), full_matrices=False)
    want = (every - every.mean(0)) @ np.concatenate([axes[:6], axes[-2:]]).T
    assert np.allclose(np.abs(low), np.abs(want / np.linalg.norm(want, axis=1, keepdims=True)), atol=1e-5)


def test_pca_fallback(spark):
    v = X.vectors(spark, SF).select("vec_id", "e")
    train, test = v.where("vec_id < 40"), v.where("vec_id >= 40")
    a, b = L.reduce_pca(train, test, "e", 8, low_factor=0.25, fallback=20)
    x, n = _matrix(v), 40
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    down = (x - x.mean(0)) @ axes[:20].T
    _, _, axes = np.linalg.svd(down[:n] - down[:n].mean(0), full_matrices=False)
    want = (down - down[:n].mean(0)) @ np.concatenate([axes[:6], axes[-2:]]).T
    assert np.allclose(np.abs(np.concatenate([_matrix(a), _matrix(b)])), np.abs(want), atol=1e-6)
    with pytest.raises(ValueError, match="fallback"):
        L.reduce_pca(train, test, "e", 8, low_factor=0.25, fallback=4)


def test_vocabularies_leave_little(spark):
    """The fit is about as good as the best of ten starts of plain Lloyd steps, and better than its own start."""
    p = X.patches(spark, SF)
    x = _matrix(p.withColumn("key", F.col("image_idx") * 25 + F.col("p")), "key", "desc")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = 9.0
    for seed in range(10):
        c = x[np.random.default_rng(seed).choice(len(x), 8, replace=False)]
        for _ in range(20):
            near = (x @ c.T).argmax(1)
            c = np.array([x[near == k].sum(0) if (near == k).any() else c[k] for k in range(8)])
            c /= np.linalg.norm(c, axis=1, keepdims=True)
        best = min(best, float((1 - (x @ c.T).max(1)).mean()))
    left = L.inertia(p.select("image_idx", "p", "desc"), L.fit_vocabulary(p, 8)).first()
    assert left["n"] == len(x) and left["inertia"] < best * 1.05
    from tessella.queries import QUERIES

    swept = {r["tiles"]: r["inertia"] for r in QUERIES["m03_vocabulary_sweep"](spark, SF).collect()}
    assert sorted(swept) == [1, 4, 8, 16, 64] and swept[64] <= swept[1] + 1e-9
    with pytest.raises(ValueError, match="descriptors"):
        L.fit_vocabulary(p.limit(3), 4)


def test_delaunay_circles_are_empty(spark):
    """Every triangle of edges without a point inside has no point in its circle; edges agree with the operator's table."""
    rng = np.random.default_rng(5)
    pts = rng.random((14, 2))
    edges = K.triangulate([tuple(p) for p in pts])
    circle = lambda i, j, k: np.linalg.solve(2 * np.array([pts[j] - pts[i], pts[k] - pts[i]]), [pts[j] @ pts[j] - pts[i] @ pts[i], pts[k] @ pts[k] - pts[i] @ pts[i]])
    want = set()
    for i in range(14):
        for j in range(i):
            for k in range(j):
                c = circle(i, j, k)
                if all(np.linalg.norm(pts[m] - c) >= np.linalg.norm(pts[i] - c) - 1e-12 for m in range(14)):
                    want |= {(j, i), (k, j), (k, i)}
    assert edges == want
    df = spark.createDataFrame([(1, s, float(x), float(y)) for s, (x, y) in enumerate(pts)], "image_idx long, seg long, cx double, cy double")
    assert {(r["i"], r["j"]) for r in K.delaunay_adjacency(df).collect()} == want | {(b, a) for a, b in want} | {(i, i) for i in range(14)}


def _regions(grid):
    label = np.where(grid, np.arange(grid.size).reshape(grid.shape) + 1, 0)
    while True:
        wide = np.pad(label, 1)
        near = np.max([wide[1 + a : 1 + a + grid.shape[0], 1 + b : 1 + b + grid.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0) * grid
        if (near == label).all():
            return label
        label = near


@pytest.mark.parametrize("mode", ["holes", "islands"])
def test_small_regions_by_brute_force(spark, mode):
    rng = np.random.default_rng(1)
    grids = {i: rng.random((6, 7)) < 0.5 for i in range(20)}
    cells = spark.createDataFrame([(i, int(r), int(c)) for i, g in grids.items() for r, c in zip(*np.nonzero(g))], "mask_id long, row long, col long")
    got = {}
    for r in K.small_regions(cells, 6, 7, 4, mode).collect():
        got.setdefault(r["mask_id"], set()).add((r["row"], r["col"]))
    for i, g in grids.items():
        label = _regions(~g if mode == "holes" else g)
        sizes = {x: int((label == x).sum()) for x in np.unique(label) if x}
        small = np.isin(label, [x for x, n in sizes.items() if n < 4])
        if mode == "holes":
            want = g | small
            assert got[i] == set(zip(*map(list, np.nonzero(want))))
        else:
            want = g & ~small
            if want.any():
                assert got[i] == set(zip(*map(list, np.nonzero(want))))
            else:
                assert len(got[i]) == max(sizes.values())


def test_clean_masks(spark):
    full = [(1, 1, r, c) for r in range(5) for c in range(5)]
    holed = [(1, 2, r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)]
    apart = [(1, 3, 0, 0)] + [(2, 4, r, c) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(full + holed + apart, "image_idx long, mask_id long, row long, col long")
    kept = {(r["image_idx"], r["mask_id"]) for r in K.clean_masks(df, 5, 5, 3).collect()}
    assert kept == {(1, 1), (1, 3), (2, 4)}  # the filled one is a copy of the whole one, which has not changed


def test_random_triplets(spark):
    p = X.vectors(spark, SF).select("vec_id", "e", (F.col("e")[0] * 100).alias("x"), (F.col("e")[1] * 100).alias("y"))
    q, b = p.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), p.where("vec_id % 10 <> 0").withColumnRenamed("vec_id", "db_id")
    at = {r["vec_id"]: (r["x"], r["y"]) for r in p.select("vec_id", "x", "y").collect()}
    far = lambda i, j: np.hypot(at[i][0] - at[j][0], at[i][1] - at[j][1])
    rows = T.mine_triplets(q, b, 6.0, 12.0, mode="random", negatives=10).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], set()).add(r["negative"])
        assert far(r["query_id"], r["positive"]) <= 6 and far(r["query_id"], r["negative"]) > 12
    assert rows and {len(n) for n in by.values()} == {10}
    assert rows == T.mine_triplets(q.repartition(7), b.repartition(3), 6.0, 12.0, mode="random", negatives=10).collect() or set(rows) == set(T.mine_triplets(q.repartition(7), b.repartition(3), 6.0, 12.0, mode="random", negatives=10).collect())
    weighted = T.sample_queries(q.withColumn("weight", (F.col("query_id") < 100).cast("double")), 6, 1, "weight").collect()
    assert len(weighted) == 6 and all(r["query_id"] < 100 for r in weighted)
    with pytest.raises(ValueError, match="mode"):
        T.mine_triplets(q, b, 6.0, 12.0, mode="other")


def test_segment_run(spark):
    p, m = X.patches(spark, SF), X.segments(spark, SF).select("image_idx", "seg", "p")
    gt = p.where("image_idx % 4 = 0").select(F.col("image_idx").alias("query_id"), (F.col("image_idx") + 1).alias("gt"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")).distinct()
    config = PipelineConfig(aggregation="gap", top_k_vals=(1, 5), coarse_top_k=5, top_m=8, segment_top_k=6, rerank=False, offset="sim_map")
    # tiles that hold the queries' own patches are found first
    tiles = p.where("image_idx % 4 = 0").withColumn("image_idx", F.col("image_idx") + 1)
    masks = m.where("image_idx % 4 = 0").withColumn("image_idx", F.col("image_idx") + 1)
    run = retrieve_segments(p.where("image_idx % 4 = 0"), tiles, m, masks, gt, config, (5, 5))
    assert run.metrics.first()["recall_1"] == 1.0 and run.bank.columns == ["image_idx", "seg", "v"]
    both = [segment_vectors(p, m, PipelineConfig(aggregation="gap", centroid_weight=w, context_weight=w), (5, 5)).where("image_idx = 0").collect() for w in (0.0, 0.5)]
    assert {len(r["v"]) for r in both[0]} == {64} and {len(r["v"]) for r in both[1]} == {64 + 16 + 20}
    assert all(abs(np.linalg.norm(r["v"]) - 1) < 1e-9 for rows in both for r in rows)
    with pytest.raises(ValueError):
        segment_vectors(p, m, PipelineConfig(aggregation="cls"), (5, 5))


def test_upsampling(spark):
    cells = spark.createDataFrame([(0, r, c, float(r * 10 + c)) for r in range(3) for c in range(4)], "image_idx long, row long, col long, v double")
    got = {(r["y"], r["x"]): r["v"] for r in S.upsample_bilinear(cells, (3, 4), (6, 8)).collect()}
    grid = np.arange(3)[:, None] * 10.0 + np.arange(4)[None, :]
    want = FS.resized(grid[:, :, None], 6, 8)[:, :, 0]
    assert len(got) == 48 and all(abs(got[y, x] - want[y, x]) < 1e-9 for y, x in got)


def test_transforms():
    image = np.arange(6 * 9 * 3, dtype=float).reshape(6, 9, 3)
    assert FS.transformed(image)[0] is image
    crops = FS.transformed(image, "five_crops", (4, 4))
    assert [c.shape for c in crops] == [(4, 4, 3)] * 5 and crops[0][0, 0, 0] < crops[1][0, 0, 0] and crops[0][0, 0, 0] <= crops[4][0, 0, 0] <= crops[3][0, 0, 0]
    assert FS.transformed(image, "shorter_side", (4, 8))[0].shape == (4, 6, 3) and FS.transformed(image, "central_crop", (4, 8))[0].shape == (4, 8, 3)
    assert np.allclose(FS.resized(image, 6, 9), image)
    with pytest.raises(ValueError):
        FS.transformed(image, "other")


def test_sources_that_fail(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        FS.list_files(spark, str(tmp_path / "none"))
    for name in ("b.PNG", "a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    listed = FS.list_files(spark, str(tmp_path), (".jpg", ".png"), recursive=False)
    assert [r["path"].rsplit("/", 1)[1] for r in listed.collect()] == ["a.jpg", "b.PNG"]
    assert FS.list_files(spark, str(tmp_path), recursive=False, limit=1).count() == 1
    i = spark.createDataFrame([("a",), ("b",)], "image string")
    with pytest.raises(Exception, match="generator"):
        FS.choose_masks(i, i.where("image = 'a'"), i.limit(0), "generate").collect()
    assert {(r["image"], r["source"]) for r in FS.choose_masks(i, i.where("image = 'a'"), i, "manifest").collect()} == {("a", "manifest"), ("b", "none")}
    t = spark.createDataFrame([(1, 7, 0), (2, 7, 0)], "sat_id long, class_id long, view long")
    u = spark.createDataFrame([(5, 7, 1)], "uav_id long, class_id long, view long")
    assert {(r["sat_id"], r["uav_id"]) for r in J.one_to_one(t, u).collect()} == {(1, 5), (2, None)}
    with pytest.raises(Exception, match="no image left"):
        J.one_to_one(t, u, strict=True).collect()
    classes = spark.createDataFrame([(1,), (2,)], "class_id long")
    with pytest.raises(ValueError, match="classes"):
        J.missing_classes(classes, classes.where("class_id = 1"), strict=True)
    assert M.read_poses(spark, str(tmp_path / "no.txt")).count() == 0
    (tmp_path / "poses.txt").write_text("a 1 2 3 9\nb 4 5 6 9\n")
    np.savez(tmp_path / "poses.npz", np.array([[1.0, 2, 3], [4, 5, 6]]))
    for name in ("poses.txt", "poses.npz"):
        assert sorted(tuple(r) for r in M.read_poses(spark, str(tmp_path / name)).collect()) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    (tmp_path / "truth.json").write_text('{"query": 0, "positives": [3, 4]}\n{"query": 1, "positives": []}\n')
    assert sorted(tuple(r) for r in M.truth_lists(spark, str(tmp_path / "truth.json")).collect()) == [(0, 3), (0, 4)]
    numbers = spark.createDataFrame([("x/0012.jpg",)], "p string").select(M.file_number(F.col("p")).alias("n")).first()
    assert numbers["n"] == 12
    runs = spark.createDataFrame([('{"Run-Config": {"dataset_root": "/r"}}',)], "json string")
    assert M.dataset_root(runs).first()["root"] == "/r" and M.dataset_root(runs, "/g").first()["root"] == "/g"
    with pytest.raises(Exception, match="root"):
        M.dataset_root(spark.createDataFrame([("{}",)], "json string")).collect()
    arrays = spark.createDataFrame([(1, {"d": [[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]]]})], "id long, arrays map<string, array<array<array<double>>>>")
    assert [r["desc"] for r in M.keyed_descriptors(arrays, "d").orderBy("n").collect()] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]]
    with pytest.raises(Exception, match="no other"):
        M.keyed_descriptors(arrays, "other").collect()
    with pytest.raises(Exception, match="size mismatch"):
        spark.createDataFrame([(3, 4)], "h int, w int").select(N.checked_size(F.col("h"), F.col("w"), (4, 4))).collect()


def test_writers(spark, tmp_path):
    p = X.patches(spark, SF).where("image_idx < 2").select("image_idx", "p", "desc")
    one = W.write_patches(p, str(tmp_path / "patches"), PipelineConfig().key())
    two = W.write_patches(p.limit(0), str(tmp_path / "patches"), PipelineConfig().key())
    assert one.count() == two.count() == 50  # what is there is kept
    W.write_vocabulary(X.centers(spark, SF), str(tmp_path / "vocabulary"), seed=42)
    assert spark.read.parquet(str(tmp_path / "vocabulary/centers")).count() == X.centers(spark, SF).count()
    assert json.loads(spark.read.text(str(tmp_path / "vocabulary/facts")).first()[0]) == {"num_clusters": X.centers(spark, SF).count(), "seed": 42}
    metrics = spark.createDataFrame([(0.5, 3)], "map double, n_valid long")
    assert W.write_metrics(metrics, str(tmp_path / "ap"), "Coarse-") == json.loads(spark.read.text(str(tmp_path / "ap")).first()[0]) == {"Coarse-map": 0.5, "Coarse-n_valid": 3}
    ranking = spark.createDataFrame([(1, 1, 9, 0.5), (1, 2, 8, 0.25)], "query_id long, rank long, db_id long, sim double")
    offsets = spark.createDataFrame([(1, 2.0, 3.0)], "query_idx long, px double, py double")
    W.write_run({"k": 2}, {"R@1": 1.0}, ranking, str(tmp_path / "run"), offsets=offsets)
    result, back = W.read_run(spark, str(tmp_path / "run"))
    assert result == {"R@1": 1.0, "Run-Config": {"k": 2}} and back.count() == 2 and spark.read.json(str(tmp_path / "run/offsets")).count() == 1
    runs = spark.createDataFrame([(1, [0, 4], 2, 2)], "id long, counts array<long>, height long, width long")
    table = spark.createDataFrame([tuple(float(i) for i in range(len(W.MASK_COLUMNS)))], list(W.MASK_COLUMNS))
    W.write_mask_table(table, str(tmp_path / "masks"), runs)
    assert spark.read.json(str(tmp_path / "masks/rle")).first()["segmentation"]["counts"] == [0, 4]
    seen = []
    assert not W.log_run(result) and W.log_run(result, type("Log", (), {"log": lambda self, x: seen.append(x)})()) and seen == [result]


def test_profile_and_models(spark):
    profile = Profile()
    for _ in range(2):
        with profile.timed("search"):
            profile.count("queries", 5)
    assert profile.per_query(10)["queries"] == 1.0 and profile.per_query(0)["queries"] == 10.0 and profile.values["search"] >= 0
    table = np.concatenate([[[9.0]], np.full((6, 1), 2.0)])
    out = models.resize_position_table(table, (2, 3), (4, 5))
    assert out.shape == (21, 1) and np.allclose(out[1:], 2.0) and out[0, 0] == 9.0
    ramp = models.resize_position_table(np.arange(16.0).reshape(16, 1), (4, 4), (8, 8), prefix=0).reshape(8, 8)
    assert (np.diff(ramp, axis=1) > 0).all() and np.allclose(ramp + ramp[::-1, ::-1], 15.0)
    scores = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (1, 2, 0.7)], "image_idx long, mask long, iou double")
    assert models.best_mask(scores, 1).first()["mask"] == 2 and models.best_mask(scores, 4).first()["mask"] == 0


def test_search_holds_a_strip_of_products_at_a_time():
    """Ties and copies among 4,000 rows, and vectors so near that their product cancels."""
    rng = np.random.default_rng(4)
    m, q = R._unit(rng.normal(size=(4000, 16))), R._unit(rng.normal(size=(2000, 16)))
    m[100:900:2] = q[5] = m[7]
    m[8], q[6] = m[7] + 1e-9, m[8]
    tracemalloc.start()
    for metric in ("cosine", "l2"):
        tracemalloc.reset_peak()
        row, place, score, rank = R._best(q, m, 20, metric)
        assert tracemalloc.get_traced_memory()[1] < 120e6
        assert (rank.reshape(-1, 20) == np.arange(1, 21)).all()
        for i in (0, 5, 6, 1999):
            s = np.round(m @ q[i] if metric == "cosine" else -np.sqrt(((m - q[i]) ** 2).sum(1)), 9)
            want = np.argsort(-s, kind="stable")[:20]
            assert (place[row == i] == want).all() and np.allclose(score[row == i], s[want], atol=1e-12)
    tracemalloc.stop()


def test_positives_are_those_of_the_ranking(spark):
    ranked = S_.ranking(spark, SF, 3)
    got, all_ranked = S_.positives(spark, SF, ranked).collect(), ranked.select("query_id", "db_id").collect()
    label = {r["vec_id"]: r["label"] for r in X.vectors(spark, SF).collect()}
    assert set(got) == {r for r in all_ranked if label[r["query_id"]] == label[r["db_id"]]}
    of = {r["query_id"]: (r["n"], r["gt"]) for r in S_.of_label(spark, SF).collect()}
    for q in {r["query_id"] for r in all_ranked}:
        same = [i for i, x in label.items() if i % 10 and x == label[q]]
        assert of.get(q) == ((len(same), min(same)) if same else None)


def test_blocks_meet_in_cells(spark, monkeypatch):
    """Small cells, and no join that could send one side's copies to the driver."""
    monkeypatch.setattr(R, "CELL_BYTES", 20_000)
    q, db = X.split_vectors(spark, SF)
    found = R.top_k_blocks(q, db, 5, block_rows=7, query_rows=3, broadcast_bytes=0)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert set(found.collect()) == set(R.top_k_blocks(q, db, 5).select(*found.columns).collect())


@pytest.mark.parametrize("most", [0, 1 << 26])
def test_mined_triplets_list_no_soft_positives(spark, monkeypatch, most):
    """Every row but a few is a soft positive; brute force over all pairs."""
    monkeypatch.setattr(T, "radius_join", None)
    monkeypatch.setattr(T, "top_k_blocks", lambda *a, **k: R.top_k_blocks(*a, **k, block_rows=16, query_rows=4, broadcast_bytes=most))
    p = X.vectors(spark, SF).select("vec_id", "e", (F.col("e")[0] * 20).alias("x"), (F.col("e")[1] * 20).alias("y"))
    at = {r["vec_id"]: (np.array(r["e"]), r["x"], r["y"]) for r in p.collect()}
    q, b = p.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), p.where("vec_id % 10 <> 0").withColumnRenamed("vec_id", "db_id")
    got, want = {tuple(r) for r in T.mine_triplets(q, b, 3.0, 4.0, negatives=4).collect()}, set()
    for i in [i for i in at if i % 10 == 0]:
        near = sorted((round(float(np.linalg.norm(at[i][0] - e)), 9), j, (x - at[i][1]) ** 2 + (y - at[i][2]) ** 2) for j, (e, x, y) in at.items() if j % 10)
        first = [j for _, j, d in near if d <= 9][:1]
        want |= {(i, first[0], j) for j in [j for _, j, d in near if not d <= 16][:4] if first}
    assert got == want and want


def test_all_pairs_in_batches(spark, monkeypatch):
    """Sent, in cells, and with vectors that are null or of another width, whose pairs have no cosine."""
    monkeypatch.setattr(R, "CELL_BYTES", 20_000)
    q, db = X.split_vectors(spark, SF)
    one = {(r["query_id"], r["db_id"]): r["sim"] for r in R.cosine_pairs(q, db, 6).collect()}
    two = {(r["query_id"], r["db_id"]): r["sim"] for r in R.cosine_pairs(q, db, 6, broadcast_bytes=0).collect()}
    assert one == two and len(one) == q.count() * db.count()
    assert "BroadcastNestedLoopJoin" not in R.cosine_pairs(q, db)._jdf.queryExecution().executedPlan().toString()
    odd = db.select("db_id", "e").unionByName(spark.createDataFrame([(100001, None), (100003, [1.0, None] * 32), (100007, [1.0])], "db_id long, e array<double>"))
    three = {(r["query_id"], r["db_id"]): r["sim"] for r in R.cosine_pairs(q, odd, 6).collect()}
    assert len(three) == len(one) + 3 * q.count() and {v for (_, j), v in three.items() if j > 100000} == {None}


def test_value_ranks_without_windows(spark):
    """Copies share a rank; by windows and by sorting where a query's row is made."""
    q, db = X.split_vectors(spark, SF)
    db = db.select("db_id", "e").unionByName(db.where("db_id < 40").select((F.col("db_id") + 100000).alias("db_id"), "e"))
    one, two = R.value_ranks(q, db), R.value_ranks(q, db, broadcast_bytes=0)
    assert "Window" not in one._jdf.queryExecution().executedPlan().toString()
    assert set(one.collect()) == set(two.collect()) and one.groupBy("query_id", "value_rank").count().where("count > 1").count() > 0


@pytest.mark.parametrize("name", ["g06_adjacency_power", "g29_upsample_bilinear", "g30_supersegments"])
@pytest.mark.parametrize("n", [1, 3, 31])
def test_incomplete_grids(spark, tmp_path, name, n):
    """An image with one, three or six patches keeps all its segments and pixels, as in SQL."""
    import duckdb

    X.table(spark, SF, "embeddings").where(F.col("vec_id") < n).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    oracle.compare(spark, con, str(tmp_path), QUERIES[name], ORACLE[name])
