"""Radius joins, class joins and joins of rankings and truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.manifests import with_index


def radius_join(left: DataFrame, right: DataFrame, radius: float, dims: list[str], left_id: str, right_id: str) -> DataFrame:
    """All pairs within the radius (inclusive), by cells of its side.

    A left point visits the 3**d cells around its own; points meet in a cell by an
    equi-join and the true distance is then tested, so the plan is a hash or
    merge join whatever the sizes.  Both sides need the columns of `dims`.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    l = left.select(left_id, *[F.col(c).alias(f"l_{c}") for c in dims])
    for c in dims:
        own = cell(f"l_{c}")
        l = l.withColumn(f"cell_{c}", F.explode(F.array(own - 1, own, own + 1)))
    r = right.select(right_id, *dims, *[cell(c).alias(f"cell_{c}") for c in dims])
    both = l.join(r, [f"cell_{c}" for c in dims])
    square = sum(((F.col(c) - F.col(f"l_{c}")) ** 2 for c in dims), F.lit(0.0))
    return both.withColumn("dist2", square).where(F.col("dist2") <= radius * radius).select(left_id, right_id, F.sqrt("dist2").alias("dist"))


def angle_filter(pairs: DataFrame, left: list[str], right: list[str], most: float) -> DataFrame:
    """Keeps pairs whose mean absolute angle difference is below `most`; angles do not wrap around."""
    mean = sum((F.abs(F.col(a) - F.col(b)) for a, b in zip(left, right)), F.lit(0.0)) / len(left)
    return pairs.where(mean < most)


def class_join(queries: DataFrame, tiles: DataFrame) -> DataFrame:
    """queries: query_id, class_id; tiles: tile_id, class_id.  A row for each query and tile of its class; queries without one have null."""
    return queries.join(tiles.select("class_id", "tile_id"), "class_id", "left").select("query_id", "class_id", "tile_id")


def class_truth(queries: DataFrame, tiles: DataFrame) -> DataFrame:
    """tiles: tile_id, class_id, pos.  query_id, class_id, n (tiles of the class) and gt (the first by pos), without pairing queries with tiles."""
    of = tiles.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("tile_id", F.struct("pos", "tile_id")).alias("gt"))
    return queries.join(of, "class_id", "left").select("query_id", "class_id", F.coalesce("n", F.lit(0)).alias("n"), "gt")


def one_to_one(satellites: DataFrame, uavs: DataFrame, strict: bool = False) -> DataFrame:
    """Each satellite takes the first unused UAV image of its class and view, else the first unused of its class.

    satellites: sat_id, class_id, view; uavs: uav_id, class_id, view.  The choice is
    made in order within a class, so classes run side by side and each in one task.
    Without an unused image: null, or an error if `strict`.
    """
    from collections import deque

    import pandas as pd

    def choose(key, sats: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
        free = free.sort_values("uav_id")
        every, by_view = deque(zip(free.uav_id, free.view)), {v: deque(g.uav_id) for v, g in free.groupby("view")}
        used: set = set()
        out = []
        for s in sats.sort_values("sat_id").itertuples():
            same, uav = by_view.get(s.view, ()), None
            while same and same[0] in used:
                same.popleft()
            while every and every[0][0] in used:
                every.popleft()
            if same or every:
                uav = int(same[0] if same else every[0][0])
                used.add(uav)
            elif strict:
                raise ValueError(f"no image left in class {key[0]} for {s.sat_id}")
            out.append((s.sat_id, key[0], uav))
        return pd.DataFrame(out, columns=["sat_id", "class_id", "uav_id"]).astype({"uav_id": "Int64"})

    return satellites.groupBy("class_id").cogroup(uavs.groupBy("class_id")).applyInPandas(choose, "sat_id long, class_id long, uav_id long").where("sat_id is not null")


def positives_join(queries: DataFrame, tiles: DataFrame) -> DataFrame:
    """queries: query_idx, gt_tile_id, candidates; tiles: tile_idx, tile_id.  Distinct positives.

    An unknown gt_tile_id is an error; unknown candidates are left out.
    """
    gt = queries.where("gt_tile_id is not null").join(tiles, F.col("gt_tile_id") == F.col("tile_id"), "left")
    checked = gt.select("query_idx", F.when(F.col("tile_idx").isNull(), F.raise_error(F.concat(F.lit("unknown tile "), "gt_tile_id")).cast("long")).otherwise(F.col("tile_idx")).alias("tile_idx"))
    more = queries.select("query_idx", F.explode(F.col("candidates").cast("array<string>")).alias("tile_id")).join(tiles, "tile_id").select("query_idx", "tile_idx") if "candidates" in queries.columns else checked.limit(0)
    return checked.union(more).distinct()


def gt_to_bank(positives: DataFrame, bank: DataFrame) -> DataFrame:
    """The lowest positive that the sampled bank still holds, else null.  positives: query_idx, tile_idx; bank: tile_idx, pos."""
    return positives.join(bank, "tile_idx", "left").groupBy("query_idx").agg(F.min("pos").alias("gt"))


def sampled_negatives(queries: DataFrame, db: DataFrame, positives: DataFrame, draws: int, seed: int) -> DataFrame:
    """queries: query_id; db: db_id; positives: query_id, db_id.  Distinct seeded draws from the database for
    each query, without its positives.

    A draw is a position, told by a hash of seed, query and number; positions meet the
    database by an equi-join, so no query meets all of it and no partitioning changes a draw.
    """
    numbered = with_index(db, "db_id", "_pos")
    n = numbered.count()
    if not n:
        return positives.limit(0)
    told = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("_i").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_i")).select("query_id", F.pmod(told, F.lit(n)).alias("_pos")).distinct()
    return drawn.join(numbered, "_pos").select("query_id", "db_id").join(positives, ["query_id", "db_id"], "left_anti")


def ranking_back(ranking: DataFrame, bank: DataFrame, manifest: DataFrame) -> DataFrame:
    """Bank position to manifest index through the relative path; the position itself where there is none."""
    return ranking.join(bank, "pos", "left").join(manifest, "relpath", "left").select("query_id", "rank", F.coalesce("tile_idx", "pos").alias("tile_idx"))


def queries_back(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """results: query_row, relpath (null: not known); manifest: query_idx, relpath.  query_row, query_idx.

    By path, else by file name (the last item of that name), else the row itself
    if the manifest is as long; else null.
    """
    clean = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\./", "")
    name = lambda c: F.element_at(F.split(clean(c), "/"), -1)
    by_path = manifest.groupBy(clean(F.col("relpath")).alias("_path")).agg(F.max("query_idx").alias("_p"))
    by_name = manifest.groupBy(name(F.col("relpath")).alias("_name")).agg(F.max("query_idx").alias("_n"))
    n = manifest.count()
    told = results.withColumn("_path", clean(F.col("relpath"))).withColumn("_name", name(F.col("relpath")))
    found = told.join(by_path, "_path", "left").join(by_name, "_name", "left")
    return found.select("query_row", F.coalesce("_p", "_n", F.when(F.col("query_row") < n, F.col("query_row"))).alias("query_idx"))


def missing_classes(tiles: DataFrame, queries: DataFrame, strict: bool = False) -> DataFrame:
    """class_id of tiles that no query has; with `strict` any is an error."""
    out = tiles.select("class_id").distinct().join(queries.select("class_id"), "class_id", "left_anti")
    if strict and not out.isEmpty():
        raise ValueError(f"classes without queries, such as {out.orderBy('class_id').first()[0]}")
    return out
