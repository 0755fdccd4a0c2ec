"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal keys (texts) are linked, each with all others of its
group.  A group is never expanded into pairs: all that propagation needs of it
is how many of its members each shard holds, so the state is one cell for each
(group, shard), however large the group.  In each round the members in a cell
move towards the shard that holds most of their group and has room; the moves
into a shard are taken in order of their gain until its quota is full, in
sub-groups with shares of the quota so that no one task orders a shard's moves.
Rounds go on until a round moves nothing.  Then full shards exchange: of any two
shards, as many members move one way as the other, again towards the larger cells
of their groups.  Unlinked documents have no say and fill what is left, so counts
come out at most one apart (law `rows`).

A null text is an empty one: size 16, and linked with the other empty ones.
Repeated rows are documents of their own; ties go by hashes; an empty table
gives no rows; a very long text counts by its digest, as any other; of other
columns nothing is read, and those named key, shard or slot do not clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm import _common as C

SHARDS, SALTS = 40, 16


def _quota(label: F.Column, n: int, shards: int) -> F.Column:
    return F.lit(n // shards) + (label < n % shards).cast("long")


def _round(cells: DataFrame, n: int, shards: int) -> DataFrame:
    """cells: key, label, n.  One round of moves under the quotas."""
    room = cells.groupBy("label").agg(F.sum("n").alias("load"))
    all_labels = cells.sparkSession.range(shards).select(F.col("id").cast("int").alias("label"))
    room = all_labels.join(F.broadcast(room), "label", "left").select("label", (_quota(F.col("label"), n, shards) - F.coalesce("load", F.lit(0))).alias("room"))
    weighed = cells.join(F.broadcast(room), "label").withColumn("pull", F.struct("n", F.xxhash64("key", "label"), "label"))  # a row for each shard
    best = F.max(F.when(F.col("room") > 0, F.col("pull"))).over(Window.partitionBy("key"))
    wish = weighed.withColumn("best", best)
    moves = wish.where(F.col("best") > F.col("pull")).select("key", "label", "n", F.col("best.label").alias("to"), F.col("best.n").alias("gain"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    asked = moves.groupBy("to", "salt").agg(F.sum("n").alias("asked"))
    share = asked.join(F.broadcast(room), asked["to"] == room["label"]).select("to", "salt", F.floor(F.col("room") * F.col("asked") / F.sum("asked").over(Window.partitionBy("to"))).cast("long").alias("share"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("to", "salt").orderBy(F.desc("gain"), "key", "label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # shards x salts rows
    taken = moves.withColumn("before", before).join(F.broadcast(share), ["to", "salt"]).select("key", "label", "to", F.greatest(F.lit(0), F.least("n", F.col("share") - F.col("before"))).alias("k")).where("k > 0")
    return _moved(cells, taken)


def _exchange(cells: DataFrame) -> DataFrame:
    """cells: key, label, n.  One round of moves between shards, two shards at a time in about equal numbers."""
    weighed = cells.withColumn("pull", F.struct("n", F.xxhash64("key", "label"), "label"))
    wish = weighed.withColumn("best", F.max("pull").over(Window.partitionBy("key")))
    moves = wish.where(F.col("best") > F.col("pull")).select("key", "label", "n", F.col("best.label").alias("to"), F.col("best.n").alias("gain"), F.pmod(F.xxhash64(F.lit("exchange"), "key"), F.lit(SALTS)).alias("salt"))
    asked = moves.groupBy("label", "to", "salt").agg(F.sum("n").alias("asked"))
    one_way = asked.groupBy("label", "to").agg(F.sum("asked").alias("total"))
    back = one_way.select(F.col("to").alias("label"), F.col("label").alias("to"), F.col("total").alias("back"))
    # shards x shards x salts rows
    share = asked.join(one_way, ["label", "to"]).join(back, ["label", "to"]).select("label", "to", "salt", F.floor(F.least("total", "back") * F.col("asked") / F.col("total")).cast("long").alias("share"))
    order = Window.partitionBy("label", "to", "salt").orderBy(F.desc("gain"), "key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    taken = moves.withColumn("before", before).join(F.broadcast(share), ["label", "to", "salt"]).select("key", "label", "to", F.greatest(F.lit(0), F.least("n", F.col("share") - F.col("before"))).alias("k")).where("k > 0")
    return _moved(cells, taken)


def _moved(cells: DataFrame, taken: DataFrame) -> DataFrame:
    """cells after k members of each (key, label) have gone to `to`."""
    out = cells.unionByName(taken.select("key", "label", (-F.col("k")).alias("n"))).unionByName(taken.select("key", F.col("to").alias("label"), F.col("k").alias("n")))
    return out.groupBy("key", "label").agg(F.sum("n").alias("n")).where("n > 0")


def propagate(cells: DataFrame, n: int, shards: int) -> DataFrame:
    """Rounds of moves into room until none is left to make, then at most `shards` rounds of exchanges.

    Every move goes to a cell at least as large, so the linked pairs that share
    a shard (told by the sum of squares) only rise, and the rounds end.
    """
    squares = F.sum(F.col("n").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
    before = cells.agg(squares).first()[0]
    exchanges = 0
    for step in (lambda c: _round(c, n, shards), _exchange):
        while exchanges < shards:
            cells = C.stored(step(cells), "shard-cells")
            now = cells.agg(squares).first()[0]
            if now == before:
                break
            before = now
            exchanges += step is _exchange
    return cells


def _kept(cells: DataFrame, n: int, shards: int) -> DataFrame:
    """What of each cell its shard's quota holds, the largest cells first; the rest goes to the pool."""
    cells = cells.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    load = cells.groupBy("label", "salt").agg(F.sum("n").alias("load"))
    load = load.withColumn("share", F.floor(_quota(F.col("label"), n, shards) * F.col("load") / F.sum("load").over(Window.partitionBy("label"))).cast("long"))
    load = load.withColumn("share", F.when(F.sum("load").over(Window.partitionBy("label")) <= _quota(F.col("label"), n, shards), F.col("load")).otherwise(F.col("share")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label", "salt").orderBy(F.desc("n"), "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # shards x salts rows
    return cells.withColumn("before", before).join(F.broadcast(load.drop("load")), ["label", "salt"]).select("key", "label", F.greatest(F.lit(0), F.least("n", F.col("share") - F.col("before"))).alias("n")).where("n > 0")


def shard_rows(docs: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """docs with a column `key` whose equal values link rows; adds shard and slot.

    Counts differ by one at most; slots run from 0 without gaps in each shard.
    """
    base = C.stored(docs.withColumn("_row", F.monotonically_increasing_id()), "shard-base")
    n = base.count()
    if not n:
        return docs.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    start = base.groupBy(F.col(key).alias("key"), F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    start = start.withColumn("_all", F.sum("n").over(Window.partitionBy("key"))).where("_all > 1").drop("_all")
    kept = C.stored(_kept(propagate(C.stored(start, "shard-cells"), n, shards), n, shards), "shard-cells")
    # of a group, ranks 0.. go to its cells in order; ranks beyond them go to the pool
    ends = kept.withColumn("_end", F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("n"), "label"))).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_end", "label"))).alias("_cells"))
    ranked = C.dealt_rank(base.select("_row", F.col(key).alias("key")), ["key"], ["_row"], "_rank")
    lead = F.filter("_cells", lambda c: c["_end"] > F.col("_rank"))
    placed = C.stored(ranked.join(ends, "key", "left").select("_row", F.when(F.size(lead) > 0, lead[0]["label"]).alias("label")), "shard-places")
    held = {r["label"]: r["n"] for r in placed.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
    bounds, total = [], 0
    for s in range(shards):
        total += n // shards + (s < n % shards) - held.get(s, 0)
        bounds.append(total)
    rest = C.dealt_rank(placed.where("label is null").select("_row"), [], ["_row"], "_rank", salts=max(64, n >> 20))
    fill = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("_rank")))
    shard = placed.where("label is not null").select("_row", F.col("label").alias("shard")).unionByName(rest.select("_row", fill.alias("shard")))
    slots = C.dealt_rank(shard, ["shard"], ["_row"], "slot", salts=max(64, n >> 20))
    return base.join(slots, "_row").drop("_row")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = C.read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_text"))
    return shard_rows(docs, "_text").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
