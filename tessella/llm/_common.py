"""What the corpus operators share: tables between stages, dealt-out ranks, Arrow helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.stages import planned_bytes, shared_dir, stored  # noqa: F401

def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions_for(spark: SparkSession, n_bytes: int, per: int = 32 << 20) -> int:
    """So many partitions that each has about `per` bytes; never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // per))


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """many joined with the row that `one` has for each key; the rows of a key are spread by a hash of `by`."""
    salt = F.pmod(F.xxhash64(F.lit("spread"), F.col(by)), F.lit(salts)).cast("int")
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", salt).join(copies, [key, "_salt"]).drop("_salt")


def dealt_rank(df: DataFrame, keys: list[str], order: list, name: str, salts: int = 64) -> DataFrame:
    """A gapless rank from 0 within `keys`, however large one key is.

    Rows are dealt to `salts` sub-groups of each key by a hash of the order
    columns; a rank counts within its sub-group, plus the sizes of the
    sub-groups before it.  The order is by (sub-group, order), so it is fixed
    by the rows but is no sort of the whole key.  Each use has a hash of its own
    (by name and keys), for rows that an earlier rank has put together share its salts.
    """
    seed = F.lit(f"{name}:{','.join(keys)}")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(seed, *order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_in", F.row_number().over(inner) - 1)
    on = [ranked[k].eqNullSafe(sizes[k]) for k in [*keys, "_salt"]]
    return ranked.join(sizes, on).select(*[ranked[c] for c in df.columns], (F.col("_before") + F.col("_in")).cast("long").alias(name))


_kept: dict = {}


def kept(name, make):
    """What a Python worker keeps from task to task: one thing at a time.

    Workers are used again by later stages, so whatever else was kept goes first;
    their memory has the bound of one cache and not of the sum of all.
    """
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null as nothing."""
    return [b"" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def column_texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
