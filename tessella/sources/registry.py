"""Data sets by name: a loader returns tiles and queries as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.manifests import load_tiles_queries

Loader = Callable[..., tuple[DataFrame, DataFrame]]
_LOADERS: dict[str, Loader] = {}


def loader(name: str) -> Callable[[Loader], Loader]:
    def put(f: Loader) -> Loader:
        _LOADERS[name] = f
        return f

    return put


@loader("cvgl")
def manifests(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame]:
    if not root:
        raise ValueError("a manifest data set needs its root")
    return load_tiles_queries(spark, root, split)


@loader("parquet")
def parquet(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame]:
    """Tables converted beforehand, such as those of MATLAB structures or pickled arrays."""
    return spark.read.parquet(f"{root}/tiles_{split}"), spark.read.parquet(f"{root}/queries_{split}")


def load(name: str, spark: SparkSession, **options) -> tuple[DataFrame, DataFrame]:
    if name not in _LOADERS:
        raise ValueError(f"no data set {name!r}; there are {', '.join(sorted(_LOADERS))}")
    return _LOADERS[name](spark, **options)
