"""Query registry: one named query per operator, with its SQL oracle."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mosaiq.plans import fixtures
from mosaiq.session import ensure_checkpoint_dir

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# key to deal by, rows that one task takes
_SPREAD = {
    ("px", "supplier"): ("s_suppkey", 500), ("px64_pair", "supplier"): ("s_suppkey", 100),
    ("curve", "embeddings"): ("vec_id", 5000), ("markup", "part"): ("p_partkey", 5000),
}


class Tables:
    """Base tables and fixture views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _register(self, name: str) -> None:
        text = fixtures.spark_text(name)
        for view in fixtures.needed(fixtures.VIEWS[name]):
            self(view).createOrReplaceTempView(view)
        for table in BASE_TABLES:
            if re.search(rf"(?i)\b(from|join)\s+{table}\b", text):
                df = self.base(table)
                if (name, table) in _SPREAD:
                    # each row grows into a raster, curve or document: spread the small file first, into more tasks the more rows it has
                    key, rows = _SPREAD[name, table]
                    df = df.repartition(max(self.spark.sparkContext.defaultParallelism, df.count() // rows), key)
                df.createOrReplaceTempView(table)

    def __call__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        self._register(name)
        return self.spark.sql(fixtures.spark_text(name))


def scratch(t: Tables, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder; it goes with the session."""
    ensure_checkpoint_dir(t.spark)
    sc = t.spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get(), f"{name}-{uuid.uuid4().hex}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional oracle."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = _with_views(sql)
        return fn

    return wrap


def _with_views(sql: str) -> str:
    sql = sql.strip()
    views = [f"{name} AS ({fixtures.duck_text(name).strip()})" for name in fixtures.needed(sql)]
    if not views:
        return sql
    match = re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", sql)
    recursive = bool(match and match[1])
    head = "WITH RECURSIVE " if recursive else "WITH "
    if match:
        return head + ",\n".join(views) + ",\n" + sql[match.end():]
    return head + ",\n".join(views) + "\n" + sql


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
