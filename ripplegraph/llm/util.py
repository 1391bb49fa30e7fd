"""Shared pieces of the training-data operators: table access, batches and components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ripplegraph.sources.lineage import cut, fresh_path

__all__ = ["by_group", "components", "cut", "fresh_path", "small_batches", "table"]


#: Rows of texts that go to Python at once. Spark's own 10,000 would hold over a gigabyte of long texts.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session's limits on batches to Python are brought down to these, where they are higher."""
    conf = df.sparkSession.conf
    for key, wanted in _LIMITS.items():
        now = conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= wanted:
            conf.set(key, str(wanted))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: columns a, b (comparable, not null), any number of repeats and loops. Returns node, component, with the
    smallest reachable node as component, for each node of an edge between two different nodes. Edges never meet in
    one task by component: each round only takes a minimum per node, which combines on the map side, and joins it back.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "large-star")
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct(), "small-star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    low = e.select(F.col("v").alias("u"), "v").unionByName(e)
    return low.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component"))


def by_group(f, ddl: str):
    """For applyInArrow: f takes the key and the batches of each side, and yields batches of ddl's columns."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def whole(key, *sides):
        return pa.Table.from_batches([b.cast(schema) for b in f(key, *[t.to_batches() for t in sides])], schema)

    def one(key, table):
        return whole(key, table)

    def two(key, left, right):
        return whole(key, left, right)

    return one if f.__code__.co_argcount == 2 else two
