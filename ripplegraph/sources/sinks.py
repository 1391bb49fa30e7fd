"""Sinks: pages of results, graph-database statements, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.functions import registry
from ripplegraph.functions.text import snake_case
from ripplegraph.sources.lineage import cut

PREFIX = "ripplegraph"
PAGE_LIMIT = 100
NODE, FACT = "GraphNode", "GRAPH_FACT"


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page in a stated order; a page has at most 100 rows."""
    if offset < 0 or limit < 0 or limit > PAGE_LIMIT:
        raise ValueError("offset and limit are 0 or more, limit at most 100")
    return df.orderBy(*order).offset(offset).limit(limit)


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `place`, 1 and on in a stated order: sorted by ranges, whose sizes give each range its first place. No task sees all."""
    cols = df.columns
    done = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "placed")  # range in the high bits, row in the low 33
    of = F.shiftright(F.col("__at"), 33)
    sizes = done.groupBy(of.alias("__range")).agg(F.count("*").alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))  # a row a range
    held = done.withColumn("__range", of).join(F.broadcast(before), "__range")
    return held.select(*cols, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


def index_statements() -> list[str]:
    found = {
        "node_project_snapshot": (f"(n:{NODE})", "n.projectId, n.snapshotId"),
        "node_kind": (f"(n:{NODE})", "n.kind"),
        "fact_active_scope": (f"()-[r:{FACT}]-()", "r.projectId, r.snapshotId, r.relationType, r.active"),
    }
    return [f"CREATE INDEX {PREFIX}_{name} IF NOT EXISTS FOR {at} ON ({what})" for name, (at, what) in found.items()]


def graph_ddl(spark: SparkSession) -> DataFrame:
    """A uniqueness constraint for each node label, and the indexes."""
    n = registry.node_types(spark)
    name = F.concat_ws("_", F.lit(PREFIX), snake_case(F.col("label")), snake_case(F.col("identity_property")), F.lit("snapshot_id"))
    made = n.select(F.format_string("CREATE CONSTRAINT %s IF NOT EXISTS FOR (n:%s) REQUIRE (n.%s, n.snapshotId) IS UNIQUE", name, "label", "identity_property").alias("statement"))
    return made.unionByName(spark.createDataFrame([(x,) for x in index_statements()], "statement string"))


def node_statements(spark: SparkSession) -> DataFrame:
    """label, merge, find: parameterised statements for each label."""
    n = registry.node_types(spark)
    at = F.format_string(f"(n:{NODE}:%s {{%s: $%s, snapshotId: $snapshotId}})", "label", "identity_property", "identity_property")
    return n.select("label", F.concat(F.lit("MERGE "), at, F.lit(" SET n.projectId = $projectId, n.kind = $kind")).alias("merge"), F.concat(F.lit("MATCH "), at, F.lit(" WHERE n.projectId = $projectId RETURN n")).alias("find"))


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """What the constraints forbid: (id, snapshot_id) that occur more than once."""
    return nodes.groupBy("id", "snapshot_id").agg(F.count("*").alias("n")).where("n > 1")


def write_csv(df: DataFrame, path: str) -> None:
    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_edges(edges: DataFrame, path: str, buckets: int = 64) -> None:
    """Two copies, clustered by source and by target, so that one-hop scans either way prune files."""
    for name, key in (("by_source", "source_identity_id"), ("by_target", "target_identity_id")):
        edges.repartitionByRange(buckets, key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")
