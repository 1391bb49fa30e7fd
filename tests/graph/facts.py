from pyspark.sql import functions as F

from ripplegraph.functions.ids import fact_key
from ripplegraph.functions.registry import FAMILY

SCHEMA = "fact_ord long, source_identity_id string, target_identity_id string, relation_type string, qualifier string, active boolean, tombstone boolean, snapshot_id string, analyzer_id string, confidence string"


def facts(spark, edges, **fixed):
    """edges: (source, target, relation[, dict of columns])."""
    rows = []
    for k, (s, t, r, *more) in enumerate(edges):
        row = {"qualifier": "direct", "active": True, "tombstone": False, "snapshot_id": "snapshot-1", "analyzer_id": "spoon", "confidence": "CERTAIN"} | fixed | (more[0] if more else {})
        rows.append((k, s, t, r, row["qualifier"], row["active"], row["tombstone"], row["snapshot_id"], row["analyzer_id"], row["confidence"]))
    known = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    c = F.col
    return spark.createDataFrame(rows, SCHEMA).withColumns(
        {
            "fact_key": fact_key(c("source_identity_id"), c("target_identity_id"), c("relation_type"), c("qualifier")),
            "relation_family": F.try_element_at(known, c("relation_type")),
            **{k: F.lit(v) for k, v in {"project_id": "shop", "scope_key": "src/main/java", "analysis_run_id": "analysis-1", "scope_run_id": "scope-1", "evidence_key": "evidence-1", "source_type": "SPOON", "priority": 100, "schema_version": 1}.items()},
        }
    )


def seeds(spark, *ids):
    return spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "seed string, seed_ord int")


def paths(df):
    return ["/".join(x.ids) for x in sorted(df.collect(), key=lambda x: (x.seed, x["rank"]))]
