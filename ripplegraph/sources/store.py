"""The fact store: scans, and mutations as functions from tables to tables, with a Parquet store about them.

Facts are Parquet, partitioned by project and snapshot, so scans of a snapshot prune the rest and equality predicates on
relation, source and target reach the files. A mutation writes the partitions of its snapshots anew under a version of their
own and then moves the store's pointer, a small file that names the live partitions: readers see all of a commit or none,
a failure on the way leaves the store as it was, and a partition without rows is simply not named any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ripplegraph.functions import registry
from ripplegraph.functions.ids import fact_key, kind_of
from ripplegraph.sources.lineage import cut

OWNER = ("project_id", "snapshot_id", "analyzer_id", "scope_key")
UPSERT_KEY = ("fact_key", *OWNER)
WARN_FACTS, REJECT_FACTS = 500_000, 5_000_000  # fixed values of the sizing advice
EDGE_COLUMNS = ("fact_key", "source_identity_id", "target_identity_id", "relation_type", "relation_family", "qualifier", "project_id", "snapshot_id", "evidence_key", "confidence")


def visible() -> Column:
    return F.col("active") & ~F.col("tombstone")


# --- scans ---


def active_facts(facts: DataFrame, project: str, snapshot: str) -> DataFrame:
    return facts.where((F.col("project_id") == project) & (F.col("snapshot_id") == snapshot) & visible())


def by_relation(facts: DataFrame, project: str, snapshot: str, relation: str) -> DataFrame:
    return active_facts(facts, project, snapshot).where(F.col("relation_type") == relation)


def by_source(facts: DataFrame, project: str, snapshot: str, source: str) -> DataFrame:
    return active_facts(facts, project, snapshot).where(F.col("source_identity_id") == source)


def by_target(facts: DataFrame, project: str, snapshot: str, target: str) -> DataFrame:
    return active_facts(facts, project, snapshot).where(F.col("target_identity_id") == target)


def active_count(facts: DataFrame, project: str) -> DataFrame:
    return facts.where((F.col("project_id") == project) & visible()).agg(F.count("*").alias("n"))


def active_snapshots(facts: DataFrame, project: str) -> DataFrame:
    """Snapshots in first-seen order (column first_ord)."""
    return facts.where((F.col("project_id") == project) & visible()).groupBy("snapshot_id").agg(F.min("fact_ord").alias("first_ord"))


def materialized_edges(facts: DataFrame, strict: bool = False) -> DataFrame:
    """Visible facts as edges. strict: an invisible row is an error."""
    df = facts
    if strict:
        ok = F.when(visible(), F.col("fact_key")).otherwise(F.raise_error(F.lit("only active facts can be edges")))
        df = df.withColumn("fact_key", ok)
    else:
        df = df.where(visible())
    return df.select(*EDGE_COLUMNS)


def interval_visible(facts: DataFrame, snapshots: DataFrame, project: str, snapshot: str) -> DataFrame:
    """Facts valid at a snapshot by their interval. snapshots: snapshot_id, snapshot_ord."""
    at = snapshots.where(F.col("snapshot_id") == snapshot).select(F.col("snapshot_ord").alias("at"))
    start = snapshots.select(F.col("snapshot_id").alias("valid_from_snapshot"), F.col("snapshot_ord").alias("from_ord"))
    end = snapshots.select(F.col("snapshot_id").alias("valid_to_snapshot"), F.col("snapshot_ord").alias("to_ord"))
    df = facts.where((F.col("project_id") == project) & visible())
    df = df.join(F.broadcast(start), "valid_from_snapshot").join(F.broadcast(end), "valid_to_snapshot", "left")  # one row a snapshot
    return df.join(F.broadcast(at), (F.col("from_ord") <= F.col("at")) & (F.col("to_ord").isNull() | (F.col("to_ord") > F.col("at")))).drop("at", "from_ord", "to_ord")


# --- mutations ---


def append(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """No row is merged. New rows come after all others; ord within the batch is kept."""
    return facts.unionByName(_after(facts, batch))


def _after(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """batch with ordinals after those of facts, in its own order."""
    last = facts.agg(F.coalesce(F.max("fact_ord"), F.lit(0)).alias("last"))
    return batch.crossJoin(F.broadcast(last)).withColumn("fact_ord", F.col("last") + 1 + F.col("fact_ord")).drop("last")


def upsert(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch replace those of the same key and owner; repeats within the batch all stay."""
    keys = batch.select(*UPSERT_KEY).distinct()
    return facts.join(keys, list(UPSERT_KEY), "left_anti").unionByName(_after(facts, batch))


def replace_scope(facts: DataFrame, batch: DataFrame, owner: dict[str, str], family: str | None = None) -> DataFrame:
    """An owner's new state: its facts that the batch doesn't repeat become tombstones, then each row of the batch replaces what
    has its own key, project, snapshot, analyzer and scope, whoever the owner is.

    The owner is project, snapshot, analyzer and scope; family narrows it to a relation family. The batch's rows aren't
    checked to belong to the owner.
    """
    mine = F.lit(True)
    for k in OWNER:
        mine = mine & (F.col(k) == owner[k])
    if family:
        mine = mine & (F.col("relation_family") == family)
    keys = batch.select("fact_key").distinct().withColumn("__again", F.lit(True))
    df = facts.join(keys, "fact_key", "left")
    df = df.withColumn("tombstone", F.col("tombstone") | (mine & F.col("__again").isNull())).select(*facts.columns)
    own = batch.select(*UPSERT_KEY).distinct()
    return df.join(own, list(UPSERT_KEY), "left_anti").select(*facts.columns).unionByName(_after(facts, batch))


def purge_tombstones(facts: DataFrame, project: str, snapshot: str) -> DataFrame:
    return facts.where(~((F.col("project_id") == project) & (F.col("snapshot_id") == snapshot) & F.col("tombstone")))


def delete_project(facts: DataFrame, project: str) -> DataFrame:
    return facts.where(F.col("project_id") != project)


def snapshot_diff(facts: DataFrame, project: str, old: str, new: str, value: str = "confidence") -> DataFrame:
    """fact_key, change: added, removed or changed (its smallest `value` differs) between two snapshots."""
    side = lambda s, name: active_facts(facts, project, s).groupBy("fact_key").agg(F.min(value).alias(name))
    both = side(old, "a").join(side(new, "b"), "fact_key", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("fact_key", change.alias("change")).where("change is not null")


def distinct_families(batch: DataFrame) -> DataFrame:
    return batch.groupBy("project_id", "snapshot_id").agg(F.sort_array(F.collect_set("relation_family")).alias("families"), F.count_if(visible()).alias("n_active"))


def size_advice(n: Column) -> Column:
    return F.when(n >= REJECT_FACTS, "REJECT").when(n >= WARN_FACTS, "SWITCH_RECOMMENDED").otherwise("OK")


def fact_errors(facts: DataFrame) -> DataFrame:
    """fact_ord and the names of the broken rules of a fact, for those that break any."""
    c = F.col
    known = F.create_map(*[F.lit(x) for kv in registry.FAMILY.items() for x in kv])
    rules = {
        "key": c("fact_key") != fact_key(c("source_identity_id"), c("target_identity_id"), c("relation_type"), c("qualifier")),
        "relation": ~c("relation_type").isin(*registry.FAMILY),
        "family": F.try_element_at(known, c("relation_type")) != c("relation_family"),
        "source_project": F.get(F.split(c("source_identity_id"), "/"), 2) != c("project_id"),
        "target_project": F.get(F.split(c("target_identity_id"), "/"), 2) != c("project_id"),
        "confidence": ~c("confidence").isin(*registry.CONFIDENCE),
        "source_type": ~c("source_type").isin(*registry.SOURCE_TYPES),
        "schema_version": c("schema_version") <= 0,
        "priority": c("priority") < 0,
        "kind": ~kind_of(c("target_identity_id")).isin(*registry.IDENTITY_TYPE),
        "ai_family": (c("source_type") == "AI_ASSISTED") != (c("relation_family") == "AI_ASSISTED_CANDIDATE"),
        "ai_certain": (c("source_type") == "AI_ASSISTED") & (c("confidence") == "CERTAIN"),
    }
    for k in ("project_id", "snapshot_id", "analysis_run_id", "scope_run_id", "analyzer_id", "scope_key", "evidence_key"):
        rules[k] = F.coalesce(F.trim(c(k)), F.lit("")) == ""
    errors = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules.items()]))
    return facts.select("fact_ord", errors.alias("errors")).where(F.size("errors") > 0)


class FactStore:
    """Facts in Parquet under a path, by project and snapshot. Listeners hear of what a commit changed.

    A commit fails if another one was made since it began to read.
    """

    def __init__(self, spark: SparkSession, path: str, reject: int | None = None):
        self.spark, self.path, self.reject = spark, path.rstrip("/"), reject
        self.listeners: list[Callable[[dict], None]] = []

    # pointers: numbered files, the last one counts

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _listed(self, path: str) -> list[str]:
        system, at = self._fs(path)
        return [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []

    def _last(self) -> int:
        return max((int(x[: -len(".json")]) for x in self._listed(f"{self.path}/pointers") if x.endswith(".json")), default=0)

    def _pointer(self) -> dict:
        """number, schema and live: [project, snapshot, folder] of each live partition."""
        n = self._last()
        if not n:
            return {"number": 0, "schema": None, "live": []}
        system, at = self._fs(f"{self.path}/pointers/{n}.json")
        stream = system.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _point(self, old: dict, schema: StructType, live: list[list[str]]) -> None:
        n = old["number"] + 1
        system, at = self._fs(f"{self.path}/pointers/{n}.json")
        _, temporary = self._fs(f"{self.path}/pointers/.{uuid.uuid4().hex}")
        out = system.create(temporary, False)
        out.write(bytearray(json.dumps({"number": n, "schema": json.loads(schema.json()), "live": live}).encode()))
        out.close()
        if self._last() >= n or not system.rename(temporary, at):
            system.delete(temporary, False)
            raise RuntimeError("the store was changed by another commit")

    def facts(self) -> DataFrame:
        return self._read(self._pointer())

    def _read(self, pointer: dict, only: set[tuple[str, str]] | None = None) -> DataFrame:
        if pointer["schema"] is None:
            raise ValueError(f"the store at {self.path} has no facts yet")
        schema = StructType.fromJson(pointer["schema"])
        live = [x for p, s, x in pointer["live"] if only is None or (p, s) in only]
        if not live:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(StructType(schema.fields).add("version", "string")).option("basePath", f"{self.path}/facts")
        return read.parquet(*[f"{self.path}/facts/{x}" for x in live]).select(*schema.names)

    def _commit(self, old: dict, df: DataFrame, gone: set[tuple[str, str]] = frozenset()) -> None:
        """df's rows become live beside what the old pointer names, less the partitions that are gone."""
        version = f"version={uuid.uuid4().hex}"
        made = df.select("project_id", "snapshot_id").distinct()
        df.write.partitionBy("project_id", "snapshot_id").parquet(f"{self.path}/facts/{version}")
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        there = {f"{p}/{s}" for p in self._listed(f"{self.path}/facts/{version}") if "=" in p for s in self._listed(f"{self.path}/facts/{version}/{p}")}
        live = [x for x in old["live"] if (x[0], x[1]) not in gone]
        for r in made.collect():  # a row a snapshot
            folder = f"project_id={escape(r.project_id)}/snapshot_id={escape(r.snapshot_id)}"
            if folder in there:
                live.append([r.project_id, r.snapshot_id, f"{version}/{folder}"])
        self._point(old, df.schema, live)

    def vacuum(self) -> int:
        """Deletes versions that no live partition is in, and old pointers; for when no reader is on them. Returns how many versions."""
        pointer = self._pointer()
        used = {x[2].partition("/")[0] for x in pointer["live"]}
        old = [f"facts/{x}" for x in self._listed(f"{self.path}/facts") if x.startswith("version=") and x not in used]
        for x in [*old, *(f"pointers/{k}.json" for k in range(1, pointer["number"]))]:
            system, at = self._fs(f"{self.path}/{x}")
            system.delete(at, True)
        return len(old)

    # commits

    def append(self, batch: DataFrame) -> None:
        old = self._pointer()
        self._guard(old, batch)
        self._commit(old, _after(self._read(old), batch).select(*batch.columns) if old["schema"] else batch)
        self._tell(batch)

    def _guard(self, old: dict, batch: DataFrame) -> None:
        """No project of the batch may come to hold `reject` visible facts or more."""
        if self.reject is None:
            return
        new = batch.groupBy("project_id").agg(F.count("*").alias("n"))
        if old["schema"]:
            new = new.unionByName(self._read(old).where(visible()).groupBy("project_id").agg(F.count("*").alias("n")).join(new.select("project_id"), "project_id", "left_semi"))
        for r in new.groupBy("project_id").agg(F.sum("n").alias("n")).where(F.col("n") >= self.reject).collect():  # a row a project of the batch
            raise ValueError(f"{r.n} facts are too many for project {r.project_id}")

    def _touched(self, old: dict, batch: DataFrame, *more: tuple[str, str]) -> tuple[set[tuple[str, str]], DataFrame]:
        keys = {(r.project_id, r.snapshot_id) for r in batch.select("project_id", "snapshot_id").distinct().collect()} | set(more)  # a row a snapshot of the batch
        return keys, self._read(old, keys) if old["schema"] else batch.limit(0)

    def upsert(self, batch: DataFrame) -> None:
        old = self._pointer()
        self._guard(old, batch)
        keys, own = self._touched(old, batch)
        self._commit(old, cut(upsert(own, batch), "store"), keys)
        self._tell(batch)

    def replace_scope(self, batch: DataFrame, owner: dict[str, str], family: str | None = None) -> None:
        old = self._pointer()
        self._guard(old, batch)
        keys, own = self._touched(old, batch, (owner["project_id"], owner["snapshot_id"]))
        self._commit(old, cut(replace_scope(own, batch, owner, family), "store"), keys)
        self._tell(batch)

    def purge_tombstones(self, project: str, snapshot: str) -> int:
        old = self._pointer()
        own = self._read(old, {(project, snapshot)})
        n = own.where("tombstone").count()
        if n:
            self._commit(old, cut(purge_tombstones(own, project, snapshot), "store"), {(project, snapshot)})
        return n

    def delete_project(self, project: str) -> int:
        """Returns how many facts went."""
        old = self._pointer()
        n = self._read(old, {(p, s) for p, s, _ in old["live"] if p == project}).count()
        self._point(old, StructType.fromJson(old["schema"]), [x for x in old["live"] if x[0] != project])
        return n

    def _tell(self, batch: DataFrame) -> None:
        """An empty batch tells nothing, even if it made tombstones."""
        if self.listeners:
            for r in distinct_families(batch).collect():  # a row a snapshot of the batch
                for listener in self.listeners:
                    listener(r.asDict())
