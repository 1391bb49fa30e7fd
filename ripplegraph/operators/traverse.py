"""Bounded breadth-first path search, for many starts at once.

A search is a loop of joins of the frontier's last nodes with the edges. Paths come in the order of a first-in-first-out
search, which is by depth and then by the ordinals of their edges; parallel edges give repeated paths; no path meets a
node twice; at most `limit` paths are emitted for a start, and a start that reaches it is truncated and goes no further.
So a frontier has at most limit paths for each start, unless paths are emitted by a test (`emit`) and not all of them.

Each level is written to the shared folder, where its size is known: Spark broadcasts a small frontier to the edges and
shuffles a large one. Deep searches over few edges (both checked) are run whole in one Python task for each start instead,
with the edges broadcast, since a level's overhead would outweigh its work.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions import registry
from ripplegraph.functions.ids import has_kind, owner_method
from ripplegraph.sources.lineage import cut

DEFAULT_LIMIT = 100
DEEP, FEW_EDGES = 12, 200_000
SCHEMA = "seed string, ids array<string>, ords array<bigint>, depth int"


def edges_of(facts: DataFrame, relations, forward: bool = True) -> DataFrame:
    """src, dst, ord of visible facts of the relations."""
    a, b = ("source_identity_id", "target_identity_id") if forward else ("target_identity_id", "source_identity_id")
    return facts.where(F.col("relation_type").isin(*relations)).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("fact_ord").alias("ord"))


def _limit(limit: int) -> int:
    return limit if limit > 0 else DEFAULT_LIMIT


def search(edges: DataFrame, seeds: DataFrame, max_depth: int, limit: int = DEFAULT_LIMIT, emit=None) -> DataFrame:
    """Paths from seeds (column seed): seed, ids, ords, depth, rank, truncated (of the seed).

    emit: from the column of a path's last node to whether the path is emitted; others are only gone through. edges may
    have a column `seed`, and then an edge is only that seed's.
    """
    limit = _limit(limit)
    seeds = seeds.select("seed").distinct()
    if max_depth > DEEP and emit is None and "seed" not in edges.columns:
        edges = cut(edges, "edges")
        if edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
            return _ranked(_deep(edges, seeds, max_depth, limit), limit)
    elif max_depth > 2:
        edges = cut(edges, "edges")
    start = seeds.select("seed", F.array("seed").alias("ids"), F.array().cast("array<bigint>").alias("ords"), F.lit(0).alias("depth"))
    if max_depth <= 0:
        return _ranked(start.where("false"), limit)
    frontier, found, counts = start, None, None
    for depth in range(1, max_depth + 1):
        on = F.element_at("ids", -1) == F.col("e.src")
        if "seed" in edges.columns:
            on = on & F.col("f.seed").eqNullSafe(F.coalesce("e.seed", "f.seed"))
        step = frontier.alias("f").join(edges.alias("e"), on).where(~F.array_contains("f.ids", F.col("e.dst")))
        step = step.select("f.seed", F.concat("f.ids", F.array("e.dst")).alias("ids"), F.concat("f.ords", F.array("e.ord")).alias("ords"), F.lit(depth).alias("depth"))
        if emit is not None:
            step = cut(step, "frontier")
            out = step.where(emit(F.element_at("ids", -1)))
        else:
            out = step
        # a plain limit on the rank lets Spark cut each group before it is dealt and sorted
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("ords"))).where(F.col("rank") <= limit)
        if counts is not None:
            out = out.join(counts, "seed", "left").withColumn("rank", F.col("rank") + F.coalesce("had", F.lit(0))).where(F.col("rank") <= limit).drop("had")
        out = cut(out, "paths")
        found = out if found is None else found.unionByName(out)
        if depth == max_depth:
            break
        counts = cut(found.groupBy("seed").agg(F.count("*").alias("had")), "counts")
        full = counts.where(F.col("had") >= limit).select("seed")
        frontier = (step if emit is not None else out.drop("rank")).join(full, "seed", "left_anti")
        if frontier.limit(1).count() == 0:
            break
    return _ranked(found, limit)


def _ranked(paths: DataFrame, limit: int) -> DataFrame:
    if "rank" not in paths.columns:
        paths = paths.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "ords")))
    n = F.count("*").over(Window.partitionBy("seed"))
    return paths.withColumn("truncated", n >= limit)


def _deep(edges: DataFrame, seeds: DataFrame, max_depth: int, limit: int) -> DataFrame:
    """The whole search of each seed in a task; edges are few (the caller checked)."""
    held = edges.sparkSession.sparkContext.broadcast([tuple(r) for r in edges.select("src", "dst", "ord").collect()])

    def run(batches):
        near: dict = {}
        for src, dst, ord_ in sorted(held.value, key=lambda e: e[2]):
            near.setdefault(src, []).append((dst, ord_))
        for b in batches:
            for seed in b.column(0).to_pylist():
                out, queue = [], deque([((seed,), ())])
                while queue and len(out) < limit:
                    ids, ords = queue.popleft()
                    if len(ords) >= max_depth:
                        continue
                    for dst, ord_ in near.get(ids[-1], ()):
                        if dst not in ids:
                            queue.append(((*ids, dst), (*ords, ord_)))
                            out.append(queue[-1])
                            if len(out) >= limit:
                                break
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seed] * len(out), pa.string()), pa.array([x[0] for x in out], pa.list_(pa.string())), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([len(x[1]) for x in out], pa.int32())],
                    ["seed", "ids", "ords", "depth"],
                )

    return seeds.mapInArrow(run, SCHEMA)


def seeds_of(facts: DataFrame, ids) -> DataFrame:
    return facts.sparkSession.createDataFrame([(x,) for x in ids], "seed string")


# --- the traversals ---


def find_callers(facts: DataFrame, seeds: DataFrame, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return search(edges_of(facts, registry.CALL_EDGES, forward=False), seeds, max_depth, limit)


def find_downstream(facts: DataFrame, seeds: DataFrame, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return search(edges_of(facts, registry.DOWNSTREAM_EDGES), seeds, max_depth, limit)


def find_backend_flows(facts: DataFrame, seeds: DataFrame, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Downstream paths that end at the backend; the limit counts before this test, and so does truncation."""
    return find_downstream(facts, seeds, max_depth, limit).where(has_kind(F.element_at("ids", -1), registry.BACKEND_SINKS))


def paths_between(facts: DataFrame, seeds: DataFrame, target: str, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return find_downstream(facts, seeds, max_depth, limit).where(F.element_at("ids", -1) == target)


def find_entrypoints(facts: DataFrame, seeds: DataFrame, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Paths against the downstream edges that end at an endpoint, action or page."""
    found = search(edges_of(facts, registry.DOWNSTREAM_EDGES, forward=False), seeds, max_depth, limit)
    return found.where(has_kind(F.element_at("ids", -1), ("api-endpoint", "action-path", "html-page", "jsp-page", "entrypoint")))


def one_hop(facts: DataFrame, node: str, forward: bool = True) -> DataFrame:
    """ord, id: the callees or callers of a node in fact order."""
    e = edges_of(facts, registry.CALL_EDGES, forward)
    return e.where(F.col("src") == node).select("ord", F.col("dst").alias("id"))


def adjacency(facts: DataFrame, forward: bool = True) -> DataFrame:
    """src and its neighbours in fact order."""
    e = edges_of(facts, registry.CALL_EDGES, forward)
    return e.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("neighbours"))


def capped(edges: DataFrame, fan_out: int) -> DataFrame:
    """The first fan_out edges of each node."""
    return edges.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("ord"))).where(F.col("n") <= fan_out).drop("n")


# --- variable traces ---

PHASE = 10**15  # larger than any fact_ord: edge lists are gone through by phase, then by fact


def trace_sources(facts: DataFrame, seeds: DataFrame, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return search(edges_of(facts, registry.TRACE_EDGES, forward=False), seeds, max_depth, limit)


def sink_edges(facts: DataFrame, seeds: DataFrame) -> DataFrame:
    """src, dst, ord, seed (null: of all seeds): flow edges, those from a method's slots to its statements, what statements
    reach, and those from a start slot to its method's statements, in this order."""
    base = edges_of(facts, registry.TRACE_EDGES)
    binds = edges_of(facts, ("BINDS_TO",)).where(F.col("src").startswith("method://"))
    fan = edges_of(facts, ("HAS_PARAM", "READS_TABLE", "WRITES_TABLE"))
    any_seed = F.lit(None).cast("string").alias("seed")
    slots = base.select("src").distinct().withColumn("owner", owner_method(F.col("src"))).where("owner <> ''")
    derived = slots.join(binds.select(F.col("src").alias("owner"), "dst", "ord"), "owner").select("src", "dst", (F.col("ord") + PHASE).alias("ord"), any_seed)
    own = seeds.select("seed").distinct().withColumn("owner", owner_method(F.col("seed"))).where("owner <> ''")
    first = own.join(binds.select(F.col("src").alias("owner"), "dst", "ord"), "owner").select(F.col("seed").alias("src"), "dst", (F.col("ord") + 3 * PHASE).alias("ord"), "seed")
    return base.select("src", "dst", "ord", any_seed).unionByName(derived).unionByName(fan.select("src", "dst", (F.col("ord") + 2 * PHASE).alias("ord"), any_seed)).unionByName(first)


def trace_sinks(facts: DataFrame, seeds: DataFrame, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Paths that end at a sink; the search goes on through sinks."""
    return search(sink_edges(facts, seeds), seeds, max_depth, limit, emit=lambda end: has_kind(end, registry.TRACE_SINKS))


def trace_combined(facts: DataFrame, seeds: DataFrame, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Sources, then sinks (column side); each side has its own limit, and a start is truncated if either is."""
    a = trace_sources(facts, seeds, max_depth, limit).withColumn("side", F.lit("source"))
    b = trace_sinks(facts, seeds, max_depth, limit).withColumn("side", F.lit("sink"))
    return a.unionByName(b).withColumn("truncated", F.bool_or("truncated").over(Window.partitionBy("seed")))


def emitted_key(ids: Column) -> Column:
    return F.array_join(ids, ">")


class AdjacencyCache:
    """Call edges kept by project, snapshot and scope; a scope is (type, key), and the project's own covers all."""

    PROJECT = ("PROJECT", "")

    def __init__(self):
        self._held: dict[tuple, DataFrame] = {}

    def rebuild(self, facts: DataFrame, project: str, snapshot: str, scope: tuple[str, str] = PROJECT) -> DataFrame:
        self.drop(project, snapshot, scope)
        f = facts
        if scope != self.PROJECT:
            both = F.concat("source_identity_id", F.lit("\n"), "target_identity_id")
            f = f.where(both.contains(f"/{scope[1]}/") | both.contains(f"/{scope[1]}#"))
        df = f.where(F.col("relation_type").isin(*registry.CALL_EDGES)).persist()
        self._held[project, snapshot, scope] = df
        return df

    def get(self, project: str, snapshot: str, scope: tuple[str, str] = PROJECT) -> DataFrame | None:
        return self._held.get((project, snapshot, scope))

    def drop(self, project: str, snapshot: str, scope: tuple[str, str]) -> None:
        old = self._held.pop((project, snapshot, scope), None)
        if old is not None:
            old.unpersist()

    @classmethod
    def covers(cls, a: tuple[str, str], b: tuple[str, str]) -> bool:
        return a == cls.PROJECT or a == b

    def invalidate(self, project: str, snapshot: str, scope: tuple[str, str] = PROJECT) -> int:
        """Drops what the scope covers or is covered by."""
        gone = [k for k in self._held if k[:2] == (project, snapshot) and (self.covers(k[2], scope) or self.covers(scope, k[2]))]
        for k in gone:
            self.drop(*k)
        return len(gone)

    def find_callers(self, facts: DataFrame, project: str, snapshot: str, seeds: DataFrame, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
        held = self.get(project, snapshot)
        return find_callers(facts if held is None else held, seeds, max_depth, limit)
