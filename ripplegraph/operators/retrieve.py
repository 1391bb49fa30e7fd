"""Retrieval: vector and exact search, their hybrid, evidence packs, recall and candidate relations.

Documents: id, project_id, snapshot_id, title, body, embedding, ord (of insertion). Queries are single texts or vectors, so
scores are columns and a top-k is a bounded heap in each task; nothing is joined but bounded result lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions import registry
from ripplegraph.functions.ids import short_hash
from ripplegraph.functions.text import contains_exact, cosine, overlap, redact, token_embedding
from ripplegraph.sources.lineage import cut


def latest(documents: DataFrame) -> DataFrame:
    """The last write of each id; its place in the order is that of the first."""
    last = documents.groupBy("id").agg(F.max_by(F.struct(*[c for c in documents.columns if c not in ("id", "ord")]), "ord").alias("d"), F.min("ord").alias("ord"))
    return last.select("id", "d.*", "ord")


def vector_search(documents: DataFrame, query: Column, project: str, snapshot: str, k: int) -> DataFrame:
    """id, title, score, ord of the k nearest by cosine; ties by order."""
    own = documents.where((F.col("project_id") == project) & (F.col("snapshot_id") == snapshot))
    return own.select("id", "title", cosine(F.col("embedding"), query).alias("score"), "ord").orderBy(F.desc("score"), "ord").limit(k)


def exact_search(documents: DataFrame, query: str, project: str, snapshot: str) -> DataFrame:
    own = documents.where((F.col("project_id") == project) & (F.col("snapshot_id") == snapshot))
    return own.where(contains_exact(F.col("title"), query) | contains_exact(F.col("body"), query)).select("id", "title", F.lit(1.0).alias("score"), "ord")


def hybrid_search(documents: DataFrame, query: str, project: str, snapshot: str, k: int, dimensions: int = 64, expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, title, score, source of the k best of exact and vector hits and of what their seeds expand to.

    expand: from seeds (id, title, score, source, place) to rows seed_place, ord, id, title, score. Seeds are expanded in
    their order while fewer than 2k results are merged; an expansion isn't expanded. Of an id's scores the best counts,
    of equal ones the earlier.
    """
    exact = exact_search(documents, query, project, snapshot).select("id", "title", "score", F.lit("exact").alias("source"), F.lit(0).alias("phase"), "ord")
    # only the first 2k of the order can stay among the k best at the same score, or start an expansion
    exact = exact.orderBy("ord").limit(2 * k + 1) if expand is None else exact
    near = vector_search(documents, token_embedding(F.lit(query), dimensions), project, snapshot, k)
    near = near.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "ord")))  # k rows
    both = exact.unionByName(near.select("id", "title", "score", F.lit("vector").alias("source"), F.lit(1).alias("phase"), "ord"))
    order = F.struct(F.col("phase"), F.col("ord"))
    best = F.min_by(F.struct("title", "score", "source"), F.struct(-F.col("score"), F.col("phase"), F.col("ord")))
    merged = both.groupBy("id").agg(best.alias("b"), F.min(order).alias("first")).select("id", "b.*", "first")
    if expand is None:
        return merged.orderBy(F.desc("score"), "first").limit(k).drop("first")
    seeds = merged.orderBy("first").limit(2 * k)
    seeds = cut(seeds.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first"))), "seeds")  # 2k rows
    n = merged.count()
    if n >= 2 * k:
        return merged.orderBy(F.desc("score"), "first").limit(k).drop("first")
    more = expand(seeds.drop("first")).select("seed_place", "ord", "id", "title", "score")
    new = more.join(seeds.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("seed_place", "ord")).alias("at"))
    # a seed is expanded while what stands before it has brought fewer than 2k results
    brought = new.groupBy(F.col("at.seed_place").alias("seed_place")).agg(F.count("*").alias("n"))
    before = seeds.select("place").join(brought, F.col("place") == F.col("seed_place"), "left").select("place", (F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))).alias("had"))
    open_ = before.where(F.coalesce("had", F.lit(0)) + n < 2 * k).select(F.col("place").alias("seed_place"))
    grown = more.join(open_, "seed_place", "left_semi").select("id", "title", "score", F.lit("graph").alias("source"), (F.col("seed_place") + 1).alias("phase"), F.col("ord").cast("int").alias("ord"))
    base = seeds.select("id", "title", "score", "source", F.lit(0).alias("phase"), F.col("place").alias("ord"))
    whole = base.unionByName(grown).groupBy("id").agg(best.alias("b"), F.min(order).alias("first")).select("id", "b.*", "first")
    return whole.orderBy(F.desc("score"), "first").limit(k).drop("first")


def evidence_pack(snippets: DataFrame, project: str, snapshot: str, budget: int) -> DataFrame:
    """One row: id, evidence_paths, snippets, truncated. The snippets (path, line_start, snippet, ord) are redacted and taken in
    order until one would exceed the budget of characters; running sums are by parts of the order, so only the part
    in which the budget ends is gone through in one task."""
    s = snippets.withColumn("snippet", redact(F.col("snippet"))).withColumn("n", F.char_length("snippet"))
    s = cut(s.where("ord is not null"), "evidence")
    part = F.floor(F.col("ord") / F.lit(1024))
    sums = s.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("n").over(Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("part", part).join(before.where(F.col("before") <= budget), "part").withColumn("used", F.col("before") + own)
    kept = s.where(F.col("used") <= budget)
    whole = F.sort_array(F.collect_list(F.struct("ord", "path", "line_start", "snippet")))
    n = snippets.where("ord is not null").agg(F.count("*").alias("n_all"))
    one = kept.agg(whole.alias("k")).crossJoin(n)  # two one-row tables
    paths = F.transform("k", lambda x: F.concat(x["path"], F.lit(":"), x["line_start"].cast("string")))
    out = one.select(paths.alias("evidence_paths"), F.transform("k", lambda x: x["snippet"]).alias("snippets"), (F.size("k") < F.col("n_all")).alias("truncated"))
    named = F.concat(F.lit(f"{project}|{snapshot}|["), F.array_join("evidence_paths", ", "), F.lit("]"))
    return out.select(F.concat(F.lit("ep-"), short_hash(named)).alias("id"), "evidence_paths", "snippets", "truncated")


def recall(items: DataFrame, query: str, k: int) -> DataFrame:
    """The k of items (id, text, created_at) that share most tokens with the query; of equal ones the newest, then by id."""
    n = items.withColumn("n_shared", overlap(F.col("text"), query)).where("n_shared > 0")
    return n.orderBy(F.desc("n_shared"), F.desc("created_at"), "id").limit(k).select("id", "n_shared", "created_at")


def answer_draft(pack: DataFrame, question: str) -> DataFrame:
    """answer, fallback, reason of a pack."""
    none = F.size("snippets") == 0
    text = F.concat(F.lit("Draft answer from "), F.size("snippets").cast("string"), F.lit(" evidence item(s): "), F.get("snippets", 0))
    return pack.select(
        F.when(none, F.lit(f"No evidence available for: {question}")).otherwise(text).alias("answer"),
        none.alias("fallback"),
        F.when(none, F.lit("empty evidence pack")).alias("reason"),
    )


def prompts(pack: DataFrame) -> DataFrame:
    """kind, message: the instructions for a pack."""
    # The instructions.
    asked = {
        "impact_summary": "Summarize impact. Cite evidence paths for every claim.",
        "risk_explanation": "Explain risk. Separate certain facts from possible AI candidates.",
        "test_suggestion": "Suggest tests. Link each suggested test to evidence paths.",
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("text")) for k, v in asked.items()]))
    return pack.select("evidence_paths", rows.alias("a")).select("a.kind", F.concat("a.text", F.lit("\nEvidence paths: "), F.array_join("evidence_paths", ", ")).alias("message"))


def resolve_configuration(system: DataFrame, project: DataFrame) -> DataFrame:
    """project_id and the settings: the project's, else the system's (one row)."""
    names = [c for c in system.columns]
    s = system.select(*[F.col(c).alias(f"s_{c}") for c in names])
    return project.crossJoin(F.broadcast(s)).select("project_id", *[F.coalesce(F.col(c), F.col(f"s_{c}")).alias(c) for c in names])


# --- candidate relations ---


def candidate_errors(candidates: DataFrame, identities: DataFrame, evidence: DataFrame, projects) -> DataFrame:
    """candidates with `errors`. identities: project_id, snapshot_id, id; evidence: project_id, snapshot_id, evidence_key."""
    mark = lambda df, column, name: df.select("project_id", "snapshot_id", F.col(column)).distinct().withColumn(name, F.lit(True))
    i = identities
    df = candidates.join(mark(i.withColumnRenamed("id", "source_identity_id"), "source_identity_id", "__s"), ["project_id", "snapshot_id", "source_identity_id"], "left")
    df = df.join(mark(i.withColumnRenamed("id", "target_identity_id"), "target_identity_id", "__t"), ["project_id", "snapshot_id", "target_identity_id"], "left")
    df = df.join(mark(evidence, "evidence_key", "__e"), ["project_id", "snapshot_id", "evidence_key"], "left")
    known = F.col("relation_name").isin(*registry.FAMILY)
    own = F.col("relation_name").isin(*[r for r, f in registry.FAMILY.items() if f == "AI_ASSISTED_CANDIDATE"])
    # The sentences of the rules.
    rules = [
        (~known, F.concat(F.lit("allowed relation type not registered: "), F.col("relation_name"))),
        (known & ~own, F.lit("AI candidate must use AI_ASSISTED_CANDIDATE relation family")),
        (F.col("confidence") == "CERTAIN", F.lit("AI candidate confidence cannot be CERTAIN")),
        (~F.col("project_id").isin(*projects), F.lit("project permission denied")),
        (F.col("__s").isNull(), F.lit("source identity missing")),
        (F.col("__t").isNull(), F.lit("target identity missing")),
        (F.col("__e").isNull(), F.lit("evidenceKey missing")),
        (F.col("expires_at").isNull() & ~F.col("stale"), F.lit("AI candidate must have expiresAt or staleAgainstSnapshot")),
    ]
    errors = F.array_compact(F.array(*[F.when(test, text) for test, text in rules]))
    return df.withColumn("errors", errors).select(*candidates.columns, "errors")


def active_candidates(candidates: DataFrame, project: str, snapshot: str, now: Column) -> DataFrame:
    own = (F.col("project_id") == project) & (F.col("snapshot_id") == snapshot)
    return candidates.where(own & ~F.col("stale") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def mark_stale(candidates: DataFrame, project: str, snapshot: str, evidence_key: str) -> DataFrame:
    hit = (F.col("project_id") == project) & (F.col("snapshot_id") == snapshot) & (F.col("evidence_key") == evidence_key)
    return candidates.withColumn("stale", F.col("stale") | hit)


def purge_expired(candidates: DataFrame, now: Column) -> DataFrame:
    return candidates.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def with_candidates(facts: DataFrame, candidates: DataFrame, asked: bool, ranking: bool) -> DataFrame:
    """facts, and the candidates too if the user or a planner's ranking wants them."""
    return facts.unionByName(candidates, allowMissingColumns=True) if asked or ranking else facts
