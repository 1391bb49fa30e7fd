from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import govern, retrieve
from ripplegraph.plans.service import Service
from ripplegraph.sources import sinks
from ripplegraph.streaming import limiter, runs
from tests.graph.facts import facts

START = datetime(2024, 1, 1)


def calls(spark):
    rows = [(p, START + timedelta(seconds=s), k) for k, (p, s) in enumerate([("a", x) for x in (0, 1, 2, 9, 10, 11, 11, 12, 30)] + [("b", 5)])]
    return spark.createDataFrame(rows, "principal string, ts timestamp, event_id long"), rows


def brute(rows, most, seconds):
    logs, out = {}, {}
    for p, ts, k in sorted(rows):
        log = logs.setdefault(p, deque())
        while log and log[0] <= ts - timedelta(seconds=seconds):
            log.popleft()
        out[k] = len(log) < most
        if out[k]:
            log.append(ts)
    return out


def test_rate_limit(spark):
    df, rows = calls(spark)
    assert {x.event_id: x.accepted for x in limiter.limit(df, 2, 10).collect()} == brute(rows, 2, 10)


def test_rate_limit_stream(spark, tmp_path):
    df, rows = calls(spark)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
    q = limiter.limit_stream(stream, 2, 10).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {x.event_id: x.accepted for x in spark.table("limited").collect()} == brute(rows, 2, 10)


def requests(spark):
    rows = [
        ("r1", "ann", "CODE_QUESTION", "symbol.search", "shop", {"q": "Part"}, True),
        ("r2", "ann", "CODE_QUESTION", "nope", "shop", {}, True),
        ("r3", "ann", "CODE_QUESTION", "impact.analyzeDiff", "shop", {}, True),
        ("r4", "ann", "CODE_QUESTION", "symbol.search", "hidden", {}, True),
        ("r5", "ann", "CODE_QUESTION", "symbol.search", "shop", {"q": "select * from x"}, True),
        ("r6", "ann", "CODE_QUESTION", "symbol.search", "shop", {"q": "a", "theGlob": "b"}, True),
        ("r7", "ann", "CODE_QUESTION", "symbol.search", "shop", {"q": "run bash now token=abc"}, True),
        ("r8", "ann", "CODE_QUESTION", "symbol.search", "shop", {"q": "x"}, False),
        ("r9", "ann", "CODE_QUESTION", "symbol.search", "shop", {"sqlText": "x"}, True),
    ]
    return spark.createDataFrame(rows, "request_id string, principal string, profile string, tool_name string, project_id string, arguments map<string,string>, within_rate boolean")


WHY = {"r1": None, "r2": "unknown MCP tool", "r3": "out-of-profile tool", "r4": "project not allowed", "r5": "raw Cypher or SQL is not allowed", "r6": "file glob is not allowed", "r7": "shell command is not allowed", "r8": "rate limited", "r9": "raw Cypher or SQL is not allowed"}


def test_guard_and_audit(spark):
    r = requests(spark)
    assert {x.request_id: x.reason for x in govern.decisions(r, ["shop"]).collect()} == WHY
    assert sorted(x.request_id for x in govern.counted(r, ["shop"]).collect()) == ["r1", "r5", "r6", "r7", "r8", "r9"]
    log = {x.request_id: x for x in govern.audit(govern.decisions(r, ["shop"]).withColumn("result_count", F.lit(1))).collect()}
    assert log["r7"].parameter_summary == "q=run bash now token=[REDACTED_SECRET]" and log["r7"].redaction_state == "redacted"
    options = spark.createDataFrame([("q1", "p", "m", "d"), ("q2", "p", "m", "d"), ("q2", "p", "n", "d"), ("q3", "p", "m", "d"), ("q3", "p", "m", "d")], "query_id string, project_id string, module_key string, datasource_key string")
    got = {x.query_id: (x.needs_picker, x.follow_up) for x in govern.pick(options).collect()}
    assert got["q1"] == (False, None) and got["q2"][1].startswith("Choose project") and got["q3"][1].startswith("Please choose one")


def test_service(spark):
    f = facts(spark, [("method://shop/m/r/Part#a", "method://shop/m/r/Order#b", "CALLS"), ("method://shop/m/r/Order#b", "sql-statement://s", "BINDS_TO"), ("sql-statement://s", "db-table://t", "READS_TABLE")])
    s = Service(spark, f, artifacts=spark.createDataFrame([("x", "saved-query"), ("y", "export-artifact")], "id string, kind string"), evidence=spark.createDataFrame([("e", 1)], "evidence_key string, n int"))
    at = {"project": "shop", "snapshot": "snapshot-1"}
    results, audit = s.dispatch(requests(spark).withColumn("arguments", F.map_concat(F.create_map(F.lit("snapshot"), F.lit("snapshot-1")), "arguments")), ["shop"])
    assert [x.id for x in results["r1"].collect()] == ["method://shop/m/r/Part#a"] and audit.count() == 9 and audit.where("result_count = 1").count() == 1
    assert s.endpoints["db-impact"]({**at, "id": "db-table://t"}).select("use").collect()[0].use == "read" and s.endpoints["db-impact"]({**at, "id": "db-table://t"}).count() == 2
    assert s.endpoints["graph/paths"]({**at, "id": "method://shop/m/r/Part#a", "to": "db-table://t"}).count() == 1
    assert s.endpoints["graph/callers"]({**at, "id": "method://shop/m/r/Order#b"}).count() == 1 and s.endpoints["graph/callees"]({**at, "id": "method://shop/m/r/Part#a"}).count() == 1
    assert s.endpoints["saved-queries"]({}).count() == 1 and s.endpoints["projects"]({}).count() == 1 and s.endpoints["evidence"]({"id": "e"}).count() == 1
    assert s.endpoints["architecture-health"](at).count() == 2 and s.overview(at).first().n_facts == 3 and s.endpoints["result-view-contract"]({}).count() == 8
    assert s.report_impact({**at, "id": "db-table://t"})["paths"].count() == 0 and s.delete_project("shop", confirmed=True).count() == 0
    with pytest.raises(ValueError):
        s.delete_project("shop")
    with pytest.raises(ValueError):
        s.endpoints["admin/projects"]({"project": "shop"})
    assert s.endpoints["admin/projects"]({"project": "shop", "confirm": True}).count() == 0
    assert s.endpoints["impact/report-impact"]({**at, "id": "db-table://t"}).count() == 0
    change, again = (s.endpoints["features/plan-change"]({**at, "id": "x"}).first() for _ in range(2))
    assert change == again and change.status == "QUEUED" and s.endpoints["features/plan-addition"](at).first().job_id != change.job_id
    assert [x.id for x in s.handlers["feature.planChange"]({**at, "id": "method://shop/m/r/Part#a"}).collect()][-1] == "db-table://t"
    assert {x.id: x.n_uses for x in s.handlers["feature.planAddition"]({**at, "q": "order"}).collect()} == {"method://shop/m/r/Order#b": 1}
    assert set(govern.TOOLS) == set(s.handlers)
    with pytest.raises(ValueError):
        sinks.page(f, ["fact_ord"], 0, 101)


def test_runs(spark, tmp_path):
    e = spark.createDataFrame([("a", 1, "PLANNED"), ("a", 2, "RUNNING"), ("a", 3, "STAGED"), ("a", 4, "COMMITTED"), ("b", 1, "PLANNED"), ("b", 2, "COMMITTED"), ("c", 1, "RUNNING"), ("d", 1, "PLANNED"), ("d", 2, "SKIPPED")], "run_id string, ord int, status string")
    assert {x.run_id: (x.status, x.legal) for x in runs.run_states(e).collect()} == {"a": ("COMMITTED", True), "b": ("COMMITTED", False), "c": ("RUNNING", False), "d": ("SKIPPED", False)}
    assert {x.run_id: x.legal for x in runs.run_states(e, runs.SCOPE_RUN).collect()}["d"]
    t = spark.createDataFrame([(1, "RUNNING", 0, "failure"), (2, "RUNNING", 3, "failure"), (3, "RUNNING", 3, "timeout"), (4, "QUEUED", 0, "success"), (5, "RUNNING", 0, "success"), (6, "QUEUED", 0, "cancel")], "task_id int, status string, attempts int, outcome string")
    assert [x.next for x in runs.supervised(t).orderBy("task_id").collect()] == ["RETRY_WAITING", "FAILED", "TIMED_OUT", "QUEUED", "SUCCEEDED", "CANCELLED"]
    assert [runs.retry_delay_ms(k) for k in (0, 1, 9)] == [100, 200, 5000]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("connection reset")

    assert runs.with_retry(flaky, lambda s: None) == 2
    with pytest.raises(ValueError):
        runs.with_retry(lambda: (_ for _ in ()).throw(ValueError("bad")), lambda s: None)
    p = runs.Published(spark, f"file://{tmp_path}/p")
    for n in (1, 2):
        p.publish(p.stage(spark.range(n)))
    assert p.read().count() == 2
    own = spark.createDataFrame([("a", "STAGED"), ("b", "RUNNING")], "run_id string, status string")
    scope = spark.createDataFrame([("a", "s1", "FAILED")], "run_id string, scope_run_id string, status string")
    assert runs.batch_errors(own, scope, "STAGED").count() == 2


def docs(spark):
    rows = [("d1", "alpha", "graph search engine", 0), ("d2", "beta", "graph search", 1), ("d3", "gamma", "something else", 2), ("d4", "delta", "other things", 3), ("d2", "beta2", "graph search", 4)]
    from ripplegraph.functions.text import token_embedding

    df = spark.createDataFrame(rows, "id string, title string, body string, ord long").withColumns({"project_id": F.lit("p"), "snapshot_id": F.lit("s")})
    return df.withColumn("embedding", token_embedding(F.col("body"), 64))


def test_search(spark):
    d = retrieve.latest(docs(spark))
    assert {x.id: x.title for x in d.collect()}["d2"] == "beta2"
    assert [x.id for x in retrieve.exact_search(d, "Graph SEARCH", "p", "s").orderBy("ord").collect()] == ["d1", "d2"]
    plain = retrieve.hybrid_search(d, "graph search", "p", "s", 3).collect()
    assert [(x.id, x.source) for x in plain][:2] == [("d1", "exact"), ("d2", "exact")] and len(plain) == 3

    def expand(seeds):
        more = spark.createDataFrame([("d1", 1, "n1", 0.9), ("d1", 2, "d3", 0.95), ("d2", 1, "n2", 0.8), ("d3", 1, "n3", 2.0)], "from string, ord int, id string, score double")
        return seeds.select(F.col("id").alias("from"), F.col("place").alias("seed_place")).join(more, "from").select("seed_place", "ord", "id", F.col("id").alias("title"), "score")

    # merged: d1, d2 exact; d3 and d4 may come by vector; d1's expansion brings n1 and so on, until 2k are merged
    got = [x.id for x in retrieve.hybrid_search(d, "graph search", "p", "s", 4, expand=expand).collect()]
    assert got[0] == "n3" or got[:2] == ["d1", "d2"]
    assert "n1" in got or "d3" in got


def test_evidence(spark):
    s = spark.createDataFrame([("a.java", 3, "mail x@y.org", 0), ("b.java", 5, "12345", 1), ("c.java", 7, "123456789", 2), ("d.java", 9, "1", 3)], "path string, line_start int, snippet string, ord long")
    one = retrieve.evidence_pack(s, "p", "s", 30).first()
    assert one.evidence_paths == ["a.java:3", "b.java:5"] and one.truncated and one.snippets[0] == "mail [REDACTED_EMAIL]" and one.id.startswith("ep-") and len(one.id) == 15
    none = retrieve.evidence_pack(s, "p", "s", 1)
    assert none.first().evidence_paths == [] and retrieve.answer_draft(none, "why?").first().answer == "No evidence available for: why?"
    assert retrieve.answer_draft(retrieve.evidence_pack(s, "p", "s", 30), "q").first().answer == "Draft answer from 2 evidence item(s): mail [REDACTED_EMAIL]"
    assert retrieve.prompts(retrieve.evidence_pack(s, "p", "s", 30)).count() == 3


def test_sinks(spark, tmp_path):
    f = facts(spark, [("a", "b", "CALLS"), ("a", "c", "CALLS")])
    sinks.write_edges(f, f"file://{tmp_path}/e", 2)
    assert spark.read.parquet(f"file://{tmp_path}/e/by_target").count() == 2
    sinks.write_csv(f.select("fact_ord", F.array("relation_type").alias("r")), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first().r == '["CALLS"]'
    sinks.write_json(f, f"file://{tmp_path}/json")
    assert sinks.node_statements(spark).where("label = 'Method'").first().merge == "MERGE (n:GraphNode:Method {symbolId: $symbolId, snapshotId: $snapshotId}) SET n.projectId = $projectId, n.kind = $kind"
    assert sinks.duplicate_nodes(spark.createDataFrame([("a", "s"), ("a", "s")], "id string, snapshot_id string")).count() == 1


def brute_hybrid(exact, near, more, k):
    merged = {}

    def add(rows):
        for i, score in rows:
            if i not in merged or merged[i] < score:
                merged[i] = score

    add(exact)
    add(near)
    for seed in list(merged):
        if len(merged) >= 2 * k:
            break
        add(more.get(seed, []))
    return [i for i, _ in sorted(merged.items(), key=lambda x: -x[1])][:k]


@pytest.mark.parametrize("seed", range(4))
def test_hybrid_search_matches_brute_force(spark, seed):
    import random

    from ripplegraph.functions.text import token_embedding

    r = random.Random(seed)
    vocabulary = ["graph", "search", "engine", "cat", "dog", "tree"]
    rows = [(f"d{k}", f"t{k}", " ".join(r.choice(vocabulary) for _ in range(6)), k) for k in range(14)]
    d = spark.createDataFrame(rows, "id string, title string, body string, ord long").withColumns({"project_id": F.lit("p"), "snapshot_id": F.lit("s"), "embedding": token_embedding(F.col("body"), 64)})
    links = {f"{p}{k}": [(f"{r.choice('dn')}{r.randrange(20)}", round(r.random(), 3)) for _ in range(r.randrange(3))] for p in "dn" for k in range(20)}
    flat = spark.createDataFrame([(s, n, i, x) for s, v in links.items() for n, (i, x) in enumerate(v)], "from string, ord int, id string, score double")

    def expand(seeds):
        return seeds.select(F.col("id").alias("from"), F.col("place").alias("seed_place")).join(flat, "from").select("seed_place", "ord", "id", F.col("id").alias("title"), "score")

    for k in (3, 5):
        exact = [(x.id, 1.0) for x in retrieve.exact_search(d, "graph", "p", "s").orderBy("ord").collect()]
        near = [(x.id, x.score) for x in retrieve.vector_search(d, token_embedding(F.lit("graph"), 64), "p", "s", k).collect()]
        got = [x.id for x in retrieve.hybrid_search(d, "graph", "p", "s", k, expand=expand).collect()]
        assert got == brute_hybrid(exact, near, links, k)
        assert [x.id for x in retrieve.hybrid_search(d, "graph", "p", "s", k).collect()] == brute_hybrid(exact, near, {}, k)
