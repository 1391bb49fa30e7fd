import json

import pytest

from ripplegraph.operators import impact, traverse
from ripplegraph.sources import store
from tests.graph.facts import facts, seeds

ORDER = [
    ("method://C", "method://S", "CALLS"),
    ("method://S", "method://D", "CALLS"),
    ("method://D", "sql-statement://select", "BINDS_TO"),
    ("method://D", "sql-statement://insert", "BINDS_TO"),
    ("sql-statement://select", "db-table://orders", "READS_TABLE"),
    ("sql-statement://insert", "db-table://audit", "WRITES_TABLE"),
    ("sql-statement://select", "db-column://orders#id", "READS_COLUMN"),
    ("sql-statement://select", "db-column://orders#name", "READS_COLUMN"),
]


def test_whole_diff(spark):
    f = facts(spark, ORDER)
    report = impact.analyze_diff(f, "shop", "snapshot-1", ["method://D"], 10, 100)
    r = json.loads(impact.report_json(report).first().json)
    assert list(r) == ["projectId", "snapshotId", "changedSymbols", "affectedSymbols", "paths", "pathDetails", "dbImpacts", "suggestedTests", "aiEnabled", "truncated"]
    assert r["affectedSymbols"][:2] == ["method://S", "method://C"] and {"sql-statement://select", "db-table://orders"} <= set(r["affectedSymbols"])
    assert r["paths"][0] == {"identityIds": ["method://D", "method://S"], "depth": 1} and not r["truncated"]
    assert {x["targetIdentityId"]: (x["readCount"], x["writeCount"], x["upstreamBindingCount"]) for x in r["dbImpacts"]}["db-table://orders"] == (3, 0, 1)
    text = impact.report_markdown(report)
    assert text.startswith("# Fast Impact Report\n\n- Project: `shop`\n") and "- `method://D` -> `method://S`\n" in text and "- `db-table://audit`: 0 read, 1 write, 1 upstream bindings\n" in text
    empty = impact.report_markdown(impact.analyze_diff(f, "shop", "snapshot-1", ["method://none"], 3, 5))
    assert "## Path Evidence" not in empty and empty.count("- None") == 4


def test_table_and_column(spark):
    f = facts(spark, [("sql-statement://s", "db-table://users", "READS_TABLE"), ("sql-statement://s", "db-column://users#id", "READS_COLUMN"), ("method://m", "sql-statement://s", "BINDS_TO"), ("sql-statement://s", "db-table://accounts", "READS_TABLE"), ("sql-statement://w", "db-column://users#name", "WRITES_COLUMN"), ("field://f", "db-column://users#name", "MAPS_TO_COLUMN"), ("sql-statement://x", "db-table://users2", "READS_TABLE")])
    hits = impact.table_facts(f, "db-table://users")
    assert hits.count() == 4 and hits.where(impact.is_read()).count() == 2 and hits.where(impact.is_write()).count() == 1
    assert [x.source_identity_id for x in impact.upstream_bindings(f, hits).collect()] == ["method://m"]
    column = impact.column_facts(f, "db-column://users#name")
    assert column.count() == 2 and column.where(impact.is_write()).count() == 1 and column.where(impact.is_read()).count() == 0


def test_reports(spark):
    f = facts(
        spark,
        [
            ("sql-statement://e", "db-column://users#email", "READS_COLUMN"),
            ("sql-statement://n", "db-column://users#name", "READS_COLUMN"),
            ("sql-statement://e", "db-table://users", "READS_TABLE"),
            ("sql-statement://e", "report-definition://r", "EXPORTS_SYMBOL"),
            ("sql-statement://e", "report-definition://r", "REFERENCES_SYMBOL"),
        ],
    )
    got = impact.affected_reports(f, "db-column://users#email")
    assert sorted(x.target_identity_id for x in got["column_facts"].collect()) == ["db-column://users#email", "db-table://users"]
    assert [x.ids for x in got["paths"].collect()] == [["db-column://users#email", "sql-statement://e", "report-definition://r"]]
    assert got["report_facts"].count() == 2 and got["fallback"].first().fallback
    assert not impact.affected_reports(f, "db-table://users")["fallback"].first().fallback
    back = impact.affected_columns(f, "report-definition://r")
    assert back["column_facts"].count() == 2 and back["paths"].count() == 2 and back["report_facts"].count() == 2


def as_paths(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "ids array<string>")


def test_evaluation(spark):
    one = impact.evaluate(as_paths(spark, [["a", "b", "c"], ["x", "y"]]), as_paths(spark, [["a", "b", "c"]])).first()
    assert (one.n_reported, one.true_positives, one.false_positives, one.false_negatives, one.precision, one.recall) == (2, 1, 1, 0, 0.5, 1.0)
    none = impact.evaluate(as_paths(spark, []), as_paths(spark, [["a"]])).first()
    assert (none.true_positives, none.false_negatives, none.precision, none.recall) == (0, 1, 0.0, 0.0)
    assert impact.evaluate(as_paths(spark, []), as_paths(spark, [])).first().recall == 1.0


def test_tests_have_one_score(spark):
    risk = spark.createDataFrame([("ctl", 90), ("svc", 10)], "id string, risk int")
    changes = spark.createDataFrame([("ctl", 25), ("svc", 3)], "id string, n int")
    tests = spark.createDataFrame([(0, "b"), (1, "a")], "test_ord int, test string")
    got = impact.test_scores(tests, as_paths(spark, [["ctl", "svc"]]), risk, changes).orderBy("test_ord").collect()
    assert [(x.test, x.score) for x in got] == [("b", 128), ("a", 128)]


def test_rules_and_confidence(spark):
    p = as_paths(spark, [["ui.A", "db.B"], ["ui.A", "svc.X", "db.B"], ["db.B", "ui.A"]])
    v = impact.check_rules(p, {"layers": ("ERROR", lambda ids: impact.layer_violation(ids, "ui.", "db."))})
    assert [x.ids for x in v.collect()] == [["ui.A", "db.B"]] and impact.violation_summary(v).first().has_errors
    f = facts(spark, [("a", "b", "CALLS", {"confidence": "POSSIBLE"}), ("b", "c", "CALLS"), ("x", "b", "CALLS", {"confidence": "LIKELY"})])
    best = f.groupBy("target_identity_id").agg(impact.best_confidence(f.confidence).alias("c"))
    assert {x.target_identity_id: x.c for x in best.collect()} == {"b": "LIKELY", "c": "CERTAIN"}
    weak = impact.weakest_edge(traverse.find_downstream(f, seeds(spark, "a"), 3), f).orderBy("rank").collect()
    assert [x.confidence for x in weak] == ["POSSIBLE", "POSSIBLE"]


def test_tombstones_only_take_paths_away(spark):
    f = facts(spark, ORDER)
    before = {tuple(x.ids) for x in traverse.find_downstream(store.active_facts(f, "shop", "snapshot-1"), seeds(spark, "method://C"), 5).collect()}
    dead = facts(spark, [(*e, {"tombstone": k == 2}) for k, e in enumerate(ORDER)])
    after = {tuple(x.ids) for x in traverse.find_downstream(store.active_facts(dead, "shop", "snapshot-1"), seeds(spark, "method://C"), 5).collect()}
    assert after < before
    with pytest.raises(Exception, match="only active facts"):
        store.materialized_edges(dead, strict=True).collect()
