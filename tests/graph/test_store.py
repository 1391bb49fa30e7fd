import pytest
from pyspark.sql import functions as F

from ripplegraph.sources import store
from tests.graph.facts import facts

OWNER = {"project_id": "shop", "snapshot_id": "snapshot-1", "analyzer_id": "spoon", "scope_key": "src/main/java"}
OLD = [("a", "b", "CALLS"), ("a", "c", "CALLS"), ("a", "d", "CALLS", {"analyzer_id": "other"}), ("a", "e", "CALLS", {"snapshot_id": "snapshot-2"}), ("a", "s", "BINDS_TO")]
NEW = [("a", "c", "CALLS", {"confidence": "LIKELY"}), ("a", "x", "CALLS"), ("a", "x", "CALLS")]


def seen(df):
    return sorted((x.target_identity_id, x.tombstone, x.confidence) for x in df.collect())


def test_replace_scope(spark):
    old, new = facts(spark, OLD), facts(spark, NEW)
    got = store.replace_scope(old, new, OWNER)
    assert seen(got) == [("b", True, "CERTAIN"), ("c", False, "LIKELY"), ("d", False, "CERTAIN"), ("e", False, "CERTAIN"), ("s", True, "CERTAIN"), ("x", False, "CERTAIN"), ("x", False, "CERTAIN")]
    assert got.columns == old.columns and got.agg(F.countDistinct("fact_ord")).first()[0] == 7
    assert ("s", False, "CERTAIN") in seen(store.replace_scope(old, new, OWNER, family="CALL"))
    assert seen(store.replace_scope(old, new.limit(0), OWNER))[0] == ("b", True, "CERTAIN")


def test_upsert_keeps_repeats_of_the_batch(spark):
    got = store.upsert(facts(spark, OLD), facts(spark, NEW))
    assert seen(got) == [("b", False, "CERTAIN"), ("c", False, "LIKELY"), ("d", False, "CERTAIN"), ("e", False, "CERTAIN"), ("s", False, "CERTAIN"), ("x", False, "CERTAIN"), ("x", False, "CERTAIN")]


def test_store_on_disk(spark, tmp_path):
    s = store.FactStore(spark, f"file://{tmp_path}/facts")
    heard = []
    s.listeners.append(heard.append)
    s.append(facts(spark, OLD))
    heard.clear()
    s.upsert(facts(spark, NEW))
    assert s.facts().count() == 7 and heard[0]["families"] == ["CALL"]
    s.replace_scope(facts(spark, NEW).limit(0), OWNER)
    assert len(heard) == 1
    left = s.facts().where(store.visible())
    assert sorted(x.target_identity_id for x in left.collect()) == ["d", "e"]
    assert s.purge_tombstones("shop", "snapshot-1") == 5 and s.facts().count() == 2
    s.append(facts(spark, [("q", "r", "CALLS")]))
    assert store.active_count(s.facts(), "shop").first().n == 3
    s.reject = 4
    for commit in (s.append, s.upsert, lambda b: s.replace_scope(b, OWNER)):
        with pytest.raises(ValueError, match="too many"):
            commit(facts(spark, [("q", "z", "CALLS")]))
    s.append(facts(spark, [("q", "z", "CALLS")], snapshot_id="s").withColumn("project_id", F.lit("other")))  # the limit is a project's
    versions = s.facts().count()
    assert s.vacuum() > 0 and s.facts().count() == versions
    assert s.delete_project("shop") == 3 and [x.project_id for x in s.facts().collect()] == ["other"]


def test_replace_scope_matches_rows_by_their_own_owner(spark):
    """Owner A and analyzer B both hold a key that the batch brings for B: A's fact stays as it is, B's is replaced."""
    old = facts(spark, [("a", "b", "CALLS"), ("a", "b", "CALLS", {"analyzer_id": "other"})])
    new = facts(spark, [("a", "b", "CALLS", {"analyzer_id": "other", "confidence": "LIKELY"})])
    got = sorted((x.analyzer_id, x.tombstone, x.confidence) for x in store.replace_scope(old, new, OWNER).collect())
    assert got == [("other", False, "LIKELY"), ("spoon", False, "CERTAIN")]


def test_purging_all_rows_of_a_snapshot(spark, tmp_path):
    s = store.FactStore(spark, f"file://{tmp_path}/facts")
    s.append(facts(spark, OLD, tombstone=True))
    assert s.purge_tombstones("shop", "snapshot-2") == 1 and s.facts().where("snapshot_id = 'snapshot-2'").count() == 0
    assert s.purge_tombstones("shop", "snapshot-1") == 4 and s.facts().count() == 0 and s.purge_tombstones("shop", "snapshot-1") == 0
    s.append(facts(spark, OLD))
    assert s.facts().count() == len(OLD)


def test_appended_rows_come_after_all_others(spark, tmp_path):
    s = store.FactStore(spark, f"file://{tmp_path}/facts")
    for _ in range(3):
        s.append(facts(spark, OLD))
    assert s.facts().select("fact_ord").distinct().count() == s.facts().count() == 3 * len(OLD)


def test_commits_are_whole_or_absent(spark, tmp_path):
    s = store.FactStore(spark, f"file://{tmp_path}/facts")
    s.append(facts(spark, OLD))
    before = seen(s.facts())
    reader = s.facts()
    broken = facts(spark, NEW).withColumn("confidence", F.when(F.col("target_identity_id") == "x", F.raise_error(F.lit("lost"))).otherwise(F.col("confidence")))
    with pytest.raises(Exception, match="lost"):
        s.upsert(broken)
    assert seen(s.facts()) == before
    old = s._pointer()
    s.upsert(facts(spark, NEW))
    assert seen(reader) == before  # who read before the commit still reads what was there
    with pytest.raises(RuntimeError, match="another commit"):
        s._commit(old, facts(spark, NEW))


def test_odd_names_of_projects_and_snapshots(spark, tmp_path):
    s = store.FactStore(spark, f"file://{tmp_path}/facts")
    s.append(facts(spark, OLD, snapshot_id="2024/05=a b").withColumn("project_id", F.lit("007")))
    got = s.facts().first()
    assert (got.project_id, got.snapshot_id) in {("007", "2024/05=a b"), ("007", "snapshot-2")}
    assert store.active_facts(s.facts(), "007", "2024/05=a b").count() == 4


def test_diff_and_errors(spark):
    f = facts(spark, [("a", "b", "CALLS"), ("a", "c", "CALLS"), ("a", "c", "CALLS", {"snapshot_id": "snapshot-2", "confidence": "LIKELY"}), ("a", "z", "CALLS", {"snapshot_id": "snapshot-2"})])
    assert sorted(x.change for x in store.snapshot_diff(f, "shop", "snapshot-1", "snapshot-2").collect()) == ["added", "changed", "removed"]
    good = facts(spark, [("method://shop/m/src/main/java/A#a()V", "method://shop/m/src/main/java/A#b()V", "CALLS")])
    assert store.fact_errors(good).count() == 0
    bad = good.withColumn("fact_key", F.lit("x")).withColumn("project_id", F.lit("other")).withColumn("confidence", F.lit("SURE")).withColumn("source_type", F.lit("AI_ASSISTED"))
    assert set(store.fact_errors(bad).first().errors) == {"key", "source_project", "target_project", "confidence", "ai_family"}
    n = spark.createDataFrame([(10,), (500_000,), (5_000_000,)], "n long").select(store.size_advice(F.col("n")).alias("a"))
    assert [x.a for x in n.collect()] == ["OK", "SWITCH_RECOMMENDED", "REJECT"]
