import random
import time
from collections import deque

import pytest

from ripplegraph.operators import traverse
from tests.graph.facts import facts, paths, seeds


def brute(edges, start, depth, limit, emit=lambda n: True):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    out, queue = [], deque([[start]])
    while queue and len(out) < limit:
        p = queue.popleft()
        if len(p) - 1 >= depth:
            continue
        for n in near.get(p[-1], []):
            if n in p:
                continue
            queue.append([*p, n])
            if emit(n):
                out.append([*p, n])
                if len(out) >= limit:
                    break
    return out


@pytest.mark.parametrize("depth", [0, 1, 3, 20])
@pytest.mark.parametrize("limit", [1, 7, 100])
def test_order_and_limits_match_brute_force(spark, depth, limit):
    r = random.Random(depth * 100 + limit)
    nodes = [f"m{k}" for k in range(9)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(22)]
    f = facts(spark, [(a, b, r.choice(["CALLS", "INVOKES"])) for a, b in edges] + [("m0", "m1", "CONTAINS")])
    got = traverse.find_callers(f, seeds(spark, "m0", "m3"), depth, limit)
    rows = got.collect()
    for s in ("m0", "m3"):
        want = brute([(b, a) for a, b in edges], s, depth, limit)
        own = sorted((x for x in rows if x.seed == s), key=lambda x: x["rank"])
        assert [x.ids for x in own] == want
        assert all(x.truncated == (len(want) >= limit) for x in own)


def test_chain_of_750(spark):
    f = facts(spark, [(f"Service{k}", f"Service{k - 1}", "CALLS") for k in range(1, 750)])
    traverse.find_callers(f, seeds(spark, "Service0"), 1, 1).count()
    began = time.time()
    got = traverse.find_callers(f, seeds(spark, "Service0"), 750, 750)
    assert got.count() == 749 and got.where("truncated").count() == 0
    assert time.time() - began < 10


def test_limit_of_one_is_truncated(spark):
    f = facts(spark, [("A", "T", "CALLS"), ("B", "T", "CALLS")])
    got = traverse.find_callers(f, seeds(spark, "T"), 2, 1).collect()
    assert [x.ids for x in got] == [["T", "A"]] and got[0].truncated
    assert traverse.find_callers(f, seeds(spark, "T"), 2, 0).count() == 2  # a limit of 0 is the default


def test_backend_flows_count_before_the_sink_test(spark):
    f = facts(spark, [("method://a", "method://b", "CALLS"), ("method://a", "sql-statement://s", "BINDS_TO"), ("sql-statement://s", "db-table://t", "READS_TABLE")])
    assert paths(traverse.find_backend_flows(f, seeds(spark, "method://a"), 3, 100)) == ["method://a/sql-statement://s", "method://a/sql-statement://s/db-table://t"]
    cut = traverse.find_backend_flows(f, seeds(spark, "method://a"), 3, 2).collect()
    assert len(cut) == 1 and cut[0].truncated


PARAM = "param-slot://shop/_root/src/main/java/com.A#run(I)V:param[0:I]"
METHOD = "method://shop/_root/src/main/java/com.A#run(I)V"


def test_variable_sources(spark):
    f = facts(spark, [("jsp-input://x", "request-param://p", "BINDS_TO"), ("request-param://p", PARAM, "PASSES_PARAM")])
    assert [x.ids for x in traverse.trace_sources(f, seeds(spark, PARAM), 4, 10).orderBy("rank").collect()][-1] == [PARAM, "request-param://p", "jsp-input://x"]


def test_variable_sinks(spark):
    base = [(METHOD, "sql-statement://s", "BINDS_TO"), ("sql-statement://s", "sql-param://s1", "HAS_PARAM"), ("sql-statement://s", "db-table://users", "READS_TABLE"), ("sql-statement://s", "db-column://users#id", "READS_COLUMN")]
    got = [x.ids for x in traverse.trace_sinks(facts(spark, base), seeds(spark, PARAM), 4, 10).orderBy("rank").collect()]
    assert got == [[PARAM, "sql-statement://s"], [PARAM, "sql-statement://s", "sql-param://s1"], [PARAM, "sql-statement://s", "db-table://users"]]
    # a start that is in the graph already has the edge twice
    more = facts(spark, [*base, (PARAM, "param-slot://other:param[0:I]", "PASSES_PARAM")])
    got = [x.ids for x in traverse.trace_sinks(more, seeds(spark, PARAM), 1, 10).collect()]
    assert got == [[PARAM, "sql-statement://s"]] * 2
    assert all(x.truncated for x in traverse.trace_combined(more, seeds(spark, PARAM), 1, 2).collect())


def test_cache_and_one_hop(spark):
    f = facts(spark, [("A/x", "T", "CALLS"), ("B", "T", "CALLS"), ("T", "Z", "INVOKES"), ("T", "t", "CONTAINS")])
    cache = traverse.AdjacencyCache()
    assert cache.get("shop", "s") is None
    cache.rebuild(f, "shop", "s")
    cache.rebuild(f, "shop", "s", ("MODULE", "x"))
    assert cache.find_callers(f, "shop", "s", seeds(spark, "T"), 2).count() == 2
    assert cache.invalidate("shop", "s", ("MODULE", "y")) == 1 and cache.invalidate("shop", "s") == 1
    assert [x.id for x in traverse.one_hop(f, "T", forward=False).orderBy("ord").collect()] == ["A/x", "B"]
    assert {x.src: x.neighbours for x in traverse.adjacency(f, forward=False).collect()} == {"T": ["A/x", "B"], "Z": ["T"]}
    assert traverse.capped(traverse.edges_of(f, ("CALLS",), forward=False), 1).count() == 1
