import re

import pytest
import xxhash

from ripplegraph.llm import simhash
from ripplegraph.llm.util import components
from tests.llm.helpers import documents, rng, words


def brute_print(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(values, near):
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and near(values[a], values[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints(spark):
    r = rng(4)
    texts = [None, "", "one", "One two", "ONE two three", "É a\tb\x0bc d"] + [" ".join(words(r, n)) for n in (3, 4, 50, 800)]
    got = simhash.fingerprints(documents(spark, list(enumerate(texts)))).collect()
    for x in got:
        assert x.fp % (1 << 64) == brute_print(texts[x.doc_id])
    assert spark.range(1).selectExpr("xxhash64('abc') h").first().h % (1 << 64) == xxhash.xxh64_intdigest(b"abc", 42)


@pytest.mark.parametrize("dense", [1, 3, 16, 10_000])
def test_links_match_brute_force(spark, dense):
    r = rng(5)
    fps = {0: 0, 1: (1 << 64) - 1}
    for k in range(60):
        base = r.getrandbits(64) if k % 4 else fps[r.choice(list(fps))]
        for _ in range(r.choice([1, 2, 5])):
            base ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3])))
            if base not in fps.values():
                fps[len(fps)] = base
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in fps.items()}
    nodes = spark.createDataFrame(list(signed.items()), "id long, fp long")
    want = brute_components(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    for groups in (None, 5, 9, 16) if dense == 10_000 else (None,):
        found = {x.node: x.component for x in components(simhash.links(nodes, groups=groups, dense=dense)).collect()}
        assert {i: found.get(i, i) for i in fps} == want


def test_groups_grow_with_the_corpus():
    shares = [(6 / 16) ** (32 * (g - 2) // g) for g in map(simhash.groups_for, (10, 10**6, 10**8, 10**10))]
    assert [simhash.groups_for(n) for n in (10, 10**6)] == [4, 4] and shares[2] * 10**8 < 1 and shares[3] * 10**10 < 1 and simhash.groups_for(10**10) <= 9


@pytest.mark.parametrize("distance", [0, 1])
def test_smaller_distances(spark, distance):
    r = rng(6)
    fps = {k: r.getrandbits(63) for k in range(5)}
    for k in range(5, 40):
        v = fps[r.randrange(k)] ^ (1 << r.randrange(63))
        if v not in fps.values():
            fps[k] = v
    nodes = spark.createDataFrame(list(fps.items()), "id long, fp long")
    for dense in (2, 100):
        found = {x.node: x.component for x in components(simhash.links(nodes, distance=distance, dense=dense)).collect()}
        assert {i: found.get(i, i) for i in fps} == brute_components(fps, lambda a, b: bin(a ^ b).count("1") <= distance)


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7)] + [(200, 201)] * 3
    found = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    r = rng(7)
    long = words(r, 400)
    rows = [(5, " ".join(long)), (3, " ".join(long)), (9, " ".join([*long[:-1], "other"])), (4, None), (8, ""), (6, " ".join(words(r, 50))), (None, " ".join(long)), (6, " ".join(words(r, 50)))]
    docs = documents(spark, rows)
    got = simhash.near_duplicates(docs)
    by = {}
    for x in got.collect():
        by.setdefault(x.doc_id, set()).add(x.component_id)
    assert by[5] == by[3] == by[None] == {3} and by[4] == by[8] == {4} and got.count() == len(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert 3 in ids and 5 not in ids and None not in ids and ids.count(4) == 1 and 8 not in ids and ids.count(6) == 2


def test_null_and_repeated_ids(spark, monkeypatch):
    """Links go through documents without id, and ids play no part in what a row is."""
    fps = {"a": 0b11, "b": 0, "c": 0b1100, "d": 0xFF0000, "e": 0xFF0000, "f": 0xF0F0F0F000000000}
    rows = [(1, "a"), (None, "b"), (2, "c"), (2, "d"), (2, "d"), (None, "e"), (None, "f"), (None, "f")]

    def fake(docs, doc_id="doc_id", text="text", keys=()):
        value = simhash.F.create_map(*[simhash.F.lit(x) for k, v in fps.items() for x in (k, v - (1 << 64) if v >> 63 else v)])
        return docs.select("doc_id", value[simhash.F.col("text")].alias("fp"), *keys)

    monkeypatch.setattr(simhash, "fingerprints", fake)
    want = sorted([(1, 1), (None, 1), (2, 1), (2, 2), (2, 2), (None, 2), (None, None), (None, None)], key=str)
    for parts in (1, 3, 6):
        docs = documents(spark, rows).withColumnRenamed("lang", "group").repartition(parts)
        got = simhash.near_duplicates(docs).collect()
        assert sorted([(x.doc_id, x.component_id) for x in got], key=str) == want
        assert sorted([(x.doc_id, x.text) for x in simhash.keep_one(docs).collect()], key=str) == sorted([(1, "a"), (2, "d"), (None, "f")], key=str)


def test_empty_and_counts(spark):
    docs = documents(spark, [(1, "x")])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
