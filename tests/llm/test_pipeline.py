import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, tmp_path):
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == first.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
    once = lambda df: sorted(tuple(x) for x in df.select("doc_id", "epoch", "block").collect())
    assert once(corpus_pipeline.run(spark, sf)) == once(docs)


def test_import_guard_is_only_in_the_entry():
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    assert "ImportError" not in open(f"{top}/corpus_pipeline.py").read()


def test_stages_match_brute_force(spark, sf):
    """The first four stages, each by its definition in plain Python over the smallest tables; the last one keeps their texts."""
    from ripplegraph.llm import decontam, pii
    from tests.llm import test_decontam, test_pii, test_quality, test_simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(x.doc_id, x.text, x.lang, x.source) for x in docs.collect()]
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    first = {x[0]: x[1] for x, (_, _, ok) in zip(rows, test_quality.brute_report(rows), strict=True) if ok}
    near = test_simhash.brute_components({k: test_simhash.brute_print(t) for k, t in first.items()}, lambda a, b: bin(a ^ b).count("1") <= 2)
    second = {k: t for k, t in first.items() if near[k] == k}
    third = {}
    for k, t in second.items():
        n, hit, _ = test_decontam.brute(t, items)
        if not hit:
            third[k] = t
        elif 20 * hit < n:
            third[k] = None  # some of its words go
    stages = dict(corpus_pipeline.STAGES)
    a = stages["quality_rules"](spark, docs, sf)
    assert {x.doc_id: x.text for x in a.collect()} == first
    b = stages["near_dedup"](spark, a, sf)
    assert {x.doc_id: x.text for x in b.collect()} == second
    c = stages["decontaminate"](spark, b, sf)
    got = {x.doc_id: x.text for x in c.collect()}
    assert got.keys() == third.keys()
    for k, t in third.items():
        if t is not None:
            assert got[k] == t
        else:
            n, hit, _ = test_decontam.brute(second[k], items)
            assert len(decontam.words_of(got[k])) == n - hit and test_decontam.brute(got[k], items)[1] == 0
    d = {x.doc_id: x.text for x in stages["remove_pii"](spark, c, sf).collect()}
    assert d.keys() == third.keys()
    terms = test_pii.brute_terms(got.values())
    for k, t in got.items():
        spans = [(int(a), pii.KINDS.index(kind), int(z)) for kind, a, z in (x.split(":") for x in test_pii.brute_spans(t, terms.get(t, ())).split(",") if x)]
        assert test_pii.brute(d[k]) == [] and (d[k] == t) == (test_pii.brute(t) == [])
        assert d[k] == pii.clean(t, spans)
    e = stages["mix_sources"](spark, stages["remove_pii"](spark, c, sf), sf).collect()
    assert e and all(x.text == d[x.doc_id] for x in e)


def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark, sf):
    from pyspark.sql import functions as F

    from tests.llm.helpers import documents, rng, words

    r = rng(20)
    rows = [(k, " ".join(words(r, 150)), "en", "a") for k in range(4)]
    rows += [(7, None, None, None), (None, " ".join(words(r, 120)), None, "b"), (3, rows[3][1], "en", "a"), (8, "", "xx", "b"), (None, None, None, None), (9, " ".join(words(r, 30_000)), "fr", None)]
    docs = documents(spark, rows).withColumns({x: F.lit(1) for x in ("n_tokens", "fp", "spans", "items", "block", "host", "digest", "component_id", "n_words", "kept")})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert last or got.columns == docs.columns, name
        n = got.count()
        assert last or {"quality_rules": n < 10, "near_dedup": n < 9, "decontaminate": n == 10, "remove_pii": n == 10}[name], (name, n)
        assert stage(spark, docs.limit(0), sf).count() == 0, name
