import math

import pytest

from ripplegraph.llm import mixing
from tests.llm.helpers import documents, rng, words


def corpus(spark):
    r = rng(12)
    rows = []
    for s, n in (("big", 200), ("mid", 60), ("small", 15), (None, 10)):
        rows += [(len(rows) + k, " ".join(words(r, r.randrange(1, 30))), "en", s) for k in range(n)]
    rows += [(1000, None, "en", "empty"), (1001, "", "en", "small")]
    return rows, documents(spark, rows)


def entropy(p):
    return -sum(x * math.log(x) for x in p if x) / math.log(sum(x > 0 for x in p))


def test_weights(spark):
    rows, docs = corpus(spark)
    tokens = {}
    for _, t, _, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    d = docs.select("source", mixing.token_count(docs.text).alias("n_tokens"))
    for share, repeats in ((0.97, None), (0.8, None), (0.1, None), (1.0, None), (1.0, 2.0), (0.5, 50.0)):
        got = {x.source: x for x in mixing.source_weights(d, "source", "n_tokens", entropy_share=share, max_repeats=repeats).collect()}
        assert {k: x.tokens for k, x in got.items()} == tokens
        w = [x.weight for x in got.values()]
        assert sum(w) == pytest.approx(1)
        total = sum(tokens.values())
        if repeats is None:
            natural = entropy([x / total for x in tokens.values()])
            assert entropy(w) == pytest.approx(max(share, natural), abs=1e-5)
        else:
            assert max(x.weight * total / x.tokens for x in got.values() if x.tokens) <= repeats + 1e-4
        ratio = {math.log(got[a].weight / got["big"].weight) / math.log(tokens[a] / tokens["big"]) for a in ("mid", "small") if got[a].weight != got["big"].weight}
        assert max(ratio, default=0) - min(ratio, default=0) < 1e-9


@pytest.mark.parametrize("ranges", [1, 7, 4096, None])
def test_budgets_and_blocks(spark, ranges):
    rows, docs = corpus(spark)
    got = mixing.mix(docs.withColumnRenamed("n_chars", "n_tokens"), ranges=ranges, blocks=5)
    found = got.collect()
    weights = {x.source: x for x in mixing.source_weights(docs.select("source", mixing.token_count(docs.text).alias("n")), "source", "n").collect()}
    assert len({(x.doc_id, x.epoch) for x in found}) == len(found)
    size = {k: len((t or "").split()) for k, t, _, _ in rows}
    for s, w in weights.items():
        own = [x for x in found if x.source == s]
        used = sum(x.n_tokens for x in own)
        assert used <= w.budget
        if w.tokens:
            assert w.budget - used <= max(size[k] for k, _, _, y in rows if y == s)
            full = w.budget // w.tokens
            ids = sorted(k for k, _, _, y in rows if y == s)
            for e in range(full):
                assert sorted(x.doc_id for x in own if x.epoch == e) == ids
            # a block has its share of the budget, up to a document on either side
            for b in range(5):
                assert abs(sum(x.n_tokens for x in own if x.block == b) - w.budget / 5) <= 30 + max(0, w.budget - used)


def brute_mix(spark, docs, blocks, seed=mixing.SEED):
    """(doc_id, source, epoch, block, text) of the mixture by plain running sums; only hashes and weights come from Spark."""
    weights = {x.source: x for x in mixing.source_weights(docs.select("source", mixing.token_count(docs.text).alias("n")), "source", "n").collect()}
    keyed = mixing._keyed(docs)
    out = []
    epochs = 1 + max((w.budget // w.tokens for w in weights.values() if w.tokens), default=0)
    hashes = [mixing.F.pmod(mixing.F.xxhash64("__h", mixing.F.lit(k), mixing.F.lit(seed)), mixing.F.lit(1 << 40)).alias(f"h{k}") for k in range(epochs)]
    rows = keyed.select("doc_id", "source", "text", "__h", "__g", *hashes).collect()
    for s, w in weights.items():
        own = [x for x in rows if x.source == s]
        for e in range(math.ceil(w.budget / w.tokens) if w.tokens else 1):
            at = e * w.tokens
            for x in sorted(own, key=lambda x: (x[f"h{e}"], x["__h"], x["__g"])):
                n = len((x.text or "").split())
                if at + n <= w.budget:
                    out.append((x.doc_id, s, e, min(at * blocks // max(w.budget, 1), blocks - 1), x.text))
                at += n
    return sorted(out, key=str)


def test_places_match_brute_force(spark):
    rows, docs = corpus(spark)
    r = rng(31)
    rows = rows + [(None, " ".join(words(r, 9)), "en", "mid") for _ in range(6)] + [(7, " ".join(words(r, 20)), "en", "small") for _ in range(4)] + rows[:3] * 2 + [(None, None, None, None)]
    for parts, ranges in ((1, 10), (3, 1), (5, None)):
        docs = documents(spark, rows).repartition(parts).withColumnRenamed("lang", "weight")
        want = brute_mix(spark, docs, 5)
        got = mixing.mix(docs, blocks=5, ranges=ranges).collect()
        assert sorted([(x.doc_id, x.source, x.epoch, x.block) for x in got], key=str) == sorted([x[:4] for x in want], key=str)
        full = mixing.mixed(docs, blocks=5, ranges=ranges)
        assert full.columns == ["doc_id", "text", "source", "n_chars", *mixing.MIXTURE]
        assert sorted([(x.doc_id, x.source, x.epoch, x.block, x.text) for x in full.collect()], key=str) == want


def test_empty(spark):
    _, docs = corpus(spark)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    assert {x.doc_id for x in mixing.mix(documents(spark, [(1, None)])).collect()} <= {1}
