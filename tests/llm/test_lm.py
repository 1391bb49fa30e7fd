import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ripplegraph.llm import lm
from tests.llm.helpers import documents, rng, words


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def brute(rows):
    """Katz by its definition, in plain Python."""
    held = {k: zlib.crc32(str(k).encode() if k is not None else b"") % 7 == 2 for k, _ in rows}
    train = [tokens(t) for k, t in rows if not held[k]]
    c = Counter(w for d in train for w in d)
    n, v = sum(c.values()), len(c)
    of = lambda w: w if w in c or w == "" else None
    classes = [*{*c, ""}, None]
    good_turing = lambda counts: lm.discounts(np.array([list(counts).count(r) for r in range(1, 7)], float))
    d1 = good_turing(c.values())
    p1 = {w: (d1[x - 1] if x <= 5 else 1) * x / n for w, x in c.items()} if n else {"": 0.5}
    left = 1 - sum(p1.values())
    if n and left < 1 / (n + 1):
        p1 = {w: x * (1 - 1 / (n + 1)) for w, x in p1.items()}
    p1[None] = 1 - sum(p1.values())
    pairs = Counter((of(a), of(b)) for d in train for a, b in zip(["", *d], d, strict=False))
    d2 = good_turing(pairs.values())
    probs = {}

    def context(u):
        if u not in probs:
            seen = {b: x for (a, b), x in pairs.items() if a == u}
            cu = sum(seen.values())
            got = {b: (d2[x - 1] if x <= 5 else 1) * x / cu for b, x in seen.items()}
            mass, rest = sum(got.values()), 1 - sum(p1[b] for b in seen)
            if cu:
                most = 1 - 1 / (cu + 1) if rest > 1e-9 else 1.0
                if mass > most or rest <= 1e-9:
                    got = {b: x * most / mass for b, x in got.items()}
                    mass = most
            probs[u] = {b: got[b] if b in got else (1 - mass) / rest * p1[b] for b in classes}
            assert sum(probs[u].values()) == pytest.approx(1, abs=1e-9)
        return probs[u]

    out = []
    for k, t in rows:
        d_ = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d_)
        score = sum(math.log10(context(of(a))[of(b)]) for a, b in zip(["", *d_], d_, strict=False))
        out.append((k if k is not None else -1, held[k], len(d_), sum(c[w] > 0 for w in d_), n, base, score))
    return sorted(out)


def matches(got, rows):
    found, want = sorted((x.doc_id if x.doc_id is not None else -1, *x[1:]) for x in got), brute(rows)
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)


@pytest.mark.parametrize("group", [50, 400, 3_000_000])
def test_matches_brute_force(spark, group):
    r = rng(17)
    rare = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words(r, r.randrange(60)) + words(r, r.randrange(6), rare))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "Ünknown ZZZ qqq"), (3, rows[3][1]), (None, "the of and"), (None, None), (103, " ".join(words(r, 5000)))]
    docs = documents(spark, rows).withColumnsRenamed({"lang": "g", "source": "payload", "n_chars": "kind"})
    matches(lm.score_documents(docs, group_tokens=group).collect(), rows)


def test_few_counts_leave_something_to_unseen_words(spark):
    """With no rare word the discounts leave nothing, and 1 / (N + 1) goes to unseen ones."""
    rows = [(k, "a b a b a b a b") for k in range(40)] + [(50, "a zzz")]
    matches(lm.score_documents(documents(spark, rows)).collect(), rows)


def test_edges(spark):
    docs = documents(spark, [(1, "a b")])
    assert lm.score_documents(docs.limit(0)).count() == 0
    alone = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    only = lm.score_documents(documents(spark, [(alone, "a b")])).first()
    assert only.train_tokens == 0 and only.n_known == 0 and only.base_score == 0 and only.score < 0


def test_better_than_base_on_held_out(spark, sf):
    got = lm.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b


def test_all_words_are_classes(spark):
    # Past any fixed rank: 70,000 commoner words, and rare ones whose bigrams count all the same.
    held = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 7 == 2]
    trained = [k for k in range(2000) if k not in held]
    common = " ".join(f"w{k}" for k in range(70_000))
    rows = [(k, common) for k in trained[:3]] + [(k, "zzrare zzpair") for k in trained[3:5]] + [(k, "zzother") for k in trained[5:7]]
    rows += [(held[0], "zzrare zzpair"), (held[1], "zzrare zzother")]
    score = {x.doc_id: x.score for x in lm.score_documents(documents(spark, rows)).collect()}
    assert score[held[0]] > score[held[1]] + 1
