import math
import re
from collections import Counter

from ripplegraph.llm import quality
from ripplegraph.llm.util import cut
from tests.llm.helpers import documents, rng, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    seen, hit = Counter(windows), set()
    for k, x in enumerate(windows):
        if seen[x] > 1:
            hit.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n_sym = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), n_sym, len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark):
    r = rng()
    texts = [None, "", " ", "\n\n", "one", "a b c d e f g h", "a a a a a a a a a", "x\x0by\x0cz\r\n\tw", "a\n b\na\n \n a\n", "#*$%&|<> && é 😀 b", "  nbsp em"]
    for n in (7, 8, 9, 40, 400, 3000):
        texts.append(" ".join(words(r, n)))
        part = words(r, 12)
        texts.append(" ".join(part + words(r, n) + part + words(r, 3) + part))
        texts.append("\n".join(" ".join(words(r, 4, ["a", "b"])) for _ in range(n // 4)))
    texts.append(" ".join(words(r, 20000, ["a", "b", "c", "d"])))
    got = quality.quality_report(documents(spark, [(k, t) for k, t in enumerate(texts)])).collect()
    assert len(got) == len(texts)
    for row in got:
        want = brute(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, texts[row.doc_id]
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row.base_failed and row.kept)


def distance(p, q):
    return math.sqrt(max(0, sum(0.5 * a * math.log2(2 * a / (a + b)) if a else 0 for a, b in zip(p, q)) + sum(0.5 * b * math.log2(2 * b / (a + b)) if b else 0 for a, b in zip(p, q))))


def histograms(text, lang):
    c = Counter(next((k for k, v in quality.CLASSES.items() if ch in v), "other") for ch in re.sub(r"[\t\n\x0b\x0c\r]", " ", text))
    chars = [c[k] for k in (*quality.CLASSES, "other")]
    w = Counter(WORD.findall(text))
    listed = quality.COMMON_WORDS.get(lang, [])
    common = [w[x] for x in listed]
    return [x / max(sum(chars), 1) for x in chars], [x / max(sum(w.values()), 1) for x in (*common, sum(w.values()) - sum(common))]


def brute_report(rows):
    """(char distance, word distance, kept) of each row, by plain loops."""
    passes = lambda t: len(WORD.findall(t or "")) >= 20 and 100 * brute(t)[4] <= 30 * brute(t)[0]
    mean = lambda vs: [sum(x) / len(vs) for x in zip(*vs, strict=True)]
    refs = {}
    for lang in {x[2] for x in rows}:
        texts = sorted({x[1] for x in rows if x[2] == lang and passes(x[1]) and len(WORD.findall(x[1])) >= quality.MIN_WORDS})
        own = [histograms(t, lang) for t in texts]
        votes = own
        for _ in range(quality.TRIMS):
            if own:
                ref = mean([v[0] for v in votes])
                ds = [distance(v[0], ref) for v in own]
                m = sum(ds) / len(ds)
                most = m + math.sqrt(sum((d - m) ** 2 for d in ds) / len(ds))
                votes = [v for v, d in zip(own, ds, strict=True) if d <= most + 1e-9]
        if own:
            refs[lang] = mean([v[0] for v in votes]), mean([v[1] for v in votes])
    out = []
    for _, t, lang, _ in rows:
        n, n_words, (chars, common) = len(t or ""), len(WORD.findall(t or "")), histograms(t or "", lang)
        c = distance(chars, refs[lang][0]) if lang in refs and n >= quality.MIN_CHARS else None
        w = distance(common, refs[lang][1]) if lang in refs and n_words >= quality.MIN_WORDS and len(common) > 1 else None
        expected = lambda k, size: math.sqrt((k - 1) / (8 * size * math.log(2)))
        ok = passes(t) and (c is None or c - expected(len(chars), n) <= quality.CHAR_LIMIT) and (w is None or w - expected(len(common), n_words) <= quality.WORD_LIMIT)
        out.append((c or 0, w or 0, ok))
    return out


def test_distances_match_brute_force(spark):
    r = rng(2)
    rows = [(k, " ".join(words(r, 120 + 17 * k)), ("en", None, "xx")[k % 3], "s") for k in range(40)]
    rows += [(100 + k, "%%% ### the of in to and a was is " * (100 + k), "en", "s") for k in range(3)]
    rows += [(200 + k, "%%% ### " * 500, "en", "s") for k in range(60)] + [(None, None, "en", "s"), (1, "", None, "s"), (1, rows[4][1], "en", "s"), (None, rows[4][1], "en", "s")]
    docs = documents(spark, rows).withColumnRenamed("source", "kept").repartition(6)
    key = lambda x: tuple(map(str, x))
    got = sorted([(x.doc_id, round(x.char_distance, 6), round(x.word_distance, 6), x.kept) for x in quality.quality_report(docs).collect()], key=key)
    assert got == sorted([(x[0], round(c, 6), round(w, 6), ok) for x, (c, w, ok) in zip(rows, brute_report(rows), strict=True)], key=key)


def test_junk_copies_dont_move_the_reference(spark):
    """Copies of a bad document in every third row, and one very long one, leave the verdicts of the others as they are."""
    r = rng(5)
    v = [*quality.COMMON_WORDS["en"], *("".join(r.choice("aeioubcdfghlmnrst") for _ in range(r.randrange(3, 9))) for _ in range(200))]
    rows = [(k, " ".join(words(r, r.randrange(60, 400), v)), "en", "s") for k in range(80)]
    bad = " | ".join("".join(r.choice("QXZ#%") for _ in range(9)) for _ in range(90))
    alone = {x.doc_id: (x.char_distance, x.kept) for x in quality.quality_report(documents(spark, rows)).collect()}
    among = {x.doc_id: (x.char_distance, x.kept) for x in quality.quality_report(documents(spark, rows + [(1000 + k, bad, "en", "s") for k in range(40)] + [(2000, bad * 300, "en", "s")])).collect()}
    assert all(ok for _, ok in alone.values()) and all(among[k][1] and abs(among[k][0] - alone[k][0]) < 0.01 for k in alone) and not any(among[k][1] for k in among if k >= 1000)


def test_limits_are_fitted_on_labels(spark):
    """The limits reject no document labelled good, are what `fitted` gives with a small margin, and catch over 0.9 of the bad."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    report = cut(quality.quality_report(labelled), "report")
    chars, words_ = quality.fitted(report, labels)
    assert 0 < quality.CHAR_LIMIT - chars < 0.02 and 0 < quality.WORD_LIMIT - words_ < 0.02
    found = report.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(x.quality, x.kept): x["count"] for x in found}
    assert n.get((1, False), 0) == 0 and n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_filter_keeps_columns_and_clean_rows(spark):
    r = rng(3)
    docs = documents(spark, [(k, " ".join(words(r, 60))) for k in range(20)] + [(99, "short"), (100, None)]).withColumnRenamed("n_chars", "n_words")
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == set(range(20))
    assert quality.quality_report(docs.limit(0)).count() == 0
    assert quality.quality_filter(docs.limit(0)).count() == 0
