import re

from ripplegraph.llm import decontam
from tests.llm.helpers import documents, rng, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    doc, hit, found = split(text), set(), []
    for item, t in items:
        w = split(t)
        windows = {tuple(w[k : k + 13]) for k in range(len(w) - 12)} or ({tuple(w)} if w else set())
        ok = False
        for x in windows:
            for k in range(len(doc) - len(x) + 1):
                if tuple(doc[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    ok = True
        if ok and item is not None:
            found.append(str(item))
    return len(doc), len(hit), sorted(set(found))


def cases():
    r = rng(8)
    small = ["a", "b", "C", "é1"]
    items = [(k, " ".join(words(r, n, small))) for k, n in enumerate([1, 2, 5, 12, 13, 14, 20, 30, 30])]
    items += [(20, None), (21, "--"), (22, items[6][1]), (3, "zz, yy! xx"), (None, "qq rr")]
    texts = [None, "", "...", "zz-YY xx", "qq rr qq", "a"]
    for n in (10, 60, 300):
        texts += [" ".join(words(r, n, small)) for _ in range(4)]
        texts += [" ".join(words(r, n, [*small, "other", "words"]) + items[7][1].split()[:13] + words(r, n)) for _ in range(3)]
    return items, texts


def test_matches_brute_force(spark):
    items, texts = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [*enumerate(texts), (3, texts[3])])
    for how in ({}, {"block_bytes": 500}, {"block_bytes": 150, "piece_words": 3}):
        got = decontam.contamination(docs, bench, **how).collect()
        assert len(got) == len(texts) + 1
        for x in got:
            n, hit, found = brute(texts[x.doc_id], items)
            assert (x.n_words, x.n_hit, x["items"]) == (n, hit, found), (how, texts[x.doc_id])
            assert x.contaminated == (hit > 0 and 20 * hit >= n)


def test_removal(spark):
    r = rng(9)
    passage = words(r, 20, [f"w{k}" for k in range(50)])
    bench = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    clean, big = " ".join(words(r, 30)), words(r, 2000)
    docs = documents(spark, [(1, clean), (2, " ".join([*words(r, 10), *passage])), (3, " ".join([*big[:50], *passage, *big[50:]])), (4, None)]).withColumnRenamed("lang", "items")
    kept = {x.doc_id: x.text for x in decontam.remove_contamination(docs, bench).collect()}
    assert kept.keys() == {1, 3, 4} and kept[1] == clean and kept[4] is None
    assert kept[3].split() == big
    assert decontam.remove_contamination(docs, bench).columns == docs.columns
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_automaton_matches_brute_force_on_long_items():
    r = rng(19)
    for _ in range(60):
        v = [f"w{k}" for k in range(r.choice([1, 2, 3, 40]))]
        items = [(k, " ".join(words(r, r.randrange(1, 60), v))) for k in range(r.randrange(1, 8))]
        auto = decontam.SuffixAutomaton(items)
        for _ in range(4):
            text = " ".join(words(r, r.randrange(120), [*v, "x"]))
            spans, found = auto.matches(decontam.words_of(text))
            assert (len(split(text)), sum(b - a for a, b in spans), sorted(map(str, found))) == brute(text, items)


def test_memory_of_a_block():
    """A full block of words that are all different, the worst case of text, is under 100 bytes a byte of text, as a whole under 400 MB."""
    import tracemalloc

    size = decontam.BLOCK_BYTES // 8
    items = [(k, " ".join(f"{(k * 997 + j) * 2654435761 % (1 << 32):07x}"[:7] for j in range(997))) for k in range(size // 8 // 997)]
    tracemalloc.start()
    auto = decontam.SuffixAutomaton(items)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    text = sum(len(t) for _, t in items)
    assert auto.items and peak / text < 95, (held, peak, text)
    assert peak / text * decontam.BLOCK_BYTES < 400 << 20


def test_long_items_are_cut_without_losing_windows(spark):
    r = rng(21)
    text = " ".join(words(r, 400, [f"w{k}" for k in range(30)]))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = documents(spark, [(k, " ".join(text.split()[k : k + 13])) for k in range(388)])
    for piece in (1, 7, 50):
        assert decontam.contamination(docs, bench, piece_words=piece, block_bytes=2000).where("n_hit = 13 and items = array('1')").count() == 388
