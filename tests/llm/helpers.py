import random

WORDS = ["the", "of", "and", "to", "in", "is", "that", "it", "cat", "sat", "on", "mat", "dog", "ran", "far", "é", "Über", "x1"]


def words(rng, n, vocabulary=WORDS):
    return [rng.choice(vocabulary) for _ in range(n)]


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], "doc_id long, text string, lang string, source string, n_chars long")


def rng(seed=1):
    return random.Random(seed)
