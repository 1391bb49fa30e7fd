import public_tokenizers
import pytest

import sentencepiece
from tokenizers import Tokenizer

from ripplegraph.llm import tokens
from tests.llm.helpers import documents, rng, words


def counted(name):
    """How many tokens the library itself makes of a text."""
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        whole = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(whole.encode(t or "", out_type=int))
    whole = Tokenizer.from_file(path)
    return lambda t: len(whole.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_and_cache(spark, tmp_path, name):
    r = rng(13)
    path = public_tokenizers.path(name)
    texts = [None, "", " ", "hello </s> <s> <unk> <|endoftext|>", "é😀\n\n  tab\t"] + [" ".join(words(r, n)) for n in (5, 500, 9000, 60_000)] * 3
    rows = [*enumerate(texts), (5, texts[5]), (None, "orphan words"), (None, "other orphan words")]
    docs = documents(spark, rows).withColumnsRenamed({"lang": "digest", "source": "tokenizer", "n_chars": "n_tokens"}).repartition(3)
    cache = f"file://{tmp_path}/cache"
    got = tokens.token_counts(docs, path, cache).collect()
    assert len(got) == len(rows)
    count = counted(name)
    want = sorted((k if k is not None else -1, len((t or "").encode()), count(t), count(t) > 4096) for k, t in rows)
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_bytes, x.n_tokens, x.over_limit) for x in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in rows})
    before = stored.count()
    more = documents(spark, [(1, texts[6]), (2, "a new text")])
    assert {x.doc_id: x.n_tokens for x in tokens.token_counts(more, path, cache).collect()} == {1: count(texts[6]), 2: count("a new text")}
    assert spark.read.parquet(cache).count() == before + 1
    assert tokens.token_counts(docs.limit(0), path, f"file://{tmp_path}/none").count() == 0
