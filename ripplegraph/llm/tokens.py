"""Token counts with a digest cache.

Each document has the SHA-256 of its content (null as empty; the content is otherwise taken as it is, since any other
normalisation could change a count) and the tokenizer its own digest, of its file. The digests are joined to the cache;
content that is missing there is encoded once, however many copies it has, and appended. Only the documents that carry a
miss to the encoder are moved, by id; copies are told apart by their small digest rows.

Defined cases: null text counts as empty (no bytes, no tokens); rows that repeat an id or a text, with null ids too, each get
their text's count; ties (copies with one id) are encoded once all the same; very long texts are encoded whole; an empty
table gives an empty result and appends nothing; other columns aren't looked at, whatever their names. Losing an executor repeats
its tasks; a cache append is a Spark commit, so it is whole or absent. A run's own cache begins empty in the query; tests run
it again on a filled one.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.util import cut, fresh_path, small_batches, table

TOKENIZER, LIMIT, BATCH = "piece_bpe_32k.model", 4096, 64
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens bigint"


class Counter:
    """Counts tokens as the library for a tokenizer file gives them, with nothing added or cut."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.counts = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            self.counts = lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]
        else:
            raise ValueError(f"no library for {path}")


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _encode(path: str):
    """Count each distinct digest of a partition once; equal ids and digests are in one partition."""

    def run(batches):
        seen: set[str] = set()
        count = counter(path).counts
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                digests, texts = [], []
                for d, t in zip(b.column(0).slice(k, BATCH).to_pylist(), b.column(1).slice(k, BATCH).to_pylist(), strict=True):
                    if d not in seen:
                        seen.add(d)
                        digests.append(d)
                        texts.append(t)
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(count(texts), pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. cache_path: a Parquet table that is read and appended to."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    d = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("digest", F.sha2("text", 256))
    own = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if _exists(spark, cache_path) else spark.createDataFrame([], CACHE_SCHEMA)
    known = own.where(F.col("tokenizer") == version).select("digest")
    first = d.groupBy("digest").agg(F.min("doc_id").alias("carrier"))
    misses = first.join(known, "digest", "left_anti").select(F.col("digest").alias("m"), "carrier")
    todo = d.join(misses, d.doc_id.eqNullSafe(F.col("carrier")) & (d.digest == F.col("m")), "left_semi")
    done = todo.select("digest", "text").mapInArrow(_encode(tokenizer_path), "digest string, n_tokens bigint")
    done.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    cached = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    cached = cut(cached, "token-counts")  # a join with a table of its own can be split where a digest is very common
    sizes = d.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(cached, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), fresh_path(spark, "token-cache"))
