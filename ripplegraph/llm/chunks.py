"""Substring dedup by content-defined chunking.

A gear rolling hash of the last 32 bytes runs over the bytes of a text. A chunk starts where the hash is the least within
`radius` bytes on either side, so boundaries depend on nearby content alone: an insertion only changes the chunks about
it, and repeated passages are cut alike wherever they stand. Equal least hashes close together only stand in periodic
text; of these every one that is more than radius after the last counts, and the whole periods between are cut alike
too. Chunks are compared by a 64-bit digest; of equal chunks the first, by doc_id, content and place, is kept.

A run of repeated chunks in a row is a repeated span. Runs of one chunk or under `min_bytes` are left, as short phrases recur by
chance and equal digests of unequal chunks can't make a span on their own; spans that are a whole document are kept whatever
their length, if the first document's chunk has the same size. `min_bytes=0` keeps every run of two chunks.

A row is told from others by its id and a hash of its text, not by its id alone. Defined cases: null and empty texts have
no chunks; text shorter than a chunk is one; rows that repeat both id and text are one document (no repeat of itself) and
give their spans once; null ids come last in the order, and rows with null or equal ids but different texts are
different documents; very long texts are cut whole; empty tables give empty results; other columns stay as they are in
remove_repeats, whatever their names (but `__row`, `__spans`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.llm.util import cut, small_batches, table

RADIUS, MIN_BYTES, SEED = 20, 80, 6
_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(raw: bytes) -> np.ndarray:
    """h[i] = sum over k < 32 of gear[raw[i - k]] << k, modulo 2**32: the usual recurrence, by doubling."""
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)  # the right side is made before it is added
    return h


def boundaries(raw: bytes, radius: int = RADIUS) -> list[int]:
    """Starts of the chunks: 0, and least hashes within radius that are more than radius apart."""
    n = len(raw)
    if n <= radius:
        return [0] if n else []
    h = gear(raw)
    top = np.uint32(0xFFFFFFFF)
    padded = np.concatenate((np.full(radius, top), h, np.full(radius, top)))
    least, span = padded, 1  # least[i]: over padded[i : i + span]
    while span * 2 <= radius:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    window = np.minimum(least[: n + radius + 1], least[radius - span : radius - span + n + radius + 1])  # over radius values
    before, after = window[:n], window[radius + 1 : radius + 1 + n]
    at = np.flatnonzero((h <= before) & (h <= after))
    out, last = [0], -radius - 1
    for b in at[at > 0].tolist():
        if b - last <= radius:
            continue
        last = b
        while raw[b] & 0xC0 == 0x80:  # back to the start of a character
            b -= 1
        if b != out[-1]:
            out.append(b)
    return out


def _chunks(batches):
    for b in batches:
        rows, starts, sizes, last, digests = [], [], [], [], []
        for k, t in enumerate(b.column(2).to_pylist()):
            raw = t.encode() if t else b""
            at = boundaries(raw)
            ends = [*at[1:], len(raw)] if at else []
            rows += [k] * len(at)
            starts += at
            sizes += [z - a for a, z in zip(at, ends, strict=True)]
            last += [z == len(raw) for z in ends]
            digests += [xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(at, ends, strict=True)]
        rows = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(rows), b.column(1).take(rows), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(last, pa.bool_()), pa.array(np.array(digests, np.uint64).view(np.int64))],
            ["doc_id", "row", "start", "size", "last", "digest"],
        )


def _row(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.col(text).cast("string"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, with_row: bool = False) -> DataFrame:
    """doc_id, start, end (bytes of the text in UTF-8), n_chunks, first_doc_id (that has the span's first chunk first); with_row: and
    the hash of id and text that tells rows apart."""
    few = small_batches(docs).select(F.col(doc_id).alias("doc_id"), _row(doc_id, text).alias("row"), F.col(text).cast("string").alias("text"))
    kind = few.schema["doc_id"].dataType.simpleString()
    made = cut(few.mapInArrow(_chunks, f"doc_id {kind}, row bigint, start int, size int, last boolean, digest bigint"), "chunks")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("start").alias("s"), F.col("size").alias("z"))
    firsts = made.groupBy("digest").agg(F.min(order).alias("f"), F.max(order).alias("l")).where("f <> l")
    firsts = cut(firsts.select("digest", "f"), "repeated-digests")  # a join with a table of its own can be split where a digest is very common
    again = made.join(firsts, "digest").where(~(F.col("doc_id").eqNullSafe(F.col("f.d")) & (F.col("row") == F.col("f.r")) & (F.col("start") == F.col("f.s"))))
    again = again.select("doc_id", "row", "start", "size", "last", F.col("f.d").alias("first_doc"), (F.col("f.z") == F.col("size")).alias("same")).distinct()
    w = Window.partitionBy("doc_id", "row").orderBy("start")
    runs = again.withColumn("new", (F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("size")).over(w), F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(w))
    spans = runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.count("*").alias("n_chunks"), F.min_by("first_doc", "start").alias("first_doc_id"), (F.bool_or("last") & F.bool_and("same")).alias("to_end"))
    spans = spans.where((F.col("n_chunks") > 1) & (F.col("end") - F.col("start") >= min_bytes) | (F.col("start") == 0) & F.col("to_end"))
    return spans.select("doc_id", "start", "end", "n_chunks", "first_doc_id", *["row"][:with_row])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with the repeated spans cut out of the texts."""
    spans = repeated_spans(docs, doc_id, text, with_row=True, **how).groupBy(F.col("row").alias("__row"), F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    keyed = docs.withColumn("__row", _row(doc_id, text))
    held = keyed.join(spans.withColumnRenamed("__row", "__r"), (F.col("__row") == F.col("__r")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left").drop("__id", "__r", "__row")
    names, at = docs.columns, docs.columns.index(text)

    def clean(batches):
        for b in batches:
            texts = []
            for t, spans in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if spans:
                    raw, out, last = t.encode(), [], 0
                    for s in spans:
                        out.append(raw[last : s["start"]])
                        last = s["end"]
                    t = b"".join([*out, raw[last:]]).decode()
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if k == at else b.column(k) for k in range(len(names))], names)

    return held.mapInArrow(clean, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
