"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of 32 segments of two bits. The Manhattan distance of two embeddings
is a lower bound of the Hamming distance. The segments form groups; within Manhattan distance d at least groups - d groups
agree, so the grid cells are the counts of each choice of that many groups, and pairs that share a cell are filtered by
Manhattan distance and then verified bit by bit. The more fingerprints there are, the more groups: cells then are made of
more segments, so that unrelated fingerprints rarely share one, whatever the size of the corpus (`groups_for`).

What is left of crowded cells are fingerprints that are near each other, as in a large group of near copies. In cells of
more than `dense` pairs would cost more than a fingerprint's 64 one-bit neighbours, so those fingerprints are linked by
these: any two within two bits share a neighbour at one bit or less from both. Both ways give the components of the full
link graph. Links are between fingerprints, so ids play no part in them.

Defined cases: null text has no words; no words give fingerprint zero, linked like any other; repeated rows and ties
share a component; rows with null or repeated ids link like others; component_id is the smallest id that isn't null, null if
there is none; very long texts are hashed whole; empty tables give empty results; other columns are kept by keep_one,
whatever their names (but those that start with `__`).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.util import components, cut, small_batches, table

SHINGLE, SEED, BITS = 3, 42, 2
DENSE = 64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=False)], dtype=np.uint64)
    else:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, and the columns `keys` of longs: one row per row of docs, fp as a signed long."""
    few = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *keys)
    more = "".join(f", {k} bigint" for k in keys)

    def run(batches):
        for b in batches:
            values = np.array([fingerprint(x) for x in b.column(1).to_pylist()], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values), *b.columns[2:]], ["doc_id", "fp", *keys])

    return few.mapInArrow(run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, fp bigint{more}")


def _segment_counts(fp: Column) -> Column:
    """The embedding, kept in one long: each two-bit field holds its segment's bit count (0 to 2)."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _manhattan(a: str, b: str) -> Column:
    """Sum of the fields' absolute differences: fields differ by as many as their tests "1 or more" and "2" differ in."""
    odd = F.lit(0x5555555555555555)
    two = lambda c: F.shiftrightunsigned(F.col(c), 1).bitwiseAND(odd)
    one = lambda c: F.col(c).bitwiseOR(F.shiftrightunsigned(F.col(c), 1)).bitwiseAND(odd)
    return F.bit_count(two(a).bitwiseXOR(two(b))) + F.bit_count(one(a).bitwiseXOR(one(b)))


def groups_for(n: int, distance: int = 2) -> int:
    """The fewest groups with which a fingerprint shares a cell with less than one unrelated one, of n. Two bits of random
    fingerprints have equal counts in 6 of 16 cases."""
    groups = distance + 2
    while groups < 16 and n * (6 / 16) ** (32 * (groups - distance) // groups) >= 1:
        groups += 1
    return groups


def links(nodes: DataFrame, distance: int = 2, groups: int | None = None, dense: int = DENSE) -> DataFrame:
    """Edges a, b between the ids of nodes (id, fp; fp distinct) whose components are those of all links.

    distance: at most 2, for which the dense cells' way is exact.
    """
    groups = groups or groups_for(nodes.count(), distance)
    if not 0 <= distance <= 2 or groups <= distance:
        raise ValueError("distance is 0 to 2 and less than groups")
    edges = [32 * g // groups * 2 for g in range(groups + 1)]
    mask = lambda own: sum((1 << edges[g + 1]) - (1 << edges[g]) for g in own)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    cells = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("emb").bitwiseAND(F.lit(signed(mask(own))).cast("long")).alias("cell")) for k, own in enumerate(combinations(range(groups), groups - distance))])
    n = nodes.withColumn("emb", _segment_counts(F.col("fp")))
    keyed = n.withColumn("at", F.explode(cells)).select("id", "fp", "emb", "at.choice", "at.cell")
    sizes = cut(keyed.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    sparse = keyed.join(sizes.where(F.col("n") <= dense).select("choice", "cell"), ["choice", "cell"], "left_semi")
    x, y = sparse.alias("x"), sparse.select(F.col("id").alias("id2"), F.col("fp").alias("fp2"), F.col("emb").alias("emb2"), "choice", "cell")
    pairs = x.join(y, ["choice", "cell"]).where("id < id2").where(_manhattan("emb", "emb2") <= distance).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)
    pairs = pairs.select(F.col("id").alias("a"), F.col("id2").alias("b"))
    crowd = keyed.join(sizes.where(F.col("n") > dense).select("choice", "cell"), ["choice", "cell"], "left_semi").select("id", "fp").distinct()
    if distance < 2:  # then meeting at one bit from both is too far; neighbours are looked up instead
        flips = F.array(*[F.lit(signed(1 << k)).cast("long") for k in range(64 * (distance > 0))]) if distance else F.array().cast("array<bigint>")
        near = crowd.select(F.col("id").alias("a"), F.explode(F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b))).alias("fp"))
        return pairs.unionByName(near.join(crowd.select(F.col("id").alias("b"), "fp"), "fp").select("a", "b"))
    hubs = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << k)).cast("long") for k in range(64)])
    at = crowd.select("id", F.explode(F.transform(hubs, lambda b: F.col("fp").bitwiseXOR(b))).alias("hub"))
    lows = at.groupBy("hub").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("hub", "a")
    met = at.join(lows, "hub").where("a < id").select("a", F.col("id").alias("b"))
    return pairs.unionByName(met)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, groups: int | None = None, dense: int = DENSE, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id and `keys` for each row of docs, and `group`: a fingerprint that stands for the component."""
    fps = cut(fingerprints(docs, doc_id, text, keys), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    comp = components(links(nodes.select(F.col("fp").alias("id"), "fp"), distance, groups, dense))
    of = cut(nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("group")), "fingerprint-groups")
    low = of.groupBy("group").agg(F.min("id").alias("component_id"))
    of = cut(of.join(low, "group").select("fp", "group", "component_id"), "fingerprint-components")  # a join with a table of its own can be split where a fingerprint is very common
    return fps.join(of, "fp").select("doc_id", "fp", "component_id", "group", *keys)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest doc_id (a null one last); of several with that id the one whose content
    has the least hash, and one of equal rows. Rows are told apart by 128 bits of their content, not by their ids."""
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    keyed = docs.withColumns({"__h": F.xxhash64(*plain), "__g": F.xxhash64(F.lit("keep"), *reversed(plain))})
    found = near_duplicates(keyed, doc_id, text, keys=("__h", "__g"))
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__h", "__g")).alias("f"))
    first = cut(first.select("f.__h", "f.__g"), "firsts")
    return keyed.join(first, ["__h", "__g"], "left_semi").dropDuplicates(["__h", "__g"]).select(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
