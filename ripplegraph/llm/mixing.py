"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Weights are proportional to (token share) ** x. x is the largest value in 0..1 at which the weights' entropy reaches
`entropy_share` of the most there can be and, if `max_repeats` is given, the smallest at which no source is repeated more
often; it is found by sectioning an interval that brackets it (16 parts a round, so 8 rounds halve it 32 times).

A source's budget is its weight times the token budget. Its documents are put in an order by a hash of their content and the
epoch and taken epoch by epoch until the budget is used up; a document's place in its budget, as a share, gives its block,
so each block holds all sources by weight. Places are running sums in two levels: ranges of the hash per source and epoch are
summed first, so no task takes a source whole, however hot. The number of ranges grows with the root of the rows, so that both a
source's ranges and a range's rows stay few.

Native: DataFrame functions only. Rows are told apart by 128 bits of their content, so the mixture doesn't depend on how
they are partitioned. Defined cases: null text has no tokens and its document is taken with the place it falls on; null
source is a source of its own; rows with null or repeated ids are documents of their own; rows that are equal in every
column stand next to each other in the order, each with a place; very long texts count whole; an empty table gives an
empty result. In `mixed` a column with the name of one of the mixture's gives way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.llm.util import cut, table

ENTROPY_SHARE, MAX_REPEATS, BUDGET_SHARE, BLOCKS, SEED = 0.97, 4.0, 1.0, 64, 11
PARTS, ROUNDS = 16, 8


def token_count(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(t, " "), "")).cast("long")


def exponent(tokens: DataFrame, budget: float, entropy_share: float, max_repeats: float | None) -> float:
    """The exponent for a table of source and tokens (one row a source)."""

    total = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if not total:
        return 1.0

    def measured(xs: list[float]) -> dict[float, tuple[float, float]]:
        t = tokens.where("tokens > 0").withColumn("x", F.explode(F.array(*map(F.lit, xs))))
        p = t.withColumn("w", F.pow(F.col("tokens") / F.lit(float(total)), F.col("x")))
        # entropy of w / sum(w) = log(sum w) - sum(w log w) / sum w
        sums = p.groupBy("x").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.log("w")).alias("l"), F.count("*").alias("n"), F.max(F.col("w") / F.col("tokens")).alias("r"))
        share = F.when(F.col("n") > 1, (F.log("s") - F.col("l") / F.col("s")) / F.log("n")).otherwise(1.0)
        return {r.x: (r.share, r.repeats) for r in sums.select("x", share.alias("share"), (F.col("r") * budget / F.col("s")).alias("repeats")).collect()}

    def section(ok) -> tuple[float, float]:
        """The last bracket low..high with ok true at low only; ok turns from true to false once."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            xs = [low + (high - low) * k / PARTS for k in range(PARTS + 1)]
            got = measured(xs)
            good = [ok(*got[x]) for x in xs]
            if all(good):
                return high, high
            if not good[0]:
                return low, low
            k = good.index(False)
            low, high = xs[k - 1], xs[k]
        return low, high

    flat = section(lambda share, repeats: share >= entropy_share)[0]
    if max_repeats is None:
        return flat
    # repeats fall as the exponent grows, so the limit is met from the other side
    least = section(lambda share, repeats: repeats > max_repeats)[1]
    return max(flat, least)


def source_weights(docs: DataFrame, source: str, tokens: str, budget_share: float = BUDGET_SHARE, entropy_share: float = ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """source, tokens, weight, budget. One row a source."""
    sums = cut(docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")), "mix-sources")
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = float(total) * budget_share
    x = exponent(sums, budget, entropy_share, max_repeats)
    p = sums.withColumn("w", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(x))).otherwise(0.0))
    whole = float(p.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] or 1.0) or 1.0
    return p.select("source", "tokens", (F.col("w") / whole).alias("weight"), F.round(F.col("w") / whole * budget).cast("long").alias("budget"))


def _keyed(docs: DataFrame) -> DataFrame:
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    return docs.withColumns({"__h": F.xxhash64(*plain), "__g": F.xxhash64(F.lit("mix"), *reversed(plain))})


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", blocks: int = BLOCKS, ranges: int | None = None, seed: int = SEED, keys: bool = False, **how) -> DataFrame:
    """The mixture: doc_id, source, epoch, n_tokens, block, place (in the block, a sort key), weight; keys: and the rows' content hashes.

    A document is in it once for each epoch in which it falls within its source's budget.
    """
    d = _keyed(docs).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), token_count(F.col(text)).alias("n_tokens"), "__h", "__g")
    d = cut(d, "mix-tokens")
    ranges = ranges or max(16, 4 * math.isqrt(d.count()))
    weights = cut(source_weights(d, "source", "n_tokens", **how), "mix-weights")
    epochs = F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int")
    one = weights.select(F.col("source").alias("s"), "tokens", "weight", "budget", epochs.alias("epochs")).where("epochs > 0")
    e = d.join(one, F.col("source").eqNullSafe(F.col("s"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    e = e.withColumn("h", F.pmod(F.xxhash64("__h", "epoch", F.lit(seed)), F.lit(1 << 40)))
    e = e.withColumn("r", F.floor(F.col("h") * ranges / (1 << 40)).cast("int")).drop("s")
    # level one: what the ranges before hold
    sums = e.groupBy("source", "epoch", "r").agg(F.sum("n_tokens").alias("n"))
    before = sums.select(F.col("source").alias("s2"), F.col("epoch").alias("e2"), F.col("r").alias("r2"), (F.sum("n").over(Window.partitionBy("source", "epoch").orderBy("r")) - F.col("n")).alias("before"))
    # level two: the documents before in the range
    own = Window.partitionBy("source", "epoch", "r").orderBy("h", "__h", "__g").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("within", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    e = e.join(cut(before, "mix-ranges"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("epoch") == F.col("e2")) & (F.col("r") == F.col("r2")))
    at = F.col("epoch") * F.col("tokens") + F.col("before") + F.col("within")
    e = e.withColumn("at", at).where((F.col("at") + F.col("n_tokens") <= F.col("budget")))
    block = F.least(F.floor(F.col("at") * blocks / F.greatest("budget", F.lit(1))), F.lit(blocks - 1)).cast("int")
    return e.select("doc_id", "source", "epoch", "n_tokens", block.alias("block"), F.xxhash64("__h", "epoch", F.lit(seed + 1)).alias("place"), "weight", *(["__h", "__g"] if keys else []))


MIXTURE = ["epoch", "n_tokens", "block", "place", "weight"]


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture with its documents: the columns of docs, and those of MIXTURE. Texts move once, to meet the places by content."""
    plan = mix(docs, keys=True, **how).select("__h", "__g", *MIXTURE)
    kept = [c for c in docs.columns if c not in MIXTURE]
    one = _keyed(docs).dropDuplicates(["__h", "__g"]).select(*kept, "__h", "__g")  # equal rows have their places in the plan
    return one.join(cut(plan, "mix-plan"), ["__h", "__g"]).select(*kept, *MIXTURE)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
