"""Quality rules: base counts, and the Jensen-Shannon distance of a document's histograms from its language's reference.

Native: all of it is DataFrame functions. One pass over the text gives the counts and two histograms per row: character
classes, and the language's common words. A reference is the mean of the histograms, as shares, over the different texts of
a language that pass the base rules and have MIN_WORDS words: copies vote once, long texts as much as short ones. It is
trimmed TRIMS times to the texts whose distance is within the mean and one standard deviation, so that junk, if it isn't the
rule, has no part in it. References are a row for each language and join by it.

A text of n characters or words that were drawn from the reference would itself be at a distance of about
sqrt((classes - 1) / (8 n ln 2)). What a distance has over that is compared with the limits, and texts under a minimum
length aren't judged by distance.

Defined cases: null text has no words; null lang is a language of its own, named ''; empty tables give empty results;
repeated rows, also with null or equal ids, are judged alike; very long texts are counted whole; a language without a word list
is judged by its characters alone, one without a text that counts for the reference by the base rules alone; other columns
stay as they are, whatever their names (but `__q`, `__d`, `__v`, `__lang`, `__ref`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.util import cut, table

# The commonest words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in is that it for on with as are be this was or at by from".split(),
    "es": "de la que el en y a los se del las por un para con no una su al es".split(),
    "fr": "de la le et les des en un une du que est pour qui dans sur pas au par avec".split(),
}
# The characters of each class and its sign; other characters are a class of their own.
CLASSES = {
    "v": "aeiou",
    "c": "bcdfghjklmnpqrstvwxyz",
    "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0": "0123456789",
    ".": ".,;:!?'\"()-",
    "#": "#*$%&|<>@/\\[]{}=+_^~`",
    " ": " ",
}
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Distances over the expected one above which a document is rejected, and the lengths below which no distance counts.
#: `fitted` on the labelled rows of the 10,000-document sample gives 0.1603 and 0.1029; these have a small margin.
CHAR_LIMIT, WORD_LIMIT, MIN_CHARS, MIN_WORDS, TRIMS = 0.165, 0.105, 600, 50, 3
MOST_LABELS = 1_000_000


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str, by: str = "") -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more; windows are compared by a 64-bit hash of their words' hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def count(w: Column) -> Column:
        by_hash = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        again = let(by_hash, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        covered = let(F.sort_array(F.transform(again, lambda x: x["p"])), lambda d: F.aggregate(F.transform(d, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(d, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered)

    return F.when(F.size(words) < WINDOW, 0).otherwise(let(windows_of(words, windows), count))


def windows_of(words: Column, windows) -> Column:
    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with a struct column `__q`: the text's digest, the base counts and the two histograms."""
    t = F.coalesce(F.col(text), F.lit(""))
    spaced = _without(t, "\t\n\x0b\x0c\r", " ")
    signs = "".join(k * len(v) for k, v in CLASSES.items())
    coded = F.translate(spaced, "".join(CLASSES.values()), signs)
    empty_words = F.array().cast("array<string>")
    common = F.lit(None)
    for k, v in COMMON_WORDS.items():
        common = F.when(F.coalesce(F.col(lang), F.lit("")) == k, F.array(*[F.lit(x) for x in v])).otherwise(common)
    df = docs.withColumn("__t", F.struct(t.alias("text"), spaced.alias("spaced")))
    df = df.withColumn("__w", F.array_remove(F.split(F.col("__t.spaced"), " "), ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    n = F.size("__w")

    def hits(listed: Column) -> Column:
        return let(F.filter(F.col("__w"), lambda w: F.array_contains(listed, w)), lambda found: F.transform(listed, lambda x: F.size(F.filter(found, lambda y: y == x)).cast("long")))

    word_hist = F.coalesce(let(F.coalesce(common, empty_words), lambda x: F.when(F.size(x) > 0, hits(x)).otherwise(F.array().cast("array<bigint>"))), F.array().cast("array<bigint>"))
    chars = let(coded, lambda c: F.array(F.char_length(c).cast("long"), *[(F.octet_length(c) - F.octet_length(F.replace(c, F.lit(k), F.lit("")))).cast("long") for k in CLASSES]))
    q = F.struct(
        F.xxhash64(t).alias("digest"),
        n.cast("long").alias("n_words"),
        F.char_length(F.replace(F.col("__t.spaced"), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.octet_length(t) - F.octet_length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__w")).cast("long").alias("n_repeat_words"),
        chars.alias("chars"),
        word_hist.alias("common"),
    )
    return df.withColumn("__q", q).drop("__t", "__w")


def _shares(total: Column, parts: Column) -> Column:
    """Shares of the parts and of what they leave."""
    rest = total - F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.transform(F.concat(parts, F.array(rest)), lambda x: x / total)


def _char_shares() -> Column:
    return _shares(F.col("__q.chars")[0], F.slice("__q.chars", 2, len(CLASSES)))


def _word_shares() -> Column:
    return _shares(F.col("__q.n_words"), F.col("__q.common"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1: the root of the divergence in bits."""
    half = lambda a, b: F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(0.0)
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a)), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def expected(classes: Column, n: Column) -> Column:
    """The distance that a sample of n from the reference would have."""
    return F.sqrt((classes - 1) / (n * 8 * math.log(2)))


def base_failed() -> Column:
    return (F.col("__q.n_words") < 20) | (F.col("__q.n_repeat_words") * 100 > F.col("__q.n_words") * 30)


def references(features_df: DataFrame, lang: str = "lang", trims: int = TRIMS) -> DataFrame:
    """The trimmed mean histograms of each language. Columns `__lang`, `__ref`."""
    of = F.coalesce(F.col(lang), F.lit("")).alias("__lang")
    votes = features_df.where(~base_failed() & (F.col("__q.n_words") >= MIN_WORDS)).select(of, F.col("__q.digest").alias("digest"), _char_shares().alias("c"), _word_shares().alias("w"))
    votes = cut(votes.groupBy("__lang", "digest").agg(F.first("c").alias("c"), F.first("w").alias("w")), "quality-votes")
    n_chars, n_words = len(CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 1

    def mean(df: DataFrame) -> DataFrame:
        got = df.groupBy("__lang").agg(*[F.avg(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(n_chars)], *[F.avg(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(n_words)])
        shares = F.struct(F.array(*[f"c{i}" for i in range(n_chars)]).alias("chars"), F.filter(F.array(*[f"w{i}" for i in range(n_words)]), F.isnotnull).alias("common"))
        return cut(got.select("__lang", shares.alias("__ref")), "quality-refs")

    refs = mean(votes)
    for _ in range(trims):
        at = votes.join(refs, "__lang").withColumn("d", js_distance(F.col("c"), F.col("__ref.chars")))
        most = cut(at.groupBy("__lang").agg((F.avg("d") + F.stddev_pop("d")).alias("most")), "quality-spread")
        refs = mean(at.join(most, "__lang").where("d <= most + 1e-9").select("__lang", "c", "w"))
    return refs


def verdicts(features_df: DataFrame, refs: DataFrame, lang: str = "lang", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """features_df with `__v`: base_failed, both distances, kept."""
    df = features_df.join(refs, F.coalesce(F.col(lang), F.lit("")) == F.col("__lang"), "left")
    n_chars, n_words, listed = F.col("__q.chars")[0], F.col("__q.n_words"), F.size("__q.common")
    known = F.col("__ref").isNotNull()
    chars = F.when((n_chars >= MIN_CHARS) & known, js_distance(_char_shares(), F.col("__ref.chars")))
    words = F.when((n_words >= MIN_WORDS) & known & (listed > 0), js_distance(_word_shares(), F.col("__ref.common")))
    over = lambda d, classes, n: F.coalesce(d - expected(classes, n), F.lit(0.0))
    df = df.withColumn("__d", F.struct(base_failed().alias("base_failed"), F.coalesce(chars, F.lit(0.0)).alias("char_distance"), F.coalesce(words, F.lit(0.0)).alias("word_distance"), over(chars, F.lit(len(CLASSES) + 1), n_chars).alias("char_excess"), over(words, listed + 1, n_words).alias("word_excess")))
    kept = ~F.col("__d.base_failed") & (F.col("__d.char_excess") <= char_limit) & (F.col("__d.word_excess") <= word_limit)
    return df.withColumn("__v", F.struct("__d.*", kept.alias("kept"))).drop("__d", "__lang", "__ref")


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs with its counts, distances and verdict."""
    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    found = cut(features(few).select("doc_id", "lang", "__q"), "quality")
    out = verdicts(found, references(found))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    distances = ["char_distance", "word_distance", "char_excess", "word_excess"]
    return out.select("doc_id", *[F.col(f"__q.{x}").alias(x) for x in names], "__v.base_failed", "__v.kept", *[F.round(F.col(f"__v.{x}"), 9).alias(x) for x in distances])


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with their columns. Counts and histograms are made once and written beside the rows,
    which aren't shuffled."""
    found = cut(features(docs, text, lang), "quality-rows")
    return verdicts(found, references(found, lang), lang).where("__v.kept").select(*docs.columns)


def fitted(report: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> tuple[float, float]:
    """The least limits that reject no document labelled good, from at most `most_labels` labelled rows (by least hash of id)."""
    good = labels.where("quality = 1").orderBy(F.xxhash64("doc_id")).limit(most_labels).select("doc_id")
    row = report.where("not base_failed").join(good, "doc_id").agg(F.max("char_excess"), F.max("word_excess")).first()
    return tuple(row)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))
