"""Text functions as columns: redaction, tokens, hashed embeddings, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is redacted, and by what, in this order.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SECRET = r"(?i)(api[_-]?key|token|secret)\s*[:=]\s*[^\s,;]+"
BEARER = r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+"
AUDIT_SECRET = r"(?i)(token|secret|api[_-]?key)\s*[:=]\s*[^\s,;]+"
TOKEN_BREAK = "[^a-z0-9_#./-]+"


def redact(text: Column) -> Column:
    text = F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]")
    text = F.regexp_replace(text, SECRET, "$1=[REDACTED_SECRET]")
    return F.regexp_replace(text, BEARER, "Bearer [REDACTED_SECRET]")


def audit_redact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]"), AUDIT_SECRET, "$1=[REDACTED_SECRET]")


def tokenize(text: Column) -> Column:
    """Distinct lower-case tokens, in first-seen order."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), ""))


def java_hash(token: Column) -> Column:
    """The 32-bit string hash with multiplier 31, of an ASCII token, as a signed long."""
    h = F.aggregate(F.split(token, ""), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def token_embedding(text: Column, dimensions: int) -> Column:
    """A unit vector of token counts by hash; all zeros for no tokens."""
    slots = F.transform(tokenize(text), lambda t: F.pmod(java_hash(t), F.lit(dimensions)))
    counts = F.transform(F.array(slots), lambda s: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(s, lambda x: x == k)).cast("double")))[0]
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    pair = F.transform(F.array(counts), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))[0]
    return F.transform(F.array(pair), lambda p: F.transform(p["v"], lambda x: F.when(p["n"] == 0, F.lit(0.0)).otherwise(x / p["n"])))[0]


def embedding_slots(df: DataFrame, key: str, text: str, dimensions: int) -> DataFrame:
    """key, slot, value of the unit vectors of token_embedding where they aren't 0: rows of tokens instead of arrays, so that each
    token is hashed and counted once. Keys are distinct."""
    tokens = df.select(key, F.explode(tokenize(F.col(text))).alias("token"))
    counts = tokens.groupBy(key, F.pmod(java_hash(F.col("token")), F.lit(dimensions)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))  # at most `dimensions` rows
    return counts.select(key, "slot", (F.col("n") / norm).alias("value"))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if either part is all zeros."""
    n = F.least(F.size(a), F.size(b))
    a = F.slice(a.cast("array<double>"), F.lit(1), n)
    b = F.slice(b.cast("array<double>"), F.lit(1), n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot, aa, bb = total(F.zip_with(a, b, lambda x, y: x * y)), total(F.transform(a, lambda x: x * x)), total(F.transform(b, lambda x: x * x))
    return F.when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(dot / (F.sqrt(aa) * F.sqrt(bb)))


def contains_exact(text: Column, query: str) -> Column:
    return F.lower(text).contains(query.lower())


def overlap(text: Column, query: str) -> Column:
    """How many distinct tokens of the text are among the query's."""
    return F.size(F.array_intersect(tokenize(text), tokenize(F.lit(query))))


def sanitize_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def snake_case(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, "(?<!^)([A-Z])", "_$1"))


def encrypt_key(plain: Column, key: bytes) -> Column:
    """AES-GCM under the SHA-256 of a key, as Base64 of nonce, text and tag."""
    return F.base64(F.aes_encrypt(plain, F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM"), F.lit("NONE")))


def decrypt_key(packed: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(packed), F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM"), F.lit("NONE")).cast("string")
