"""Queries over documents, embeddings, conversations, events and pages: redaction, search, guards, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import ids, text, web
from ripplegraph.operators import govern, html, retrieve
from ripplegraph.operators.mappers import Context
from ripplegraph.plans.registered import query
from ripplegraph.streaming import limiter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_REDACT = f"regexp_replace(regexp_replace(regexp_replace(text, '{text.EMAIL}', '[REDACTED_EMAIL]', 'g'), '{text.SECRET}', '\\1=[REDACTED_SECRET]', 'g'), '{text.BEARER}', 'Bearer [REDACTED_SECRET]', 'g')"
_TOKENS = f"list_filter(list_distinct(string_split_regex(lower(text), '{text.TOKEN_BREAK}')), lambda x: x <> '')"


@query("redact_documents", f"SELECT doc_id, {_REDACT} AS redacted FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query("audit_redact", f"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '{text.EMAIL}', '[REDACTED_EMAIL]', 'g'), '{text.AUDIT_SECRET}', '\\1=[REDACTED_SECRET]', 'g') AS redacted FROM conversations")
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.audit_redact(F.col("text")).alias("redacted"))


@query("tokenize_documents", f"SELECT doc_id, array_to_string(list_sort({_TOKENS}), ' ') AS tokens, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens FROM documents")
def _(spark, sf_dir):
    t = text.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(t), " ").alias("tokens"), F.size(t).cast("long").alias("n_tokens"))


_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(t, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296)"


@query(
    "token_hash_embedding",
    f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents), h AS (SELECT doc_id, {_HASH} AS h FROM t), s AS (SELECT doc_id, (((h - CASE WHEN h >= 2147483648 THEN 4294967296 ELSE 0 END) % 48) + 48) % 48 AS slot, count(*) AS n FROM h GROUP BY 1, 2)"
    " SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS value FROM s",
)
def _(spark, sf_dir):
    return text.embedding_slots(table(spark, sf_dir, "documents"), "doc_id", "text", 48).withColumn("value", F.round("value", 9))


_QUERY = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


@query("vector_topk", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY}), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = e.crossJoin(F.broadcast(one)).select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))  # one vector
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


def indexed(spark: SparkSession, sf_dir: str, dimensions: int = 64) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.lit("shop").alias("project_id"), F.lit("snap-1").alias("snapshot_id"), F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("body"), text.token_embedding(F.col("text"), dimensions).alias("embedding"), F.col("doc_id").alias("ord"))


@query("exact_search", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, CAST(1.0 AS DOUBLE) AS score, doc_id AS ord FROM documents WHERE contains(lower(source), 'thereer') OR contains(lower(text), 'thereer')")
def _(spark, sf_dir):
    return retrieve.exact_search(indexed(spark, sf_dir, 1), "Thereer", "shop", "snap-1")


@query("hybrid_search")
def _(spark, sf_dir):
    docs = indexed(spark, sf_dir)
    near = docs.select("id", "title", "ord")

    def expand(seeds: DataFrame) -> DataFrame:
        """A document leads to the next two."""
        at = seeds.select(F.col("place").alias("seed_place"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k"), F.col("id").cast("long").alias("from"))
        return at.join(near, at["from"] + at["k"] == near["ord"]).select("seed_place", F.col("k").alias("ord"), "id", "title", F.lit(0.5).alias("score"))

    return retrieve.hybrid_search(docs, "thereof these and that", "shop", "snap-1", 10, expand=expand)


_PACK = f"s AS (SELECT doc_id, {_REDACT} AS snippet FROM documents), r AS (SELECT *, sum(length(snippet)) OVER (ORDER BY doc_id) AS used FROM s), k AS (SELECT * FROM r WHERE used <= 60000)"


@query(
    "evidence_pack",
    f"WITH {_PACK}, p AS (SELECT string_agg('doc/' || doc_id || ':1', ', ' ORDER BY doc_id) AS paths, count(*) AS n, CAST(sum(length(snippet)) AS BIGINT) AS chars FROM k) SELECT 'ep-' || substring(translate(to_base64(unhex(sha256('shop|snap-1|[' || paths || ']'))), '+/', '-_'), 1, 12) AS id, paths, n, chars, n < (SELECT count(*) FROM documents) AS truncated FROM p",
)
def _(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("line_start"), F.col("text").alias("snippet"), F.col("doc_id").alias("ord"))
    chars = F.aggregate(F.transform("snippets", lambda x: F.char_length(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return retrieve.evidence_pack(s, "shop", "snap-1", 60000).select("id", F.array_join("evidence_paths", ", ").alias("paths"), F.size("evidence_paths").cast("long").alias("n"), chars.alias("chars"), "truncated")


_ASK = "the of then there una para"


@query(
    "historical_recall",
    f"WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id, {_TOKENS} AS tokens FROM conversations), o AS (SELECT id, CAST(len(list_intersect(tokens, string_split('{_ASK}', ' '))) AS INTEGER) AS n_shared, conv_id AS created_at FROM t) SELECT * FROM o WHERE n_shared > 0 ORDER BY n_shared DESC, created_at DESC, id LIMIT 30",
)
def _(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.col("conv_id").alias("created_at"))
    return retrieve.recall(items, _ASK, 30)


@query("short_hashes", "SELECT doc_id, substring(translate(to_base64(unhex(sha256(text))), '+/', '-_'), 1, 12) AS hash FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.short_hash(F.col("text")).alias("hash"))


@query("index_names", "SELECT source, 'index_' || regexp_replace(source || '-' || lang, '[^A-Za-z0-9_]', '_', 'g') AS name FROM documents GROUP BY source, lang")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    return d.select("source", F.concat(F.lit("index_"), text.sanitize_name(F.concat_ws("-", "source", "lang"))).alias("name"))


# --- guards and limits ---

_GUARD = (
    f"CASE WHEN regexp_matches(text, '^(?:{govern.RAW_STATEMENT})$') THEN 'raw Cypher or SQL is not allowed' WHEN regexp_matches(text, '{govern.FILE_GLOB}') THEN 'file glob is not allowed' WHEN regexp_matches(text, '{govern.SHELL}') THEN 'shell command is not allowed' ELSE '' END"
).replace("(?is)", "").replace("'^(?:", "'(?is)^(?:")


@query("guard_decisions", f"SELECT conv_id, turn, {_GUARD} AS reason FROM conversations")
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(govern.argument_rejection(F.lit("text"), F.col("text")), F.lit("")).alias("reason"))


_KEPT = "list_filter(r.log, lambda x: x > epoch_us(e.ts) - 21600000000)"


@query(
    "rate_limiter",
    "WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS principal, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT principal, ts, event_id, rn, true AS accepted, [epoch_us(ts)] AS log FROM e WHERE rn = 1"
    f" UNION ALL SELECT e.principal, e.ts, e.event_id, e.rn, len({_KEPT}) < 20, CASE WHEN len({_KEPT}) < 20 THEN list_append({_KEPT}, epoch_us(e.ts)) ELSE {_KEPT} END FROM r JOIN e ON e.principal = r.principal AND e.rn = r.rn + 1) SELECT principal, ts, event_id, accepted FROM r",
)
def _(spark, sf_dir):
    """Each user may make 20 requests in 6 hours."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("principal"), "ts", "event_id")
    return limiter.limit(e, 20, 6 * 3600)


@query(
    "event_audit",
    "SELECT CAST(event_id AS VARCHAR) AS request_id, 'u' || user_id AS principal, 'shop' AS project_id, event_type AS tool_name, 'mail=[REDACTED_EMAIL],note=token=[REDACTED_SECRET]' AS parameter_summary, CASE WHEN value > 50 THEN 0 ELSE 3 END AS result_count, 'redacted' AS redaction_state, CASE WHEN value > 50 THEN 'rate limited' END AS rejection_reason FROM events",
)
def _(spark, sf_dir):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    arguments = F.create_map(F.lit("mail"), F.concat(user, F.lit("@shop.example")), F.lit("note"), F.concat(F.lit("token="), F.col("event_type"), F.col("event_id").cast("string")))
    rejected = F.col("value") > 50
    calls = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("request_id"), user.alias("principal"), F.lit("shop").alias("project_id"), F.col("event_type").alias("tool_name"), arguments.alias("arguments"), F.when(~rejected, 3).alias("result_count"), F.when(rejected, "rate limited").alias("reason"))
    return govern.audit(calls)


# --- pages ---

_HREFS = (
    "m AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script(?:[\\s/][^>]*)?>.*?</script\\s*>', '', 'g') AS h FROM pages),"
    " a AS (SELECT page_id, url, list_filter(list_transform(regexp_extract_all(h, '(?i)<a[\\s/]((?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*)>', 1), lambda x: regexp_extract(x, '(?i)href\\s*=\\s*\"([^\"]*)\"', 1)), lambda x: trim(x) <> '') AS hrefs FROM m),"
    " l AS (SELECT page_id, url, unnest(hrefs) AS href, CAST(unnest(range(len(hrefs))) AS INTEGER) AS position FROM a)"
)


@query("html_links", f"WITH {_HREFS} SELECT page_id, position, href, NOT (starts_with(href, '#') OR (regexp_matches(href, '^[A-Za-z0-9+.-]+:') AND NOT regexp_matches(href, '(?i)^https?:'))) AS navigable FROM l")
def _(spark, sf_dir):
    return html.html_links(table(spark, sf_dir, "pages"))


_BARE = "regexp_replace(trim(href), '[?#].*$', '')"
_SEGMENTS = "list_filter(string_split(regexp_replace(x, '\\\\', '/', 'g'), '/'), lambda y: trim(y) NOT IN ('', '.'))"
#: '..' takes the segment before away; a list of segments is gone through by reduce
_COLLAPSED = "array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(" + _SEGMENTS + ", lambda y: [y])), lambda a, y: CASE WHEN y[1] = '..' THEN a[1 : greatest(len(a) - 1, 0)] ELSE list_concat(a, y) END), '/')"
_LOCAL = _COLLAPSED.replace("(x, ", f"({_BARE}, ")
_EXTERNAL = _COLLAPSED.replace("(x, ", f"(regexp_replace(regexp_replace({_BARE}, '^(//|[A-Za-z0-9+.-]+://)', ''), '[^A-Za-z0-9/._~-]', '-', 'g'), ")


@query(
    "link_targets",
    f"WITH {_HREFS}, t AS (SELECT page_id, position, CASE WHEN regexp_matches(trim(href), '^(//|[A-Za-z0-9+.-]+://)') THEN 'external/' || CASE WHEN starts_with(trim(href), '//') THEN 'protocol-relative' ELSE lower(split_part(trim(href), '://', 1)) END || '/' || CASE WHEN {_EXTERNAL} = '' THEN '_root' ELSE {_EXTERNAL} END"
    f" WHEN starts_with(trim(href), '?') THEN 'index.html' WHEN regexp_matches({_BARE}, '^[A-Za-z0-9+.-]+:') THEN {_BARE} ELSE {_LOCAL} END AS path FROM l) SELECT page_id, position, CASE WHEN trim(path) = '' THEN '_root' ELSE path END AS path FROM t",
)
def _(spark, sf_dir):
    links = html.html_links(table(spark, sf_dir, "pages"))
    return links.select("page_id", "position", web.route(web.resolve(F.lit("index.html"), F.col("href"))).alias("path"))


_PATH = "CASE WHEN p = '' THEN '_root' ELSE p END"
_PAGES = "p AS (SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z0-9+.-]+://[^/]*', ''), '/'), lambda x: trim(x) <> ''), '/') AS p FROM pages)"


@query("page_entrypoints", f"WITH {_PAGES} SELECT page_id, {_PATH} AS path, 'entrypoint://shop/_root/_entrypoints/html/' || {_PATH} AS entrypoint FROM p")
def _(spark, sf_dir):
    return html.page_entrypoints(table(spark, sf_dir, "pages"), Context(root="src/main/webapp"))


@query("html_facts", f"WITH {_HREFS}, p AS (SELECT page_id, count(*) AS n FROM l GROUP BY 1) SELECT 'pages' AS what, count(*) AS n FROM pages UNION ALL SELECT 'links', CAST(sum(n) AS BIGINT) FROM p")
def _(spark, sf_dir):
    rows = html.html_rows(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html"))
    kinds = rows.groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.select(F.concat("kind", F.lit("s")).alias("what"), "n")


@query("html_fact_rows")
def _(spark, sf_dir):
    """All facts of all pages."""
    p = table(spark, sf_dir, "pages")
    rows = html.html_rows(p.select(html.page_path(F.col("url")).alias("path"), "html"))
    return html.html_facts(rows, Context(root="src/main/webapp"))
