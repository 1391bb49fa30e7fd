"""The queries of this subpackage, and their SQL where SQL can express them."""

import string

from ripplegraph.llm import chunks, decontam, extract, lm, mixing, pii, quality, simhash, tokens, warc

QUERIES = {
    "op1_extract": extract.op1,
    "op2_pii": pii.op2,
    "op3_warc": warc.op3,
    "op4_katz": lm.op4,
    "op5_tokens": tokens.op5,
    "op6_chunks": chunks.op6,
    "op7_simhash": simhash.op7,
    "op8_mixing": mixing.op8,
    "op9_decontaminate": decontam.op9,
    "op10_quality": quality.op10,
}

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUP = "CAST('0x' || substring(h, x * 5 + 1, 5) AS BIGINT)"
_BASE32 = "array_to_string(list_transform(range(8), lambda x: " + " || ".join(f"substring('{_DIGITS}', CAST((({_GROUP} >> {k}) & 31) + 1 AS INTEGER), 1)" for k in (15, 10, 5, 0)) + "), '')"

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_WINDOWS = (
    f"b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), i AS (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0), n AS (SELECT DISTINCT item_id, l, array_to_string(w[k : k + l - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS k FROM i)),"
    f" d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents), s AS (SELECT DISTINCT l FROM n), p AS (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, s),"
    " h AS (SELECT rid, k, l, item_id FROM (SELECT rid, k, l, array_to_string(w[k : k + l - 1], ' ') AS win FROM p) JOIN n USING (l, win)),"
    " c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(k, k + l)) AS pos FROM h) GROUP BY 1), f AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h WHERE item_id IS NOT NULL GROUP BY 1)"
)


def _quality_sql() -> str:
    """The base counts, both histograms by counting, the trimmed references round by round, and the distances."""
    t = "coalesce(text, '')"
    every = "".join(quality.CLASSES.values())
    quoted = every.replace("'", "''")
    coded = "".join(k * len(v) for k, v in quality.CLASSES.items())
    space = "regexp_replace(" + t + ", '[\\t\\n\\x0B\\f\\r]', ' ', 'g')"
    chars = ", ".join(["length(coded)", *[f"length(coded) - length(replace(coded, '{k}', ''))" for k in quality.CLASSES]])
    lists = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in quality.COMMON_WORDS.items())
    half = "CASE WHEN {a} > 0 THEN {a} * log2({a} * 2 / ({a} + {b})) ELSE 0 END"
    term = f"{half.format(a='x[1]', b='x[2]')} + {half.format(a='x[2]', b='x[1]')}"
    distance = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x: {term})) / 2, 0))"
    share = lambda total, parts: f"list_transform(list_append({parts}, {total} - coalesce(list_sum({parts}), 0)), lambda x: x / {total})"
    n_chars, n_words = len(quality.CLASSES) + 1, max(map(len, quality.COMMON_WORDS.values())) + 1
    mean = f"list_value({', '.join(f'avg(cs[{i + 1}])' for i in range(n_chars))}) AS rc, list_filter(list_value({', '.join(f'avg(ws[{i + 1}])' for i in range(n_words))}), lambda x: x IS NOT NULL) AS rw"
    rounds = f" u0 AS (SELECT lang, {mean} FROM v GROUP BY 1),"
    for k in range(quality.TRIMS):
        rounds += f" e{k} AS (SELECT v.*, {distance('cs', 'rc')} AS d FROM v JOIN u{k} USING (lang)), m{k} AS (SELECT lang, avg(d) + stddev_pop(d) AS most FROM e{k} GROUP BY 1), u{k + 1} AS (SELECT lang, {mean} FROM e{k} JOIN m{k} USING (lang) WHERE d <= most + 1e-9 GROUP BY 1),"
    failed = "n_words < 20 OR 100 * n_repeat > 30 * n_words"
    expected = lambda classes, n: f"sqrt(({classes} - 1) / ({n} * 8 * ln(2)))"
    return (
        f"WITH a AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, {t} AS t, {space} AS sp FROM documents),"
        f" b AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, translate(sp, '{quoted}', '{coded}') AS coded, CASE lang {lists} ELSE [] END AS listed FROM a),"
        f" c AS (SELECT rid, doc_id, lang, t, w, len(w) AS n_words, length(replace(sp, ' ', '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, [{chars}] AS ch, list_transform(listed, lambda x: len(list_filter(w, lambda y: y = x))) AS cw FROM b),"
        " k AS (SELECT rid, unnest(range(1, len(w) - 6)) AS pos, w FROM c), g AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS n FROM (SELECT rid, pos, array_to_string(w[pos : pos + 7], ' ') AS win FROM k)), r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + 8)) AS p FROM g WHERE n > 1) GROUP BY 1),"
        f" f AS (SELECT c.*, coalesce(r.n, 0) AS n_repeat, {share('c.ch[1]', 'c.ch[2:]')} AS cs, {share('n_words', 'c.cw')} AS ws FROM c LEFT JOIN r ON r.rid = c.rid),"
        f" v AS (SELECT DISTINCT ON (lang, t) lang, cs, ws FROM f WHERE NOT ({failed}) AND n_words >= {quality.MIN_WORDS}),"
        + rounds
        + f" j AS (SELECT f.*, CASE WHEN ch[1] >= {quality.MIN_CHARS} AND rc IS NOT NULL THEN {distance('cs', 'rc')} END AS dc, CASE WHEN n_words >= {quality.MIN_WORDS} AND rc IS NOT NULL AND len(cw) > 0 THEN {distance('ws', 'rw')} END AS dw FROM f LEFT JOIN u{quality.TRIMS} USING (lang)),"
        f" o AS (SELECT *, coalesce(dc - {expected(n_chars, 'ch[1]')}, 0) AS oc, coalesce(dw - {expected('(len(cw) + 1)', 'n_words')}, 0) AS ow FROM j)"
        f" SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words, {failed} AS base_failed,"
        f" NOT ({failed}) AND oc <= {quality.CHAR_LIMIT} AND ow <= {quality.WORD_LIMIT} AS kept, round(coalesce(dc, 0), 9) + 0.0 AS char_distance, round(coalesce(dw, 0), 9) + 0.0 AS word_distance, round(oc, 9) + 0.0 AS char_excess, round(ow, 9) + 0.0 AS word_excess FROM o"
    )


#: For those that SQL expresses; the others are tested against brute force.
ORACLE_SQL = {
    "op3_warc": f"WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS last FROM p) SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m",
    "op9_decontaminate": f"WITH {_WINDOWS} SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN f USING (rid)",
    "op10_quality": _quality_sql(),
}
