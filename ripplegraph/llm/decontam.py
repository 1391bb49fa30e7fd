"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

Documents stream through the automaton, which tracks the longest match that ends at each word. A match of 13 words or
more ends a window: its last 13 words belong to one state, which knows their items; shorter items are one window each and are
found along the suffix links. States are kept in arrays, a few machine words each, and only those with more than one
continuation have entries in a table.

Items are a stated query set: they are dealt into blocks of at most `block_bytes` of text, items of more are cut into pieces
that share the words of a window less one, and every document passes every block's automaton. One block is held at a time,
by the driver as by a Python worker: with several blocks each is a pass of its own over the texts, which leaves only the
hits, and these go back to the rows by the texts' digests. So what is held is bounded however large the benchmark is.

Defined cases: null texts have no words, an item without words has no window, repeated items and rows count by id and
row, also with null or equal ids (a null item_id hits words but isn't listed), ties don't arise, very long texts and items are
taken whole; empty tables give n_items 0 or empty results; other columns stay as they are in remove_contamination, whatever
their names (but `__hits`, `__text`).
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ripplegraph.llm.util import cut, small_batches, table

WINDOW, COVERAGE = 13, 20
BLOCK_BYTES, PIECE_WORDS = 4 << 20, 50_000
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


_NONE, _MANY = -1, -2


class SuffixAutomaton:
    """Of all items' word sequences. Of the arrays by state, `word` and `to` hold the only continuation; `many` has the others."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.word, self.to = array("i", [_NONE]), array("i", [_NONE])
        self.many: dict[int, int] = {}  # state and word in one number
        self.words_of_many: list[array] = []  # at the place that `to` has for such a state; only cloning needs them
        self.link, self.len = array("i", [-1]), array("i", [0])
        self.items = [x for x, _ in items]
        texts, ends = [], []
        for k, (_, text) in enumerate(items):
            words = array("i", [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)])
            last = 0
            for w in words:
                last = self._extend(last, w)
            if len(words) >= window:
                texts.append((k, words))
            elif len(words):
                ends.append((last, k))
        self._settle(texts, ends)

    def step(self, state: int, w: int) -> int:
        """The state after one more word, _NONE if no item goes on like this."""
        own = self.word[state]
        if own == w:
            return self.to[state]
        return self.many.get(state << 32 | w, _NONE) if own == _MANY else _NONE

    def _put(self, state: int, w: int, to: int) -> None:
        own = self.word[state]
        if own in (_NONE, w):
            self.word[state], self.to[state] = w, to
            return
        if own != _MANY:
            self.many[state << 32 | own] = self.to[state]
            self.word[state], self.to[state] = _MANY, len(self.words_of_many)
            self.words_of_many.append(array("i", [own]))
        if state << 32 | w not in self.many:
            self.words_of_many[self.to[state]].append(w)
        self.many[state << 32 | w] = to

    def _new(self, length: int, link: int) -> int:
        self.word.append(_NONE)
        self.to.append(_NONE)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _extend(self, last: int, w: int) -> int:
        q = self.step(last, w)
        if q != _NONE:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        new = self._new(self.len[last] + 1, 0)
        p = last
        while p != -1 and (q := self.step(p, w)) == _NONE:
            self._put(p, w, new)
            p = self.link[p]
        if p != -1:
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._new(self.len[p] + 1, self.link[q])
        for x in self.words_of_many[self.to[q]] if self.word[q] == _MANY else (self.word[q],):
            if x != _NONE:
                self._put(c, x, self.step(q, x))
        self.link[q] = c
        while p != -1 and self.step(p, w) == q:
            self._put(p, w, c)
            p = self.link[p]
        return c

    def _settle(self, texts: list, ends: list) -> None:
        """What matching needs by state: the state of the last `window` words, the nearest short item, and items."""
        self.words_of_many = []
        size = len(self.len)
        self.holder, self.short = array("i", [_NONE]) * size, array("i", [0]) * size
        self.short_items: dict[int, list[int]] = {}
        for state, k in ends:
            self.short_items.setdefault(state, []).append(k)
        for s in sorted(range(1, size), key=self.len.__getitem__):
            up = self.link[s]
            if self.len[s] >= self.window:
                self.holder[s] = s if self.len[up] < self.window else self.holder[up]
            self.short[s] = s if s in self.short_items else self.short[up]
        self.one, self.more = array("i", [_NONE]) * size, {}  # items by holder
        for k, words in texts:
            s = 0
            for n, w in enumerate(words, 1):
                s = self.step(s, w)
                if n < self.window:
                    continue
                h = self.holder[s]
                if self.one[h] == _NONE:
                    self.one[h] = k
                elif self.one[h] != k:
                    own = self.more.setdefault(h, [])
                    if not own or own[-1] != k:
                        own.append(k)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The merged word ranges [start, end) inside windows, and the items whose windows occur."""
        word, to, many, link, length = self.word, self.to, self.many, self.link, self.len
        short, holder, window = self.short, self.holder, self.window
        state = matched = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for i, w in enumerate(map(self.ids.get, words), 1):
            if w is None:
                state = matched = 0
                continue
            while True:
                own = word[state]
                step = to[state] if own == w else many.get(state << 32 | w, _NONE) if own == _MANY else _NONE
                if step != _NONE or not state:
                    break
                state = link[state]
                matched = length[state]
            if step == _NONE:
                continue
            state = step
            matched += 1
            if matched >= window:
                h = holder[state]
                found.add(self.one[h])
                found.update(self.more.get(h, ()))
                spans.append((i - window, i))
            s = short[state]
            while s:
                if length[s] <= matched:
                    found.update(self.short_items[s])
                    spans.append((i - length[s], i))
                s = short[link[s]]
        return merged(spans), {self.items[k] for k in found}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_built: dict[int, SuffixAutomaton] = {}


def _automaton(block, window: int) -> SuffixAutomaton:
    """One block's automaton is held at a time in a Python worker."""
    if block.id not in _built:
        _built.clear()
        _built[block.id] = SuffixAutomaton(block.value, window)
    return _built[block.id]


class _Broadcast:
    """A broadcast block with an id that workers can tell it by."""

    def __init__(self, spark: SparkSession, rows: list):
        self.at = spark.sparkContext.broadcast(rows)
        self.id = self.at._jbroadcast.id()

    def __getstate__(self):
        return {"at": self.at, "id": self.id}

    @property
    def value(self):
        return self.at.value


def _pieces(window: int, piece_words: int):
    """Different items in pieces of normalised text; pieces of an item share window - 1 words, so no window is lost."""

    def run(batches):
        for b in batches:
            out = []
            for item, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words = words_of(text)
                for k in range(0, max(len(words) - window + 1, 1), piece_words):
                    if words:
                        out.append((item, b" ".join(words[k : k + piece_words + window - 1]).decode()))
            items, texts = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], ["item", "text"])

    return run


def blocks_of(items: DataFrame, item_id: str, text: str, block_bytes: int, window: int = WINDOW, piece_words: int = PIECE_WORDS) -> tuple[int, object]:
    """How many blocks the benchmark's words make, and an iterator over them as broadcast lists of (item, text).

    Pieces are dealt by a hash to buckets, whose sizes are summed; neighbouring buckets that fit together make a block. Buckets are
    made smaller until each fits, or is a single piece.
    """
    few = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    few = cut(small_batches(few).mapInArrow(_pieces(window, piece_words), "item string, text string").distinct(), "benchmark-pieces")
    size = F.octet_length("text") + 64
    total, longest, n = few.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-int(total) * 8 // block_bytes)) if total > block_bytes else 1
    while True:
        at = F.pmod(F.xxhash64("item", "text"), F.lit(buckets))
        sizes = few.groupBy(at.alias("k")).agg(F.sum(size).alias("s")).orderBy("k").collect() if n else []  # one number a bucket
        if not sizes or max(r.s for r in sizes) <= max(block_bytes, longest):
            break
        buckets *= 2
    ranges: list[list[int]] = []
    held = 0
    for r in sizes:
        if not ranges or held + r.s > block_bytes:
            ranges.append([r.k, r.k])
            held = 0
        ranges[-1][1] = r.k
        held += r.s

    def each():
        for low, high in ranges:
            rows = few.where(at.between(low, high)).collect()  # at most block_bytes, or one piece
            yield _Broadcast(items.sparkSession, sorted(((r.item, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or "", r[1])))

    return len(ranges), each()


HITS = "struct<n:bigint,starts:array<int>,ends:array<int>,items:array<string>>"


_HITS_ARROW = pa.struct([("n", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _joined(many: list[dict]) -> dict:
    """The hits of several blocks as one."""
    spans = merged([x for h in many for x in zip(h["starts"], h["ends"], strict=True)])
    return {"n": many[0]["n"], "starts": [a for a, _ in spans], "ends": [z for _, z in spans], "items": sorted({x for h in many for x in h["items"]})}


def _hits(auto: SuffixAutomaton | None, text: str | None) -> dict:
    words = words_of(text)
    spans, found = auto.matches(words) if auto else ([], set())
    return {"n": len(words), "starts": [a for a, _ in spans], "ends": [z for _, z in spans], "items": sorted(x for x in found if x is not None)}


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, piece_words: int = PIECE_WORDS, finish=None, schema: StructType | None = None) -> DataFrame:
    """docs with a column `__hits`: the number of words, the merged word ranges hit and the ids of the items with occurring windows.

    finish: what the last pass makes of a batch and its hits, with `schema`, in the same Python worker.
    """
    names, at = docs.columns, docs.columns.index(text)
    mine = StructType([*docs.schema.fields, *StructType.fromDDL(f"__hits {HITS}").fields])

    def made(b, out):
        return finish(b, out) if finish else pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, _HITS_ARROW)], [*names, "__hits"])

    n, blocks = blocks_of(items, item_id, item_text, block_bytes, window, piece_words)
    if n <= 1:
        block = next(blocks, None)

        def one(batches):
            auto = _automaton(block, window) if block else None
            for b in batches:
                yield made(b, [_hits(auto, t) for t in b.column(at).to_pylist()])

        return small_batches(docs).mapInArrow(one, schema if finish else mine)

    key = F.struct(F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit("hits"), F.col(text)).alias("b"))
    few = small_batches(docs).where(F.col(text) != "").select(key["a"].alias("a"), key["b"].alias("b"), F.col(text).alias("text"))

    def hits_of(block):
        def run(batches):
            auto = _automaton(block, window)
            for b in batches:
                out = [_hits(auto, t) for t in b.column(2).to_pylist()]
                rows = [k for k, h in enumerate(out) if h["starts"]]
                few = b.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array([out[k] for k in rows], _HITS_ARROW)], ["a", "b", "h"])

        return run

    found = None
    for block in blocks:
        part = few.mapInArrow(hits_of(block), f"a bigint, b bigint, h {HITS}").groupBy("a", "b").agg(F.first("h").alias("h"))  # copies have equal hits
        part = cut(part, "hits")
        block.at.unpersist()
        found = part if found is None else found.unionByName(part)
    found = cut(found.groupBy("a", "b").agg(F.collect_list("h").alias("h")), "all-hits")  # one of each block
    keyed = docs.withColumn("__text", key)
    held = keyed.join(found, (F.col("__text.a") == found["a"]) & (F.col("__text.b") == found["b"]), "left").select(*[docs[c] for c in names], found["h"].alias("__hits"))

    def whole(batches):
        for b in batches:
            yield made(b, [_joined(h) if h else _hits(None, t) for t, h in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)])

    return held.mapInArrow(whole, schema if finish else mine)


def n_hit(h: dict) -> int:
    return sum(b - a for a, b in zip(h["starts"], h["ends"], strict=True))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of docs: n_words, n_hit, items (ids as sorted strings), contaminated."""
    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = with_hits(few, items, **how)
    hit = F.aggregate(F.zip_with("__hits.ends", "__hits.starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    out = found.select("doc_id", F.col("__hits.n").alias("n_words"), hit.alias("n_hit"), F.col("__hits.items").alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * COVERAGE >= F.col("n_words")))


def remove_contamination(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, coverage: int = COVERAGE, **how) -> DataFrame:
    """docs without contaminated rows (hit words are 1/coverage of all or more); in the others hit spans are cut out of the text."""
    names, at = docs.columns, docs.columns.index(text)

    def clean(b, hits):
        rows, texts = [], []
        for k, (t, h) in enumerate(zip(b.column(at).to_pylist(), hits, strict=True)):
            n = n_hit(h)
            if n and n * coverage >= h["n"]:
                continue
            rows.append(k)
            texts.append(without_words(t, list(zip(h["starts"], h["ends"], strict=True))) if n else t)
        out = b.take(pa.array(rows, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if k == at else out.column(k) for k in range(len(names))], names)

    return with_hits(docs, items, text, window=window, finish=clean, schema=docs.schema, **how)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode()
    kept = raw.translate(_KEEP)
    at, places = 0, []
    for w in kept.split():
        a = kept.index(w, at)
        at = a + len(w)
        places.append((a, at))
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")
