"""Katz backoff scoring, with counts of the training documents.

Each training word is a class of its own, however many there are; others are the end of a text (also the context of its
first word), and one class for all words that weren't seen. Counts of up to DISCOUNTED are discounted by Good-Turing at
both orders, by the counts of their order. Evaluated from the longest context down: a bigram (u, v) that was seen has
d2(c) c(u,v) / c(u); one that wasn't has alpha(u) times the share of v alone, which is d1(c) c(v) / N if v was seen, else
what all discounts of words leave. alpha(u) is what the seen bigrams of u leave over what the shares of their words leave
of one, so each context sums to one exactly. A context whose seen bigrams would leave less than 1 / (c(u) + 1) is scaled to
leave that; so are words to leave 1 / (N + 1).

Nothing is looked up row by row and no count is kept in one place. Documents are cut into groups of bounded size; a
group sends its distinct words (then its distinct bigrams) with their counts, dealt by hash, to where they are summed,
and gets the sums back in the order it sent them. Each word has a number from where its counts meet, and a bigram is the
exact pair of numbers. Of the groups that sent a bigram the first one owns it: it adds the bigram to its context's sums,
which are whole numbers, meet by word and go back to the groups, which make the weights. Frequent words cost one entry a group,
so no key is hot. Sums are tables in the shared folder, `kind` by `kind`; a lost executor repeats tasks from them. Only a few
totals and one number a part reach the driver, and are broadcast. A group has a row for each part, as a task of a shuffle has
a block for each reader, so on large clusters groups are as large as their memory lets them be (`group_tokens`).

Defined cases: null text has only its end; a null doc_id counts as the text ''; repeated rows, with equal ids or null ones,
count and are scored row by row; ties don't arise, as no word is ranked; very long texts make a group of their own; with an
empty training set c = N = V = 0; an empty table gives an empty result; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import marshal
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.util import by_group, fresh_path, small_batches, table

DISCOUNTED, GROUP_TOKENS, FOLDS, HELD_OUT = 5, 3_000_000, 7, 2
OTHER = 0  # the number of the class of unseen words; words have those after it
PART_BYTES, FAN = 64 << 20, 32
FIELDS = "g string, p int, payload binary, kind string"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def pack(x) -> bytes:
    return zlib.compress(marshal.dumps(x), 1)


def unpack(b: bytes):
    return marshal.loads(zlib.decompress(b))


_KINDS = {"B": np.uint8, "H": np.uint16, "I": np.uint32, "Q": np.uint64}


def ints(a: np.ndarray) -> bytes:
    """Small counts take a byte each; the type's sign comes first. Bytes of a place stand together, so that they pack well."""
    most = int(a.max()) if len(a) else 0
    kind = "B" if most < 1 << 8 else "H" if most < 1 << 16 else "I" if most < 1 << 32 else "Q"
    flat = np.ascontiguousarray(a, _KINDS[kind])
    return kind.encode() + flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes()


def from_ints(b: bytes) -> np.ndarray:
    kind = _KINDS[chr(b[0])]
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, offset=1).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel().astype(np.int64)


def _batch(rows: list[tuple]):
    g, p, payload, kind = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(p, pa.int32()), pa.array(payload, pa.binary()), pa.array(kind, pa.string())], ["g", "p", "payload", "kind"])


class _Local(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _groups(parts: int, group_tokens: int):
    """Pass 1: cut a partition's documents into groups; words become numbers of their group, dealt by hash."""

    def flush(name: str, local: _Local, ids: list, docs: list) -> list[tuple]:
        words = list(local)
        at = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words), np.int32, len(words))
        order = np.argsort(at, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        stream = place[np.concatenate(ids)]
        trained = np.repeat(np.array([not d[1] for d in docs]), [d[2] for d in docs])
        counts = np.bincount(stream[trained], minlength=len(words))
        ordered = [words[k] for k in order]
        out = [(name, -1, pack((docs, ints(stream))), "docs")]
        edges = np.searchsorted(at[order], np.arange(parts + 1))
        for p in range(parts):
            a, b = int(edges[p]), int(edges[p + 1])
            if a < b:
                out.append((name, p, pack((b"\n".join(ordered[a:b]), ints(counts[a:b]))), "words"))
        return out

    def run(batches):
        part, k, n = TaskContext.get().partitionId(), 0, 0
        local, ids, docs = _Local({b"": 0}), [], []
        for b in batches:
            for doc, text, held in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words = text.encode().lower().split() if text else []
                words.append(b"")
                ids.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
                docs.append((doc, held, len(words)))
                n += len(words)
                if n >= group_tokens:
                    yield _batch(flush(f"{part}-{k}", local, ids, docs))
                    k, n, local, ids, docs = k + 1, 0, _Local({b"": 0}), [], []
        if docs:
            yield _batch(flush(f"{part}-{k}", local, ids, docs))

    return run


def _sum_words(key, batches):
    """Pass 2, by p: words get numbers; these and the counts of all groups in each group's order; totals and counts of counts."""
    sent, index = [], _Local()
    for b in batches:
        for g, payload in zip(b.column("g").to_pylist(), b.column("payload").to_pylist(), strict=True):
            words, counts = unpack(payload)
            words = words.split(b"\n")
            sent.append((g, np.fromiter(map(index.__getitem__, words), np.uint32, len(words)), from_ints(counts).astype(np.uint32)))
    p = key[0].as_py()
    total = np.zeros(len(index), np.int64)
    for _, own, counts in sent:
        total[own] += counts
    for g, own, _ in sent:
        yield _batch([(g, p, pack((ints(own), ints(total[own]))), "counts")])
    end = index.get(b"")
    yield _batch([("", p, pack((int(total.sum()), int((total > 0).sum()), counts_of_counts(total), {p: len(index)}, None if end is None else (p, end))), "unigrams")])


def counts_of_counts(total: np.ndarray) -> list[int]:
    return [int((total == k).sum()) for k in range(1, DISCOUNTED + 2)]


class _Group:
    """A group with the sums of its words. Words are numbered as in its stream; the class of other words is the number after."""

    def __init__(self, docs_row: bytes, answers: dict[int, bytes], held):
        self.docs, stream = unpack(docs_row)
        self.stream = from_ints(stream).astype(np.int32)
        offsets, end, self.n, self.v, self.d1, unseen = held
        own = {p: [from_ints(x) for x in unpack(answers[p])] for p in sorted(answers)}
        self.count = np.concatenate([c for _, c in own.values()])
        ids = np.concatenate([k + offsets[p] for p, (k, _) in own.items()])
        self.mine = (self.count > 0) | (ids == end)
        # Contexts in the order of their parts, unseen words last.
        self.parts = {p: (k, self.mine[a : a + len(k)]) for (p, (k, _)), a in zip(own.items(), np.cumsum([0, *[len(k) for k, _ in own.values()]])[:-1].tolist(), strict=True)}
        other = len(ids)
        self.class_of = np.where(self.mine, np.arange(other), other).astype(np.int32)
        self.ids = np.append(ids, OTHER).astype(np.uint64)
        self.class_count = np.append(np.where(self.mine, self.count, 0), 0)
        self.p1 = word_shares(self.class_count, self.n, self.d1, unseen)
        self.starts = np.concatenate(([0], np.cumsum([d[2] for d in self.docs])[:-1])).astype(np.int64)
        self.end = int(np.flatnonzero(ids == end)[0])

    def sums(self, by_token: np.ndarray) -> np.ndarray:
        return np.add.reduceat(by_token, self.starts)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context and word of the distinct bigrams, and where each token's is; a text's end is the next one's context."""
        classes = self.class_of[self.stream]
        pairs = np.concatenate((np.array([self.end], np.int32), classes[:-1])).astype(np.uint64) << np.uint64(32) | classes.astype(np.uint64)
        pairs, back = np.unique(pairs, return_inverse=True)
        return (pairs >> np.uint64(32)).astype(np.int32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32), back

    def dealt(self, u: np.ndarray, w: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bigrams as pairs of words' numbers, their order by part and pair, and where the parts start in it."""
        pairs = self.ids[u] << np.uint64(32) | self.ids[w]
        at = dealt(pairs, parts)
        order = np.argsort(pairs)
        order = order[np.argsort(at[order], kind="stable")]
        return pairs, order, np.searchsorted(at[order], np.arange(parts + 1))


def _split(batches) -> dict[str, dict[int, bytes]]:
    """kind -> p -> payload."""
    out: dict[str, dict[int, bytes]] = {}
    for b in batches:
        for p, x, kind in zip(b.column("p").to_pylist(), b.column("payload").to_pylist(), b.column("kind").to_pylist(), strict=True):
            out.setdefault(kind, {})[p] = x
    return out


def _bigrams(held, parts: int):
    """Pass 3, by group: the group's distinct bigrams, dealt by hash."""

    def run(key, left, right):
        docs_row = [x for b in left for x in b.column("payload").to_pylist()]
        if not docs_row:
            return
        group = _Group(docs_row[0], _split(right)["counts"], held.value)
        g = key[0].as_py()
        trained = np.repeat(np.array([not d[1] for d in group.docs]), [d[2] for d in group.docs])
        u, w, back = group.bigrams()
        counts = np.bincount(back[trained], minlength=len(u))
        pairs, order, edges = group.dealt(u, w, parts)
        for p in range(parts):
            own = order[edges[p] : edges[p + 1]]
            if len(own):
                x = pairs[own]
                yield _batch([(g, p, pack((ints(np.diff(x >> np.uint64(32), prepend=np.uint64(0))), ints(x & np.uint64(0xFFFFFFFF)), ints(counts[own]))), "bigrams")])

    return run


def dealt(pairs: np.ndarray, parts: int) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _sum_bigrams(key, batches):
    """Pass 4, by p: twice the counts of all groups' bigrams, and one more for the group that owns it; counts of counts."""
    names, pairs, counts = [], [], []
    for b in batches:
        for g, payload in zip(b.column("g").to_pylist(), b.column("payload").to_pylist(), strict=True):
            gaps, words, n = unpack(payload)
            names.append(g)
            pairs.append(np.cumsum(from_ints(gaps)).astype(np.uint64) << np.uint64(32) | from_ints(words).astype(np.uint64))
            counts.append(from_ints(n).astype(np.uint32))
    p = key[0].as_py()
    sizes = [len(x) for x in counts]
    distinct, back = np.unique(np.concatenate(pairs), return_inverse=True)
    del pairs
    total = np.bincount(back, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    owned = np.zeros(len(back), np.int64)
    first = np.full(len(distinct), len(back), np.int64)
    np.minimum.at(first, back, np.arange(len(back)))
    owned[first] = 1
    at = 0
    for g, n in zip(names, sizes, strict=True):
        yield _batch([(g, p, pack(ints(2 * total[back[at : at + n]] + owned[at : at + n])), "totals")])
        at += n
    yield _batch([("", p, pack(counts_of_counts(total)), "seen")])


def _merge_seen(key, batches):
    found = [unpack(x) for b in batches for x in b.column("payload").to_pylist()]
    yield _batch([(key[0].as_py(), key[1].as_py(), pack([sum(x) for x in zip(*found, strict=True)]), "seen")])


def discounts(n: np.ndarray) -> np.ndarray:
    """d(1)..d(5) of an order from the counts of counts n(1)..n(6); where they don't give 0 < d < 1, half a count is taken off."""
    k = DISCOUNTED
    out = np.array([(r - 0.5) / r for r in range(1, k + 1)])
    if n[0] > 0:
        a = (k + 1) * n[k] / n[0]
        for r in range(1, k + 1):
            if n[r - 1] > 0 and a != 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a)
                if 0 < d < 1:
                    out[r - 1] = d
    return out


def factors(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discounted share of each count that is kept."""
    return np.concatenate(([0.0], d, [1.0]))[np.minimum(c, DISCOUNTED + 1)]


def word_shares(c: np.ndarray, n: int, d: np.ndarray, unseen: float) -> np.ndarray:
    """The shares of words by their counts; those that weren't seen are one class with `unseen` in all."""
    if not n:
        return np.full(len(c), 0.5)  # nothing but the end of a text and unseen words
    return np.where(c > 0, factors(c, d) * c / n * (1 - unseen_scale(n, d, unseen)), unseen)


def unseen_share(n: int, seen: list[int], d: np.ndarray) -> float:
    """What discounts leave of the words' shares, 1 / (N + 1) at least."""
    left = sum((1 - d[r - 1]) * r * seen[r - 1] for r in range(1, DISCOUNTED + 1)) / max(n, 1)
    return max(float(left), 1 / (n + 1))


def unseen_scale(n: int, d: np.ndarray, unseen: float) -> float:
    """How much the seen words give up beyond their discounts, as a share: only where these leave less than 1 / (N + 1)."""
    return unseen if unseen == 1 / (n + 1) else 0.0


SUMS = 2 * DISCOUNTED + 1


def backoff(sums: np.ndarray, c: np.ndarray, n: int, d: np.ndarray, d1: np.ndarray, unseen: float) -> tuple[np.ndarray, np.ndarray]:
    """The scale of seen bigrams' shares and alpha(u), from the sums by context: how many bigrams were seen 1..5 times, of how many
    the word was seen 1..5 times in all, and the counts of the other words."""
    r = np.arange(1, DISCOUNTED + 1)[:, None]
    mass = np.where(c > 0, (c - ((1 - d)[:, None] * r * sums[:DISCOUNTED]).sum(axis=0)) / np.maximum(c, 1), 0.0)
    p1 = ((d1[:, None] * r * sums[DISCOUNTED : 2 * DISCOUNTED]).sum(axis=0) + sums[2 * DISCOUNTED]) / max(n, 1) * (1 - unseen_scale(n, d1, unseen))
    rest = 1 - p1
    most = np.where(rest > 1e-9, 1 - 1 / (c + 1), 1.0)
    scale = np.where((mass > most) | (rest <= 1e-9), most / np.maximum(mass, 1e-300), 1.0)
    alpha = np.where(c > 0, np.where(rest > 1e-9, (1 - mass * scale) / np.maximum(rest, 1e-9), 0.0), 1.0)
    return scale, alpha


def _contexts(held, discount: np.ndarray, parts: int):
    """Pass 5, by group: sums of the bigrams it owns, by context; scores but for the contexts' weights, and which of these each token takes."""

    def run(key, left, right):
        docs_row = [x for b in left for x in b.column("payload").to_pylist()]
        if not docs_row:
            return
        answers = _split(right)
        group = _Group(docs_row[0], answers["counts"], held.value)
        g = key[0].as_py()
        u, w, back = group.bigrams()
        _, order, _ = group.dealt(u, w, parts)
        total = np.empty(len(u), np.int64)
        total[order] = np.concatenate([from_ints(unpack(answers["totals"][p])) for p in sorted(answers["totals"])])
        owned = (total % 2 == 1) & (total > 1)
        total //= 2
        size, few = len(group.ids), range(1, DISCOUNTED + 1)
        uo, wo, to = u[owned], group.class_count[w[owned]], total[owned]
        sums = [np.bincount(uo[to == r], minlength=size) for r in few] + [np.bincount(uo[wo == r], minlength=size) for r in few]
        sums.append(np.bincount(uo, weights=np.where(wo > DISCOUNTED, wo, 0), minlength=size).astype(np.int64))
        at = 0
        for p, (own, mine) in group.parts.items():
            x = np.flatnonzero(mine) + at
            at += len(own)
            if len(x):
                yield _batch([(g, p, pack((ints(own[mine]), ints(group.class_count[x]), *[ints(v[x]) for v in sums])), "contexts")])

        seen = total > 0
        logs = np.log10(np.where(seen, factors(total, discount) * total / np.maximum(group.class_count[u], 1), group.p1[w]))
        # unseen words as contexts come last and weigh one
        at_context = np.where(np.append(group.mine, True), np.cumsum(np.append(group.mine, True)) - 1, 0)
        weights = at_context[u] * 2 + seen
        count, n, v = group.count, group.n, group.v
        part = group.sums(logs[back])
        base = group.sums(np.log10((count + 1) / (n + v + 1))[group.stream])
        known = group.sums((count > 0).astype(np.int64)[group.stream])
        rows = [(d[0], d[1], d[2], int(k), float(s), float(x)) for d, k, s, x in zip(group.docs, known, base, part, strict=True)]
        yield _batch([(g, -1, pack((rows, ints(weights[back]))), "docs")])

    return run


def _sum_contexts(key, batches):
    """Pass 6, by p: the contexts' sums over all groups, sent back in each group's order with the contexts' counts."""
    sent = []
    for b in batches:
        for g, payload in zip(b.column("g").to_pylist(), b.column("payload").to_pylist(), strict=True):
            sent.append((g, [from_ints(x) for x in unpack(payload)]))
    total = np.zeros((SUMS + 1, 1 + max(int(x[0].max()) for _, x in sent)), np.int64)
    for _, (own, count, *more) in sent:
        total[SUMS, own] = count
        for k, x in enumerate(more):
            total[k, own] += x
    for g, x in sent:
        yield _batch([(g, key[0].as_py(), pack([ints(total[k, x[0]]) for k in range(SUMS + 1)]), "sums")])


def _score(train_tokens: int, d: np.ndarray, d1: np.ndarray, unseen: float):
    """Pass 7, by group: weights from the sums, and with them the scores."""

    def run(key, left, right):
        docs_row = [x for b in left for x in b.column("payload").to_pylist()]
        if not docs_row:
            return
        rows, at = unpack(docs_row[0])
        answers = _split(right).get("sums", {})
        found = [[from_ints(x) for x in unpack(answers[p])] for p in sorted(answers)]
        total = np.stack([np.concatenate([*[x[k] for x in found], [0]]) for k in range(SUMS + 1)])
        scale, alpha = backoff(total[:SUMS], total[SUMS], train_tokens, d, d1, unseen)
        logs = np.log10(np.stack([alpha, scale], axis=1)).ravel()[from_ints(at)]
        starts = np.concatenate(([0], np.cumsum([r[2] for r in rows])[:-1])).astype(np.int64)
        score = np.add.reduceat(logs, starts) + np.array([r[5] for r in rows])
        col = lambda k, kind: pa.array([r[k] for r in rows], kind)
        yield pa.RecordBatch.from_arrays(
            [col(0, pa.int64()), col(1, pa.bool_()), col(2, pa.int64()), col(3, pa.int64()), pa.array([train_tokens] * len(rows), pa.int64()), col(4, pa.float64()), pa.array(score)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def _store(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per row of docs, with the columns of SCORES."""
    spark = docs.sparkSession
    parts = _parts(docs)
    ident = F.col(doc_id).cast("long")
    held_out = F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    few = small_batches(docs).select(ident.alias("doc_id"), F.col(text).cast("string").alias("text"), held_out.alias("held_out"))
    of = lambda t, kind: t.where(F.col("kind") == kind)

    one = _store(few.mapInArrow(_groups(parts, group_tokens), FIELDS), "lm-groups")
    two = _store(of(one, "words").groupBy("p").applyInArrow(by_group(_sum_words, FIELDS), FIELDS), "lm-words")
    found = [unpack(r.payload) for r in _tree(of(two, "unigrams"), parts, _merge_unigrams).collect()]  # one row
    n, v, few_words, sizes, end = found[0] if found else (0, 0, [0] * (DISCOUNTED + 1), {}, (0, 0))
    offsets = OTHER + 1 + np.concatenate(([0], np.cumsum([sizes.get(p, 0) for p in range(parts)])))
    d1 = discounts(np.array(few_words, float))
    unseen = unseen_share(n, few_words, d1)
    held = spark.sparkContext.broadcast((offsets, int(offsets[end[0]]) + end[1], n, v, d1, unseen))

    docs_of = of(one, "docs").groupBy("g")
    three = docs_of.cogroup(of(two, "counts").groupBy("g")).applyInArrow(by_group(_bigrams(held, parts), FIELDS), FIELDS)
    four = _store(three.groupBy("p").applyInArrow(by_group(_sum_bigrams, FIELDS), FIELDS), "lm-counts")
    seen = [unpack(r.payload) for r in _tree(of(four, "seen"), parts, _merge_seen).collect()]  # one row
    d = discounts(np.array(seen[0] if seen else [0] * (DISCOUNTED + 1), float))
    both = of(two, "counts").unionByName(of(four, "totals"))
    five = _store(docs_of.cogroup(both.groupBy("g")).applyInArrow(by_group(_contexts(held, d, parts), FIELDS), FIELDS), "lm-contexts")
    six = of(five, "contexts").groupBy("p").applyInArrow(by_group(_sum_contexts, FIELDS), FIELDS)
    return of(five, "docs").groupBy("g").cogroup(six.groupBy("g")).applyInArrow(by_group(_score(int(n), d, d1, unseen), SCORES), SCORES)


def _parts(docs: DataFrame) -> int:
    """As many as the session's shuffles have, and at least one for each PART_BYTES of the input files."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # Spark's guess for what it doesn't know is huge
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-known // PART_BYTES), 1_000_000))


def _tree(rows: DataFrame, parts: int, merge) -> DataFrame:
    """One row for each g: rows are merged FAN at a time, so that no task has many parts' rows."""
    while parts > 1:
        parts = -(-parts // FAN)
        rows = rows.withColumn("p", F.floor(F.col("p") / FAN).cast("int")).groupBy("g", "p").applyInArrow(by_group(merge, FIELDS), FIELDS)
    return rows


def _merge_unigrams(key, batches):
    n, v, few, sizes, end = 0, 0, [0] * (DISCOUNTED + 1), {}, None
    for b in batches:
        for payload in b.column("payload").to_pylist():
            a, t, f, size, at = unpack(payload)
            n, v, few, end = n + a, v + t, [x + y for x, y in zip(few, f, strict=True)], at or end
            sizes |= size
    yield _batch([(key[0].as_py(), key[1].as_py(), pack((n, v, few, sizes, end)), "unigrams")])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
