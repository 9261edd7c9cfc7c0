"""Language-model scoring by context-tree weighting, beside an add-one word model.

**Word model.** Texts are lower-cased (A-Z) and cut into words; every text ends with an end token. Words are told apart by
their bytes.

**Byte model.** Each byte is eight binary decisions in the tree of its bits. Every decision has context trees of depth 0 to
``DEPTH`` over the bytes before; in each context its zeros and ones give a Krichevsky-Trofimov estimate, and context-tree
weighting mixes the estimates of all depths with the posterior weights that the training counts give. Bytes of value zero stand
before a text and one ends it, so scores are probabilities of whole texts. Every context that occurs in training has a
node, however rare, at every size of the corpus.

**Tables.** Input tasks deal documents into chunks of about ``CHUNK`` bytes. A chunk keeps its texts as one compressed blob, and
yields its distinct words, and its distinct strings (a byte and the DEPTH bytes before it), each with its training count, packed by
shard: a row a chunk and shard. So what is shuffled grows with distinct words and strings by chunk. Words are sharded by hash,
strings by the two bytes nearest to the position, so that a shard holds whole subtrees from depth 2 on. Rows of a shard are
merged at most ``FAN`` at a time until one is left. Sums for depths 0 and 1 (at most 256 * 255 numbers each) meet in
the driver and are broadcast. Then each shard meets its chunks' rows, in as many tasks as these need, and answers each with the
totals of its words or the probabilities of its strings; the answers meet their chunk, where texts are scored.

Nulls are empty texts: one end token. Rows that repeat a doc_id are scored each. Without training documents the
totals are zero and bytes are uniform. An empty table gives an empty table. Long texts are scored whole. Extra columns
are not read.
"""

from __future__ import annotations

import zlib
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches, discard, out_batch, slices, stored

CHUNK, DEPTH, SLICE, SHARDS, FAN, SERVED = 16 << 20, 5, 1 << 20, 1024, 64, 256
MODULUS, HELD_OUT = 7, 2
WORDS, STRINGS, TEXTS = 0, 1, 2
_PARTS = pa.schema([("kind", pa.int8()), ("chunk", pa.int64()), ("shard", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("held", pa.binary())])
_PARTS_SQL = "kind tinyint, chunk bigint, shard int, n bigint, keys binary, held binary"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % MODULUS == HELD_OUT


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_keys(sorted_keys: np.ndarray) -> bytes:
    return packed(np.diff(sorted_keys, prepend=0))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<i8"))


def packed_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpacked_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text its bytes and the end, each with the depth bytes before as one number, nearest byte first; and where each text begins.

    The byte itself is in the lowest eight bits.
    """
    gap = b"\0" * depth
    raw = np.frombuffer(gap + (b"\0" + gap).join(texts) + b"\0", np.uint8)
    keys = raw[depth:].astype(np.int64)
    for d in range(1, depth + 1):
        keys |= raw[depth - d : len(raw) - d].astype(np.int64) << (8 * (depth - d + 1))
    sizes = np.array([len(x) + 1 for x in texts])
    begins = np.cumsum(sizes) - sizes
    keep = np.ones(len(keys), bool)
    keep[((begins[1:] + depth * np.arange(1, len(texts)))[:, None] - 1 - np.arange(depth)).reshape(-1)] = False
    return keys[keep], begins


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of n of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _near_shard(keys: np.ndarray, depth: int) -> np.ndarray:
    near = (keys >> (8 * (depth - 1))).astype(np.uint64)
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(SHARDS)


def _portions(texts: list[bytes]):
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and size < SLICE:
            size, to = size + len(texts[to]), to + 1
        yield texts[at:to]
        at = to


class _Chunks:
    """What one input task gathers."""

    def __init__(self, size: int, depth: int):
        self.size, self.depth, self.task, self.nth = size, depth, TaskContext.get().partitionId(), 0
        self._clear()

    def _clear(self):
        self.ids, self.texts, self.bytes = [], [], 0

    def add(self, doc_id, text: bytes):
        self.ids.append(doc_id)
        self.texts.append(text)
        self.bytes += len(text) + 64
        if self.bytes >= self.size:
            yield from self.flush()

    def _words(self, train: list[bool]):
        seen: dict[bytes, int] = {}
        for text, learn in zip(self.texts, train):
            for w in text.split():
                seen[w] = seen.get(w, 0) + learn
        digest, by_shard = xxhash.xxh64_intdigest, [[] for _ in range(SHARDS)]
        for w in seen:
            by_shard[digest(w) % SHARDS].append(w)
        for shard, own in enumerate(by_shard):
            if own:
                own.sort()
                yield WORDS, shard, packed_words(own), packed(np.array([seen[w] for w in own], "<i8"))

    def _strings(self, train: list[bool]):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for learn in (True, False):
            for part in _portions([t for t, own in zip(self.texts, train) if own == learn]):
                own, often = np.unique(strings(part, self.depth)[0], return_counts=True)
                keys, n = summed(np.concatenate([keys, own]), np.concatenate([n, often if learn else np.zeros_like(often)]))
        shard = _near_shard(keys, self.depth)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[s] : edges[s + 1]]
            yield STRINGS, s, packed_keys(keys[own]), packed(n[own].astype("<i8"))

    def flush(self):
        if not self.ids:
            return
        chunk, self.nth = (self.task << 32) | self.nth, self.nth + 1
        train = [not held_out(d) for d in self.ids]
        for made in (self._words(train), self._strings(train)):
            rows = []
            for kind, shard, keys, n in made:
                rows.append((kind, chunk, shard, None, keys, n))
                if len(rows) == 256:
                    yield out_batch(_PARTS, zip(*rows))
                    rows = []
            if rows:
                yield out_batch(_PARTS, zip(*rows))
        ids = np.array([-1 << 63 if d is None else d for d in self.ids], "<i8").tobytes()
        sizes = np.array([len(t) for t in self.texts], "<i8").tobytes()
        blob = zstandard.ZstdCompressor(level=1).compress(len(self.ids).to_bytes(8, "little") + ids + sizes + b"".join(self.texts))
        yield out_batch(_PARTS, ([TEXTS], [chunk], [None], [sum(train)], [blob], [None]))
        self._clear()


def chunk_texts(blob: bytes) -> tuple[list[int | None], list[bytes]]:
    """doc_ids and texts of a chunk."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:8], "little")
    ids, sizes = np.frombuffer(data, "<i8", 2 * n, 8).reshape(2, n).tolist()
    texts, at = [], 8 + 16 * n
    for size in sizes:
        texts.append(data[at : at + size])
        at += size
    return [None if d == -1 << 63 else d for d in ids], texts


def _gather(size: int, depth: int = DEPTH):
    def gather(batches):
        own = _Chunks(size, depth)
        for batch in batches:
            for part, data in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), data):
                    yield from own.add(doc_id, text.lower())
        yield from own.flush()

    return gather


# --- totals of a shard


class _Sum:
    """The sum of rows of one shard; what is held stays near the number of distinct keys."""

    def __init__(self, kind: int):
        self.kind, self.words = kind, {}
        self.keys, self.n, self.more, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: bytes, n: bytes) -> None:
        n = unpacked(n, "<i8")
        if self.kind == WORDS:
            for w, c in zip(unpacked_words(keys), n.tolist()):
                self.words[w] = self.words.get(w, 0) + c
            return
        self.more.append((unpacked_keys(keys), n))
        self.size += len(n)
        if self.size > len(self.keys) + SLICE:
            self._settle()

    def _settle(self) -> None:
        parts = [(self.keys, self.n), *self.more]
        self.keys, self.n = summed(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        self.more, self.size = [], 0

    def row(self) -> tuple[bytes, bytes]:
        if self.kind == WORDS:
            own = sorted(self.words)
            return packed_words(own), packed(np.array([self.words[w] for w in own], "<i8"))
        self._settle()
        return packed_keys(self.keys), packed(self.n)


_SHARD = pa.schema([("kind", pa.int8()), ("shard", pa.int32()), ("own", pa.int64()), ("keys", pa.binary()), ("held", pa.binary())])
_SHARD_SQL = "kind tinyint, shard int, own bigint, keys binary, held binary"


def _merge(batches):
    """Rows come sorted by kind, shard and group (own): one row for each."""
    now, total = None, None
    for batch in batches:
        for kind, shard, own, keys, n in zip(*(batch.column(c).to_pylist() for c in _SHARD.names)):
            if (kind, shard, own) != now:
                if now:
                    yield out_batch(_SHARD, zip((*now, *total.row())))
                now, total = (kind, shard, own), _Sum(kind)
            total.add(keys, n)
    if now:
        yield out_batch(_SHARD, zip((*now, *total.row())))


def shard_totals(parts: DataFrame, chunks: int) -> DataFrame:
    """kind, shard, keys, held: the sums of all rows of a shard, merged in rounds of about FAN rows."""
    rows, groups, before = parts.select("kind", "shard", F.col("chunk").alias("own"), "keys", "held"), max(1, chunks), None
    while True:
        groups = -(-groups // FAN)
        cut = rows.withColumn("own", F.pmod(F.xxhash64("own"), F.lit(groups)))
        merged = cut.repartition("kind", "shard", "own").sortWithinPartitions("kind", "shard", "own").mapInArrow(_merge, _SHARD_SQL)
        rows = stored(merged, "lm-totals")
        if before is not None:
            discard(before)
        before = rows
        if groups == 1:
            return rows


# --- the byte model

_TABLE = 1 << 14
_HALF, _WHOLE = (np.array([lgamma(i + s) for i in range(_TABLE)]) for s in (0.5, 1.0))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For arguments beyond the tables (Stirling's series)."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _looked_up(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(n, _TABLE - 1)]
    large = n >= _TABLE
    if large.any():
        out[large] = _log_gamma(n[large] + shift)
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones in some order."""
    return _looked_up(_HALF, zeros, 0.5) + _looked_up(_HALF, ones, 0.5) - np.log(np.pi) - _looked_up(_WHOLE, zeros + ones, 1.0)


def _weighted(zeros, ones, below):
    """The weighted logarithm of decisions, and the share of their own estimate; below is None for leaves."""
    kt = _log_kt(zeros, ones)
    if below is None:
        return kt, np.ones(len(kt))
    w = np.logaddexp(kt, below) - np.log(2)
    return w, np.exp(kt - np.log(2) - w)


class Subtrees:
    """The context trees below one shard's contexts of depth 2, from its strings (sorted keys) and their counts.

    A string that never occurred in training has counts of zero: its estimates are halves and add nothing above, as for a context without node.
    At each depth the strings, cut to that depth, are in order of context and byte, so those of one decision are a run.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.levels, self.depth = {}, depth
        cut, below = keys, [None] * 8
        for d in range(depth, 1, -1):
            byte, decisions, sums = cut & 255, [], []
            for k in range(8):
                begin = np.flatnonzero(np.diff(cut >> (8 - k), prepend=-1))
                run = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(cut)))
                ones, all_ = (np.add.reduceat(x, begin) if len(begin) else x for x in (n * ((byte >> (7 - k)) & 1), n))
                own = None if d == depth else np.bincount(run[below[k][0]], below[k][1], len(begin))
                w, share = _weighted(all_ - ones, ones, own)
                decisions.append((run, (ones + 0.5) / (all_ + 1), share))
                sums.append((begin, w, all_ - ones, ones))
            if d == 2:
                self.levels[d] = (cut, decisions, None)
                self.tops = self._tops(cut, sums)
                return
            up, place = np.unique((cut >> 16 << 8) | byte, return_inverse=True)
            self.levels[d] = (cut, decisions, place)
            below = [(place[begin], w) for begin, w, _, _ in sums]
            cut, n = up, np.bincount(place, n, len(up)).astype(np.int64)

    @staticmethod
    def _tops(cut, sums):
        """id (byte before << 8 | node of the decision), zeros, ones and the sum of weighted logarithms for depth 1."""
        ids = np.concatenate([(cut[begin] >> 16 << 8) | (1 << k) | ((cut[begin] & 255) >> (8 - k)) for k, (begin, *_) in enumerate(sums)])
        found, place = np.unique(ids, return_inverse=True)
        join = lambda i: np.bincount(place, np.concatenate([s[i] for s in sums]), len(found))
        return found, join(2), join(3), join(1)

    def logs(self, top) -> np.ndarray:
        """log10 probability of each string's byte, in order of the keys given. top: estimates and shares of depths 0 and 1."""
        (one0, share0), (one1, share1) = top
        cut = self.levels[2][0]
        byte, out = cut & 255, None
        mixed, left = [], []
        for k in range(8):
            node, bit = (1 << k) | (byte >> (8 - k)), ((byte >> (7 - k)) & 1).astype(bool)
            at = (cut >> 16 << 8) | node
            p0, p1 = (np.where(bit, p, 1 - p) for p in (one0[node], one1[at]))
            mixed.append(share0[node] * p0 + (1 - share0[node]) * share1[at] * p1)
            left.append((1 - share0[node]) * (1 - share1[at]))
        for d in range(2, self.depth + 1):
            cut, decisions, place = self.levels[d]
            byte, out = cut & 255, np.zeros(len(cut))
            for k, (run, one, share) in enumerate(decisions):
                if place is not None:
                    mixed[k], left[k] = mixed[k][place], left[k][place]
                p = np.where(((byte >> (7 - k)) & 1).astype(bool), one[run], 1 - one[run])
                mixed[k] = mixed[k] + left[k] * share[run] * p
                left[k] = left[k] * (1 - share[run])
                if d == self.depth:
                    out += np.log10(mixed[k])
        return out


_TOPS = pa.schema([("id", pa.int64()), ("z", pa.float64()), ("o", pa.float64()), ("below", pa.float64()), ("tokens", pa.int64()), ("distinct", pa.int64())])


def _tops_of(depth: int):
    def tops(batches):
        for batch in batches:
            for kind, keys, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "held"))):
                n = unpacked(n, "<i8")
                if kind == WORDS:
                    yield out_batch(_TOPS, ([None], [None], [None], [None], [int(n.sum())], [int((n > 0).sum())]))
                else:
                    own = Subtrees(unpacked_keys(keys), n, depth).tops
                    yield out_batch(_TOPS, (*own, [None] * len(own[0]), [None] * len(own[0])))

    return tops


def upper_levels(rows: pa.Table):
    """(probability of a one, share) by node for depth 0, and by byte before and node for depth 1."""
    at = rows.column("id").to_numpy()
    zeros, ones, below = (np.bincount(at, rows.column(c).to_numpy(), 1 << 16) for c in ("z", "o", "below"))
    zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
    w, share = _weighted(zeros, ones, below)
    z0, o0, below0 = (x.reshape(256, 256).sum(axis=0) for x in (zeros, ones, w))
    return ((o0 + 0.5) / (z0 + o0 + 1), _weighted(z0, o0, below0)[1]), ((ones + 0.5) / (zeros + ones + 1), share)


_ANSWERS = pa.schema([("chunk", pa.int64()), ("kind", pa.int8()), ("keys", pa.binary()), ("held", pa.binary())])


def _answerer(depth: int, top):
    def answer(batches):
        """Rows come sorted by kind, shard, part and chunk: the totals of a shard (without chunk) before the chunks' rows."""
        model, found = None, None
        for batch in batches:
            rows = []
            for kind, chunk, keys, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "chunk", "keys", "held"))):
                if chunk is None:
                    n = unpacked(n, "<i8")
                    if kind == WORDS:
                        model, found = dict(zip(unpacked_words(keys), n.tolist())), None
                    else:
                        model = unpacked_keys(keys)
                        found = Subtrees(model, n, depth).logs(top.value).astype("<f4")
                elif kind == WORDS:
                    rows.append((chunk, kind, keys, packed(np.array([model[w] for w in unpacked_words(keys)], "<i8"))))
                else:
                    rows.append((chunk, kind, keys, packed(found[np.searchsorted(model, unpacked_keys(keys))])))
            if rows:
                yield out_batch(_ANSWERS, zip(*rows))

    return answer


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"
_SCORED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]
)


def _scorer(depth: int, tokens: int, distinct: int, ends: int):
    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = answers.column("kind").to_numpy()
        of = lambda kind: ((answers.column("keys")[i].as_py(), answers.column("held")[i].as_py()) for i in np.flatnonzero(kinds == kind).tolist())
        number, counts = {}, [np.zeros(0, np.int64)]
        for words, n in of(WORDS):
            counts.append(unpacked(n, "<i8"))
            number.update(zip(unpacked_words(words), range(len(number), len(number) + len(counts[-1]))))
        counts = np.concatenate(counts)
        logs, known = np.log10(counts + 1.0), counts > 0
        found = [(unpacked_keys(k), unpacked(p, "<f4")) for k, p in of(STRINGS)]
        keys, p = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, p = keys[order], p[order].astype(float)
        del found, order
        out = []
        for blob in chunk.column("keys").to_pylist():
            ids, texts = chunk_texts(blob)
            rows = []
            for doc, text in zip(ids, texts):
                words = np.fromiter(map(number.__getitem__, text.split()), np.int64)
                base = logs[words].sum() + np.log10(ends + 1.0) - (len(words) + 1) * np.log10(tokens + distinct + 1.0)
                rows.append((doc, held_out(doc), len(words) + 1, int(known[words].sum()) + (ends > 0), tokens, base, 0.0, len(text)))
            columns = list(zip(*rows))
            columns[6] = []
            for part in _portions(texts):
                own, begins = strings(part, depth)
                own, place = np.unique(own, return_inverse=True)
                columns[6] += np.add.reduceat(p[np.searchsorted(keys, own)][place], begins).tolist()
            out.append(out_batch(_SCORED_ARROW, columns))
        return pa.Table.from_batches(out, _SCORED_ARROW)

    return score


def score(docs: DataFrame, chunk: int = CHUNK, depth: int = DEPTH) -> DataFrame:
    """Scores of each row of docs (doc_id, text), learned from the rows that held_out leaves. depth: 2 to 6."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_gather(chunk, depth), _PARTS_SQL), "lm-parts", "uncompressed")
    texts, rows = parts.filter(F.col("kind") == TEXTS), parts.filter(F.col("kind") != TEXTS)
    chunks, ends = texts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    totals = shard_totals(rows, chunks)
    tops = totals.mapInArrow(_tops_of(depth), "id bigint, z double, o double, below double, tokens bigint, distinct bigint")
    tops = tops.groupBy("id").agg(*(F.sum(c).alias(c) for c in _TOPS.names[1:])).toArrow()  # at most 256 * 255 sums, and one row of the words'
    named = tops.column("id").is_valid()
    words = tops.filter(pc.invert(named))
    tokens, distinct = (words.column(c)[0].as_py() if words.num_rows else 0 for c in ("tokens", "distinct"))
    top = spark.sparkContext.broadcast(upper_levels(tops.filter(named)))

    served = -(-max(1, chunks) // SERVED)
    lookups = rows.select("kind", "shard", F.pmod(F.xxhash64("chunk"), F.lit(served)).alias("part"), "chunk", "keys", "held")
    models = totals.select("kind", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(served - 1).cast("long"))).alias("part"), F.lit(None).cast("long").alias("chunk"), "keys", "held")
    order = ("kind", "shard", "part")
    met = models.union(lookups).repartition(*order).sortWithinPartitions(*order, F.col("chunk").asc_nulls_first())
    answers = met.mapInArrow(_answerer(depth, top), "chunk bigint, kind tinyint, keys binary, held binary")

    tasks = max(1, -(-chunks // 2))  # by bytes: two chunks to a task
    scorer = _scorer(depth, (tokens or 0) + ends, (distinct or 0) + (ends > 0), ends)
    left, right = (x.repartition(tasks, "chunk").groupBy("chunk") for x in (texts.select("chunk", "keys"), answers))
    scored = left.cogroup(right).applyInArrow(scorer, _SCORED)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes"))
    return scored.withColumn("bits_per_byte", bits)
