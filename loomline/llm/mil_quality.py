"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Every passage is encoded as shares of letter classes, word lengths, stop
words, repeats and the like and as shares of its words by hash (``BUCKETS`` of them), then by a learned layer. Gated attention, learned
from document labels only, weighs the passages, and the weighted representation gives the score. Training uses the labelled documents that exist and are not held out,
at most ``sample`` of them (those with the smallest hash of their id), with at most ``bag`` passages each, evenly spread over the
text: documented bounds that hold for training alone; every passage of every text is scored.

Scores read texts only. Nulls and texts without words are one passage of zeros. Labels that are null are left out, and several of
one document are averaged. Repeated rows are scored each; of rows that repeat a labelled doc_id one
is learned from. Without labels every score is 0.5. An empty table gives an empty
table. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches, by_hash, discard, out_batch, remainder, slices, stored
from loomline.llm.quality_rules import STOP_WORDS

PASSAGE, SAMPLE, BAG, SEED = 64, 6000, 64, 7
MODULUS, HELD_OUT = 3, 1
BUCKETS = 128
BLANK, LOWER, UPPER, DIGIT, SYMBOL, CRY, POINT, BEYOND = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, POINT, np.uint8)
    table[128:] = BEYOND
    for letters, kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), ("#*$%&|<>", SYMBOL), ("!?", CRY), (" \t\n\x0b\f\r", BLANK)):
        table[[ord(c) for c in letters]] = kind
    return table


_CLASS = _classes()
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_LOW[[b for b in range(256) if _CLASS[b] in (BLANK, SYMBOL, CRY, POINT)]] = 0
_COEFFICIENT = np.random.default_rng(SEED).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = 26 + BUCKETS


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int((_LOW[raw] * _COEFFICIENT[np.arange(len(raw)) % 64]).sum(dtype=np.uint64))


_STOPS = np.sort(np.array([_hash(w) for w in set(STOP_WORDS)], np.uint64))


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many passages each text has (one at least), in order."""
    if not texts:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    text_at = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    kind = _CLASS[raw]
    inside = kind != BLANK
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.zeros(len(texts), np.int64)
    if not len(starts):
        return np.zeros((len(texts), FEATURES), np.float32), sizes + 1
    doc = np.searchsorted(text_at, starts, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    per_doc = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(per_doc) - per_doc
    passage = base[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
    total, size = int(per_doc.sum()), ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    of, kinds, letters = passage[word], kind[inside], _LOW[raw[inside]]
    begin = np.cumsum(size) - size
    place = np.arange(len(word)) - begin[word]
    hashes = np.add.reduceat(letters * _COEFFICIENT[place % 64], begin)
    count = lambda mask: np.bincount(passage, weights=mask.astype(float), minlength=total)
    n = np.bincount(passage, minlength=total)
    shape = np.bincount(of * 8 + kinds, minlength=total * 8).reshape(total, 8)[:, 1:] / np.maximum(1, np.bincount(of, minlength=total))[:, None]
    head, tail = kind[starts], raw[ends - 1]
    uppers = np.add.reduceat((kinds == UPPER).astype(np.int64), begin)
    lowers = np.add.reduceat((kinds == LOWER).astype(np.int64), begin)
    marks = np.add.reduceat(((kinds == SYMBOL) | (kinds == CRY)).astype(np.int64), begin)
    back = lambda k: np.concatenate([np.zeros(min(k, len(doc)), bool), (hashes[k:] == hashes[:-k]) & (doc[k:] == doc[:-k])])
    filled = np.bincount(passage * BUCKETS + (hashes >> np.uint64(57)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    stop = _STOPS[np.minimum(np.searchsorted(_STOPS, hashes), len(_STOPS) - 1)] == hashes
    share = np.maximum(1, n)
    mean = np.bincount(passage, weights=size, minlength=total) / share
    spread = np.sqrt(np.maximum(0, np.bincount(passage, weights=size.astype(float) ** 2, minlength=total) / share - mean**2))
    columns = [
        np.log1p(n), mean, spread, np.log1p(per_doc[np.repeat(np.arange(len(texts)), per_doc)]),
        *(count(m) / share for m in (stop, head == UPPER, (uppers >= 2) & (lowers == 0), marks > 0, marks >= 3, back(1), back(2), size == 1, size > 12, tail == 46, tail == 44, raw[ends] == 10, hashes == 0)),
        (filled > 0).sum(axis=1) / share, filled.max(axis=1) / share,
    ]
    return np.concatenate([np.stack(columns, axis=1), shape, filled / share[:, None]], axis=1).astype(np.float32), per_doc


class AttentionModel:
    """tanh layer, gated attention, logistic output; trained with Adam on bags of passages."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = SEED):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": draw(FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.mean, self.scale, self.trained = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), False

    def _forward(self, x, sizes):
        p, at = self.p, np.cumsum(sizes) - sizes
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(sizes)), sizes)
        a = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return h, t, s, a, z, bag, at, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not self.trained or not len(sizes):
            return np.full(len(sizes), 0.5)
        return self._forward(np.clip((x - self.mean) / self.scale, -8, 8), sizes)[-1].astype(float)

    def attention(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The weight of each passage within its text."""
        return self._forward(np.clip((x - self.mean) / self.scale, -8, 8), sizes)[3]

    def _gradient(self, x, sizes, y):
        p = self.p
        h, t, s, a, z, bag, at, q = self._forward(x, sizes)
        g = ((q - y) / len(y)).astype(np.float32)
        dz = g[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, at)[bag])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - h * h)
        return {"W": x.T @ du, "b": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": g.sum(keepdims=True)}

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4):
        if not len(y):
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x, at, order = np.clip((x - self.mean) / self.scale, -8, 8), np.cumsum(sizes) - sizes, np.random.default_rng(SEED)
        m, v, step = {k: 0 for k in self.NAMES}, {k: 0 for k in self.NAMES}, 0
        for epoch in range(epochs):
            ranks = order.permutation(len(y))
            for lo in range(0, len(y), batch):
                own = ranks[lo : lo + batch]
                rows = np.concatenate([np.arange(at[i], at[i] + sizes[i]) for i in own])
                step += 1
                for k, g in self._gradient(x[rows], sizes[own], y[own]).items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    slower = rate * (1 - epoch / epochs)
                    self.p[k] = (self.p[k] - slower * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.trained = True
        return self


def _encoder(bag: int):
    schema = pa.schema([("y", pa.float64()), ("n", pa.int64()), ("x", pa.binary())])

    def encode(batches):
        for batch in batches:
            for part, data in slices(batch, "text"):
                x, sizes = passages(data)
                ends = np.cumsum(sizes)
                kept = [np.unique(np.linspace(e - n, e - 1, min(n, bag)).astype(int)) for e, n in zip(ends, sizes)]
                yield out_batch(schema, (part.column("y"), [len(k) for k in kept], [x[k].tobytes() for k in kept]))

    return encode


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bag: int = BAG) -> AttentionModel:
    """A model from at most ``sample`` labelled documents that are not held out, with at most ``bag`` passages each."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    known = labels.filter(F.col("quality").isNotNull() & (remainder(F.col("doc_id"), MODULUS) != HELD_OUT))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    there = stored(known.join(texts.select("doc_id"), "doc_id", "left_semi"), "rated")
    rated = by_hash(there, "doc_id", sample).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    once = texts.join(F.broadcast(rated), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    rows = once.select("y", "text").mapInArrow(_encoder(bag), "y double, n bigint, x binary").toArrow()
    discard(there)
    sizes = rows.column("n").to_numpy()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    return AttentionModel().fit(x, sizes, rows.column("y").to_numpy())


def _scorer(model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64())])

    def score(batches):
        own = model.value
        for batch in batches:
            for part, data in slices(batch, "text", 1 << 20):
                x, sizes = passages(data)
                yield out_batch(schema, (part.column("doc_id"), own.score(x, sizes), sizes))

    return score


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of each row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(model), "doc_id bigint, score double, n_passages bigint")
    held = (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
