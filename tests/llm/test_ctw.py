"""Language-model scoring: the word model by brute force, the byte model by the recursion that defines it."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from math import lgamma, log

import numpy as np
import pytest

from loomline.llm import ctw
from tests.llm.test_text_operators import awkward_rows, by_row, prose, run, write_tables


def learns(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 7 != 2


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def log_kt(a, b):
    return lgamma(a + 0.5) + lgamma(b + 0.5) - log(math.pi) - lgamma(a + b + 1)


def log_add(a, b):
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Recursive:
    """Context-tree weighting of every binary decision, straight from its definition."""

    def __init__(self, texts, depth):
        self.depth, self.seen = depth, {}
        for t in texts:
            data = b"\0" * depth + t + b"\0"
            for p in range(depth, len(data)):
                node = 1
                for bit in range(7, -1, -1):
                    b = data[p] >> bit & 1
                    for d in range(depth + 1):
                        self.seen.setdefault((node, data[p - d : p]), [0, 0])[b] += 1
                    node = 2 * node + b
        self.children = {}
        for node, context in self.seen:
            if context:
                self.children.setdefault((node, context[1:]), set()).add(context)
        self.cache = {}

    def weighted(self, node, context):
        if (node, context) not in self.cache:
            own = log_kt(*self.seen.get((node, context), (0, 0)))
            if len(context) < self.depth:
                below = sum(self.weighted(node, c) for c in self.children.get((node, context), ()))
                own = log_add(own, below) - log(2)
            self.cache[node, context] = own
        return self.cache[node, context]

    def one(self, node, context, d=0):
        """Probability of a one at a decision, mixed along the path of a context."""
        own = context[len(context) - d :]
        zeros, ones = self.seen.get((node, own), (0, 0))
        estimate = (ones + 0.5) / (zeros + ones + 1)
        if d == self.depth:
            return estimate
        share = math.exp(log_kt(zeros, ones) - log(2) - self.weighted(node, own))
        return share * estimate + (1 - share) * self.one(node, context, d + 1)

    def score(self, text):
        data, total = b"\0" * self.depth + text + b"\0", 0.0
        for p in range(self.depth, len(data)):
            node = 1
            for bit in range(7, -1, -1):
                b, one = data[p] >> bit & 1, self.one(node, data[p - self.depth : p])
                total += math.log10(one if b else 1 - one)
                node = 2 * node + b
        return total


def brute_base(rows):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    seen = Counter(w for d, t in rows if learns(d) for w in words(t))
    n, v = sum(seen.values()), len(seen)
    for d, t in rows:
        own = words(t)
        yield d, not learns(d), len(own), sum(seen[w] > 0 for w in own), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own), 5)


@pytest.mark.parametrize("chunk", [ctw.CHUNK, 2000])
def test_word_model(spark, tmp_path, chunk):
    rows = awkward_rows()
    where = write_tables(tmp_path, rows, [], [], [])
    got = [r.asDict() for r in ctw.score(spark.read.parquet(f"{where}/documents.parquet"), chunk).collect()]
    for r in got:
        r["base_score"] = round(r["base_score"], 5)
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    assert by_row(got, *names) == sorted(brute_base([r[:2] for r in rows]), key=repr)


def small_rows():
    texts = ["abracadabra abra", "the cat sat on the mat", "The dog sat on the log", "", None, "émile über", "a\x00b\x00c", prose(3, 40), prose(4, 25), "zzzzzzzz", "the"]
    return [(i, t, *[None] * 7) for i, t in enumerate(texts)]


@pytest.mark.parametrize("chunk", [ctw.CHUNK, 100])
def test_byte_model_follows_the_recursion(spark, tmp_path, chunk):
    rows = small_rows()
    where = write_tables(tmp_path, rows, [], [], [])
    got = {r["doc_id"]: r for r in ctw.score(spark.read.parquet(f"{where}/documents.parquet"), chunk).collect()}
    model = Recursive([lower(t).encode() for d, t, *_ in rows if learns(d)], ctw.DEPTH)
    for d, t, *_ in rows:
        want = model.score(lower(t).encode())
        assert got[d]["score"] == pytest.approx(want, abs=2e-4, rel=1e-5), t
        if t:
            assert got[d]["bits_per_byte"] == pytest.approx(-want / math.log10(2) / len(t.encode()), rel=1e-4)


def test_without_training_rows_bytes_are_uniform(spark, tmp_path):
    doc = next(d for d in range(100) if not learns(d))
    (row,) = run(spark, write_tables(tmp_path, [(doc, "abc", *[None] * 7)], [], [], []), "op10_lm_score")
    assert row["score"] == pytest.approx(-4 * 8 * math.log10(2), rel=1e-6)
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 2, 0, 0, 0.0)


def test_held_out_text_codes_better_than_shuffled_bytes(spark, tmp_path):
    out = [d for d in range(3000) if not learns(d)]
    plain = prose(77, 400)
    mixed = bytes(np.random.default_rng(1).permutation(np.frombuffer(plain.encode("ascii", "ignore"), np.uint8))).decode()
    rows = [(d, prose(d, 300), *[None] * 7) for d in range(60) if learns(d)] + [(out[0], plain, *[None] * 7), (out[1], mixed, *[None] * 7)]
    bits = {r["doc_id"]: r["bits_per_byte"] for r in run(spark, write_tables(tmp_path, rows, [], [], []), "op10_lm_score")}
    assert bits[out[0]] < 2.5 < bits[out[1]]


def test_rounds_of_merging_and_split_shards_give_the_same(spark, tmp_path, monkeypatch):
    """Many chunks, merged two at a time and served in parts of three, score as one chunk does."""
    rows = [(d, prose(d, 40) + f" own{d}", *[None] * 7) for d in range(40)]
    docs = spark.read.parquet(write_tables(tmp_path, rows, [], [], []) + "/documents.parquet")
    whole = {r["doc_id"]: r.asDict() for r in ctw.score(docs).collect()}
    monkeypatch.setattr(ctw, "FAN", 2)
    monkeypatch.setattr(ctw, "SERVED", 3)
    for r in ctw.score(docs, 700).collect():
        want = whole[r["doc_id"]]
        assert r.asDict() == {**want, **{k: pytest.approx(want[k], rel=1e-9) for k in ("score", "base_score", "bits_per_byte")}}


def test_every_context_gives_probabilities():
    texts = [prose(d, 60).lower().encode() for d in range(5)]
    keys, n = np.unique(ctw.strings(texts, ctw.DEPTH)[0], return_counts=True)
    every = np.unique((keys[::37] >> 8 << 8)[:, None] | np.arange(256))  # all bytes after some contexts; most never occurred
    both, place = np.unique(np.concatenate([keys, every]), return_inverse=True)
    own = ctw.Subtrees(both, np.bincount(place, np.concatenate([n, np.zeros(len(every), int)])).astype(np.int64), ctw.DEPTH)
    top = ctw.upper_levels(ctw.pa.table(dict(zip(("id", "z", "o", "below"), own.tops))))
    p = 10.0 ** own.logs(top)[np.searchsorted(both, every)]
    assert np.allclose(p.reshape(-1, 256).sum(axis=1), 1)


def test_packed_numbers_and_words():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 48, 1000))
    assert (ctw.unpacked_keys(ctw.packed_keys(keys)) == keys).all() and len(ctw.unpacked_keys(ctw.packed_keys(keys[:0]))) == 0
    assert ctw.unpacked_words(ctw.packed_words([b"a", b"b\x00"])) == [b"a", b"b\x00"]
    a, n = ctw.summed(np.array([3, 1, 3, 0]), np.array([1, 2, 3, 4]))
    assert a.tolist() == [0, 1, 3] and n.tolist() == [4, 2, 4]


def test_certain_bytes_keep_finite_scores(spark, tmp_path):
    learned = [d for d in range(200) if learns(d)][:20]
    out = next(d for d in range(200) if not learns(d))
    rows = [(d, "a" * 200_000, *[None] * 7) for d in learned] + [(out, "ab" * 50, *[None] * 7)]
    got = {r["doc_id"]: r["score"] for r in run(spark, write_tables(tmp_path, rows, [], [], []), "op10_lm_score")}
    assert math.isfinite(got[out]) and got[out] < -100 and got[learned[0]] > -50


def test_rare_contexts_keep_their_nodes(spark, tmp_path):
    """More than 16384 training positions: contexts that occur once or twice still follow the recursion."""
    rows = [(d, prose(d, 60) + f" rare{d} word", *[None] * 7) for d in range(90)]
    docs = spark.read.parquet(write_tables(tmp_path, rows, [], [], []) + "/documents.parquet")
    learned = [lower(t).encode() for d, t, *_ in rows if learns(d)]
    assert sum(map(len, learned)) > 1 << 14
    model, got = Recursive(learned, ctw.DEPTH), {r["doc_id"]: r["score"] for r in ctw.score(docs).collect()}
    for d, t, *_ in rows[:12]:
        assert got[d] == pytest.approx(model.score(lower(t).encode()), rel=1e-5)
