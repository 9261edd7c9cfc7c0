"""Cases that are easy to lose: tied turns, labels of other documents, long secrets, other scripts, clashing names and hashes."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest

from loomline.llm import decontam, mil_quality, pii, quality_rules, queries, simhash, token_counts
from loomline.llm.common import free, scratch, stored
from tests.llm.test_text_operators import ITEMS, QUESTION, brute_rules, by_row, prose, run, write_tables


def test_tied_repeated_and_null_turns_are_messages_each(spark, tmp_path):
    turns = [(2, 0, "user", "q"), (2, 0, "assistant", "r"), (2, 0, "assistant", "r"), (2, None, "user", "x"), (2, None, None, "y"), (2, 3, "assistant", None), (None, 1, "user", "no id"), (5, 1, "assistant", "b"), (5, 1, "assistant", "a")]
    where = write_tables(tmp_path, [], [], [], [(*t, "extra") for t in turns])
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{where}/conversations.parquet'")
    found = con.execute(queries.ORACLE_SQL["op5_chat"])
    names = [c[0] for c in found.description]
    got = run(spark, where, "op5_chat")
    assert by_row(got, *names) == sorted(found.fetchall(), key=repr)
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in got}[2] == (6, 2)


def test_labels_of_other_documents_take_no_place(spark):
    good, bad = [prose(k, 80) for k in range(40)], ["$$# !! %% " * 30 + str(k) for k in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id bigint, text string")
    other = spark.range(1000, 60_000).selectExpr("id as doc_id", "1L as quality", "0L as toxic")
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)], "doc_id bigint, quality bigint, toxic bigint").union(other)
    got = {r["doc_id"]: r["predicted"] for r in mil_quality.score(docs, labels, 50).collect()}
    assert np.mean([got[k] == (k < 40) for k in range(80)]) > 0.95


def test_long_texts_train_too(spark):
    texts = [prose(k, 15_000) if k % 2 else "$$# !! %% " * 9000 + str(k) for k in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(24)], "doc_id bigint, quality bigint, toxic bigint")
    assert all(r["predicted"] == r["doc_id"] % 2 for r in mil_quality.score(docs, labels).collect())


def test_candidates_have_no_longest_length():
    secret = "a1" * 150
    found = pii.candidates(f'token = "{secret}"', *pii.base_spans(f'token = "{secret}"'))
    assert [(a, b, k) for a, b, k, *_ in found] == [(9, 309, "secret")]
    name = "n" * 90
    for at in ("(at)", "[AT]", "(At)"):
        text = f"mail {name} {at} example (dot) org"
        assert [(a, b, k) for a, b, k, *_ in pii.candidates(text, *pii.base_spans(text))] == [(5, len(text), "email")]
    for text in ("a(at" * 50_000, "a(at)" * 50_000, "x" * 300_000 + "(at)", "(at) " * 50_000):
        pii.candidates(text, [], [])


def test_overlapping_candidates_are_settled_by_probability():
    text = "ref 2023 555-123-4567"
    spans = [dict(zip(("start", "end", "kind", "sig", "base"), c)) for c in pii.candidates(text, *pii.base_spans(text))]
    kinds = {s["kind"] for s in spans}
    assert "phone" in kinds
    sure = {s["sig"]: 0.9 if s["kind"] == "phone" else 0.2 for s in spans}
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in pii.resolved(spans, sure)] == [("phone", "555-123-4567")]
    both = [{"start": 0, "end": 9, "kind": "secret", "sig": "a", "base": False}, {"start": 5, "end": 12, "kind": "phone", "sig": "b", "base": False}, {"start": 20, "end": 25, "kind": "ip", "sig": "c", "base": True}]
    assert [s["kind"] for s in pii.resolved(both, {"a": 0.6, "b": 0.8})] == ["phone", "ip"]
    assert [s["kind"] for s in pii.resolved(both, {"a": 0.8, "b": 0.8})] == ["secret", "ip"]


def words_of(letters: str, seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list(letters), int(r.integers(2, 8)))) for _ in range(n))


def test_other_scripts_pass_the_stop_word_rule(spark):
    texts = [words_of("абвгдежзиклмнопрст", 1, 180), words_of("的一是不了人我在有他这中大来上国", 2, 80), words_of("αβγδεζηθικλμνξοπρσ", 3, 90), words_of("bcdfghjklmnpq", 4, 180), prose(5, 120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r["kept"] for r in quality_rules.score(docs).orderBy("doc_id").collect()] == [True, True, True, False, True]


@pytest.mark.parametrize("spare", [0, 40, 62])
def test_repeats_are_exact_when_hashes_clash(spark, monkeypatch, spare):
    monkeypatch.setattr(quality_rules, "SPARE_BITS", spare)
    r = np.random.default_rng(spare)
    texts = ["a b c d", "a a a a a", "x y", *(" ".join(r.choice(list("abcdefgh"), int(r.integers(3, 200)))) for _ in range(25)), *(" ".join(map(str, r.integers(0, 40, 400))) for _ in range(5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["n_repeat_words"] for r in quality_rules.score(docs).orderBy("doc_id").collect()]
    assert got == [brute_rules(t)[4] for t in texts]


def test_columns_of_any_name_pass(spark):
    text = f"{prose(3, 70)} {QUESTION} mail a.b@example.org"
    docs = spark.createDataFrame([(1, text, "a", 2, 3, 4), (1, text, "b", 5, 6, 7)], "doc_id bigint, text string, report string, spans int, nth int, `odd ``.name` int")
    benchmark = spark.createDataFrame([i[:2] for i in ITEMS], "item_id bigint, text string")
    for out in (decontam.clean(docs, benchmark, min_items=9), pii.redact(docs), simhash.keep_first(docs), quality_rules.filter_documents(docs)):
        assert out.columns == docs.columns and out.count() in (1, 2)
        assert {tuple(r)[2:] for r in out.collect()} <= {tuple(r)[2:] for r in docs.collect()}
    assert QUESTION not in decontam.clean(docs, benchmark, min_items=9).first()["text"] and "<EMAIL>" in pii.redact(docs).first()["text"]
    assert free(docs, "nth") == "nth_"


def test_second_count_encodes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(40)], "doc_id bigint, text string")
    cache, compacted = scratch(spark, "cache"), scratch(spark, "cache")
    first = sorted(map(tuple, token_counts.count_tokens(docs, cache).collect()))
    monkeypatch.setattr(token_counts, "_counter", lambda path: pytest.fail("encoded again"))
    assert sorted(map(tuple, token_counts.count_tokens(docs, cache).collect())) == first
    token_counts.compact_cache(spark, cache, compacted, 1)
    assert spark.read.parquet(compacted).count() == 7
    assert sorted(map(tuple, token_counts.count_tokens(docs, compacted).collect())) == first


def test_hot_shards_are_cut_by_what_is_left(spark, monkeypatch):
    """Fingerprints that all agree on 48 bits: their shards are cut again, and no link is lost."""
    r = np.random.default_rng(6)
    values = np.unique(r.integers(0, 1 << 16, 500)).tolist()
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    pairs = {(r["a"], r["b"]) for r in simhash.close_pairs(frame, shard=20).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)

    def parts(links):
        up = {v: v for v in values}

        def root(v):
            while up[v] != v:
                v = up[v]
            return v

        for a, b in links:
            up[root(a)] = root(b)
        return sorted(sorted(v for v in values if root(v) == g) for g in {root(v) for v in values})

    assert parts(pairs) == parts([(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2])
    masks = simhash.agreed_bits(0)
    assert len(masks) == 6 and all(m.bit_count() == 32 for m in masks) and {f.bit_count() for m in masks for f in simhash.agreed_bits(m)} == {48}


def test_stored_tables_are_read_with_their_schema(spark):
    assert stored(spark.range(3).filter("id > 5"), "none").collect() == [] and re.match("^[a-z]", free(spark.range(1), "x"))
