"""The training-data operators against brute force, on a small table of awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomline.llm import decontam, mil_quality, packing, pii, quality_rules, queries, simhash, token_counts, token_files
from loomline.llm.common import scratch, table

HARD = r"\### Assistant: </turn> ok"


@lru_cache(maxsize=1)
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    pool = ["the", "of", "river", "mountain", "walked", "quietly", "under", "and", "a", "bright", "lantern", "to", "harbour", "stone", "in", "was", "évening", "größer", "small", "window"]
    words = [pool[i] + (str(k) if k % 7 == 0 else "") for k, i in enumerate(r.integers(0, len(pool), n))]
    return " ".join(w.capitalize() if k % 11 == 0 else w for k, w in enumerate(words)) + "."


QUESTION = "What is the tallest Mountain in the known world of rivers and seas today"
PASSAGE = "Bright lanterns hang above the quiet harbour while small boats return with fish at dusk"


def awkward_rows():
    long = prose(1, 30_000)
    base = prose(2, 120)
    texts = [
        None, "", " \t\n", "one", "two words", "three small words", base, base, base + " extra", base.replace("river", "RIVER"),
        f"{prose(3, 80)} {QUESTION}. {prose(4, 60)} -- {PASSAGE.upper()}! {prose(5, 10)}",
        f"{prose(6, 90)} {QUESTION.replace(' ', ',  ')} {prose(7, 20)}",
        f"{PASSAGE}", "alpha beta", "alpha beta gamma " * 40, "x\n" * 60 + "tail", "!!! ### $$$ " * 30,
        f"{prose(8, 70)} mail a.b+c@mail.example.com, or ab@@c@d.ef from 10.0.0.255 and 300.1.1.1.1.2; card 4111 1111-1111 1111, 4111111111111112 call +1 (415) 555-2671 or 415-555-2671 {prose(9, 20)}",
        f'{prose(10, 70)} token = "a2684b46e90db9d53cccf6c25cfb07c9a0ef67e6" jane (at) mail (dot) example (dot) org {prose(11, 9)}',
        "<|endoftext|> inside <|endoftext|>", "naïve größer 東京 \U0001f600 \u00a0 nbsp\u2003em", "a\x00b \x1c\x1d c\x85d", long, "word " * 3000, "ab" * 9000, prose(12, 60), prose(12, 60) + " ", "tie", "tie",
    ]
    ids = list(range(100, 100 + len(texts)))
    ids[7] = ids[6]  # a row that repeats a doc_id
    rows = [(i, t, "en", "hot" if i % 3 else "src", len(t or ""), 1, "x", [1], "y") for i, t in zip(ids, texts)]
    rows.append((None, prose(13, 70), None, None, None, None, None, None, None))
    return rows


NAMES = ("doc_id", "text", "lang", "source", "n_chars", "n", "fp", "hits", "rank")


def write_tables(folder, rows, items, labels, turns):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
    put = lambda name, fields, data: pq.write_table(pa.table([pa.array([r[k] for r in data], t) for k, (_, t) in enumerate(fields)], names=[f for f, _ in fields]), f"{folder}/{name}.parquet")
    put("documents", list(zip(NAMES, kinds)), rows)
    put("benchmark", [("item_id", pa.int64()), ("text", pa.string()), ("n", pa.string())], items)
    put("labels", [("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())], labels)
    put("conversations", [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("seq", pa.string())], turns)
    return str(folder)


ITEMS = [(3, QUESTION, "q"), (20, PASSAGE, "q"), (7, "Alpha, BETA", "short"), (8, "...", None), (9, None, None), (3, QUESTION, "again"), (11, PASSAGE[:60], "part")]
TURNS = [(1, 0, "user", HARD, "s"), (1, 1, "assistant", "fine\n### x:\n</turn>\\b", "s"), (2, 0, "system", "", "s"), (2, 1, "assistant", None, "s"), (3, 4, None, "no role", None), (3, 2, "assistant", "A", None), (3, 9, "assistant", "B <\\l # é\U0001f600", None), (4, 0, "assi#st\nant", "odd", None)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rows = awkward_rows()
    labels = [(r[0], k % 2, 0) for k, r in enumerate(rows)] + [(100, None, 0), (10**6, 1, 0)]
    return write_tables(tmp_path_factory.mktemp("awkward"), rows, ITEMS, labels, TURNS)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [], [], [], [])


def run(spark, folder, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


def by_row(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


DOCS = [(r[0], r[1]) for r in awkward_rows()]


# --- decontamination


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_decontamination(text, items):
    words, hit, found = item_words(text), set(), set()
    for item, t, *_ in items:
        own = item_words(t)
        for at in range(max(1, len(own) - 7)):
            window = own[at : at + 8]
            for k in range(len(words) - len(window) + 1 if window else 0):
                if words[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2


@pytest.mark.parametrize("limit", [decontam.LIMIT, 150])
def test_decontamination(spark, folder, limit):
    found = decontam.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"), limit=limit).collect()
    digest = lambda r: hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], digest(r), r["contaminated"]) for r in found), key=repr)
    assert got == sorted(((d, *brute_decontamination(t, ITEMS)) for d, t in DOCS), key=repr)
    assert any(r[-1] for r in got)
    assert limit != decontam.LIMIT or by_row(run(spark, folder, "op1_decontaminate"), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == got


def test_decontamination_cuts_passages(spark, folder):
    kept = {r["doc_id"]: r for r in decontam.clean(table(spark, folder, "documents"), table(spark, folder, "benchmark"), min_items=4).collect()}
    assert len(kept) == len({d for d, _ in DOCS}) and kept[110]["source"] == "hot" and kept[110]["hits"] == [1]
    assert QUESTION not in kept[110]["text"] and "LANTERNS HANG" not in kept[110]["text"] and " -- ! " in kept[110]["text"]
    assert kept[125]["text"] == DOCS[25][1] and kept[100]["text"] is None
    assert item_words(kept[111]["text"]) == item_words(f"{prose(6, 90)} {prose(7, 20)}")


def test_items_without_id(spark, tmp_path):
    where = write_tables(tmp_path, [(1, QUESTION, *[None] * 7)], [(None, QUESTION, None), (5, QUESTION, None)], [], [])
    assert by_row(run(spark, where, "op1_decontaminate"), "n_items", "contaminated") == [(2, True)]


# --- tokens


def test_token_counts_and_cache(spark, folder):
    want = sorted(((d, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 512) for d, t in DOCS), key=repr)
    assert by_row(run(spark, folder, "op2_token_counts"), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    cache, docs = scratch(spark, "cache-test"), table(spark, folder, "documents")
    count = lambda d: by_row([r.asDict() for r in token_counts.count_tokens(d, cache).collect()], "doc_id", "n_tokens")
    first = count(docs.filter("doc_id < 110"))
    stored = spark.read.parquet(cache).count()
    assert first == [(d, n) for d, _, n, _ in want if d is not None and d < 110] and stored == len({t or "" for d, t in DOCS if d and d < 110})
    assert count(docs) == [(d, n) for d, _, n, _ in want]
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in DOCS})
    spark.read.parquet(cache).withColumn("n_tokens", -spark.range(1).selectExpr("1L as x").first()["x"] + token_counts.F.lit(0)).limit(1).write.parquet(f"{cache}-other")
    assert spark.read.parquet(f"{cache}-other").count() == 1  # another folder's rows don't reach this cache
    assert count(docs) == [(d, n) for d, _, n, _ in want]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, folder):
    got = run(spark, folder, "op3_token_files")
    own, start = defaultdict(list), {}
    for d, t in DOCS:
        own[d].append([*ids_of(t), 2])
    at = 0
    for d in sorted(own, key=lambda d: (d is not None, d or 0)):
        start[d], at = at, at + sum(map(len, own[d]))
    assert by_row(got, "doc_id", "n_tokens", "ids_crc32") == sorted(((d, len(i), crc(i)) for d in own for i in own[d]), key=repr)
    for d in own:
        mine = sorted(r["start"] for r in got if r["doc_id"] == d)
        assert mine[0] == start[d] and len(mine) == len(own[d])
    folder_out = scratch(spark, "files-test")
    shards = token_files.write_files(table(spark, folder, "documents"), folder_out)
    one = next(s for s in shards if s.first_doc <= 120 and (x := token_files.ShardFile(s.path).document(120)) is not None)
    assert token_files.ShardFile(one.path).document(120).tolist() == own[120][0] and token_files.ShardFile(one.path).document(99) is None
    assert sum(s.documents for s in shards) == len(DOCS)


def naive_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= s]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


def check_packing(rows, docs, capacity=1024):
    own = defaultdict(list)
    for d, t in docs:
        ids = [*ids_of(t), 2]
        head = len(ids) % capacity or min(len(ids), capacity)
        cuts = [(0, head), *((a, capacity) for a in range(head, len(ids), capacity))]
        own[d] += [(k, a, n, crc(ids[a : a + n])) for k, (a, n) in enumerate(cuts)]
    assert by_row(rows, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(((d, *p) for d in own for p in own[d]), key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    sizes = [p[2] for d in own for p in own[d]]
    assert len(sequences) == naive_best_fit(sizes, capacity)


def test_packing(spark, folder):
    check_packing(run(spark, folder, "op6_pack"), DOCS)


def test_packing_plan_is_best_fit_decreasing():
    r = np.random.default_rng(5)
    for _ in range(60):
        capacity = int(r.integers(1, 60))
        sizes = r.integers(1, capacity + 1, int(r.integers(0, 300))).tolist()
        steps = packing.plan(Counter(sizes), capacity)
        bins = defaultdict(int)
        for s in steps:
            later = [t.first for t in steps if t.length == s.length and t.first > s.first]
            for k in range(min([*later, Counter(sizes)[s.length]]) - s.first):
                bins[s.sequence + k // s.each] += s.length
        assert sum(bins.values()) == sum(sizes) and max(bins.values(), default=0) <= capacity
        assert len(bins) == naive_best_fit(sizes, capacity)
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_capacity_tree():
    tree, kept = packing.CapacityTree(40), Counter()
    r = np.random.default_rng(3)
    for _ in range(400):
        c, n = int(r.integers(0, 41)), int(r.integers(1, 4))
        n = -kept[c] if r.random() < 0.4 else n
        tree.add(c, n)
        kept[c] += n
        x = int(r.integers(0, 41))
        assert tree.tightest(x) == min((k for k, v in kept.items() if v and k >= x), default=None)


# --- personal data


def brute_base(text):
    found = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub(r"\D", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
    ):
        found += [(m.start(), pii.KINDS.index(kind), m.end(), kind) for m in re.finditer(pattern, text or "", re.A) if ok(m[0])]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def test_personal_data(spark, folder):
    for r in run(spark, folder, "op7_pii"):
        options = [brute_base(t) for d, t in DOCS if d == r["doc_id"]]
        sums = [hashlib.sha256(pii.joined(o).encode()).hexdigest() for o in options]
        assert r["base_sha256"] in sums
        base = options[sums.index(r["base_sha256"])]
        assert tuple(r[f"n_{k}"] for k in pii.BASE) == tuple(sum(s[2] == k for s in base) for k in pii.BASE)
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(filter(None, r["spans"].split(",")))


def test_base_spans_match_patterns_on_random_texts():
    r, letters = np.random.default_rng(11), list("a@.-+ 1 2(3)4@.9\u0663é\n")
    for _ in range(3000):
        text = "".join(r.choice(letters, int(r.integers(0, 60))))
        assert pii.base_spans(text)[0] == brute_base(text), text
    for text in ("a" * 200_000 + "@", "a@" * 50_000, "1" * 200_000, "1." * 100_000, "+1" + " (" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_span_model_learns_reliabilities():
    r, counts, truth = np.random.default_rng(2), Counter(), {}
    for _ in range(4000):
        y = r.random() < 0.4
        votes = [1 if (r.random() < q) == y else -1 for q in (0.95, 0.8, 0.85, 0.55)]
        sig = "phone|" + "|".join(map(str, votes)) + "|2|3"
        counts[sig] += 1
        truth.setdefault(sig, []).append(y)
    model = pii.SpanModel(counts)
    right = sum(sum(y == (model.probability[s] >= 0.5) for y in ys) for s, ys in truth.items()) / 4000
    assert right > 0.9
    gain = [yes[2] - no[2] for yes, no in model.reliability]
    assert gain[0] > gain[1] > gain[3]


def test_redaction(spark, folder):
    kept = {r["doc_id"]: r for r in pii.redact(table(spark, folder, "documents")).collect()}
    assert len(kept) == len({d for d, _ in DOCS})
    text = kept[117]["text"]
    assert "<EMAIL>" in text and "<IP>" in text and "<CARD>" in text and "<PHONE>" in text and "4111 1111" not in text and kept[117]["hits"] == [1]
    assert kept[125]["text"] == DOCS[25][1] and kept[100]["text"] is None and kept[101]["text"] == ""


def test_planted_secrets_are_found(spark):
    found = pii.report(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    planted = {(d, m.start(1), m.end(1)) for d, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    spans = {(r["doc_id"], *map(int, s.split(":")[1:])) for r in found for s in r["spans"].split(",") if s.startswith("secret")}
    assert planted and spans == planted


# --- quality


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {p for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for p in range(i, i + 3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def brute_kept(text):
    n, chars, symbols, dup, _, failed = brute_rules(text)
    text = text or ""
    plain = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stops = sum(w in set(quality_rules.STOP_WORDS) for w in plain)
    return not failed and symbols <= 0.3 * n and text.count("!") <= 0.5 * n and 2 * n <= chars <= 20 * n and stops >= 0.01 * len(plain) and dup <= 0.5 * len(lines)


def test_quality_rules(spark, folder):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = sorted(((d, *brute_rules(t), brute_kept(t)) for d, t in DOCS), key=repr)
    assert by_row(run(spark, folder, "op8_quality_rules"), *names) == want
    kept = quality_rules.filter_documents(table(spark, folder, "documents"))
    assert kept.columns == list(NAMES)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((d for d, t in DOCS if brute_kept(t)), key=repr)


def test_rules_stay_in_one_native_projection(spark, folder):
    plan = queries.QUERIES["op8_quality_rules"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join", plan)


def test_quality_classifier(spark, folder):
    rows = run(spark, folder, "op4_quality")
    assert len(rows) == len(DOCS)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[127] == pytest.approx(score[128]) and score[100] == pytest.approx(score[101])  # equal texts, and none


def test_quality_classifier_held_out_accuracy_and_label_use(spark, tmp_path):
    where = "/root/testdata/sf0.01"
    docs, labels = table(spark, where, "documents"), table(spark, where, "labels")
    got = {r["doc_id"]: r for r in mil_quality.score(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(got[d]["predicted"], y) for d, y in truth.items() if got[d]["held_out"]]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95
    wrong = labels.withColumn("quality", mil_quality.F.when(mil_quality.remainder(mil_quality.F.col("doc_id"), 3) == 1, 1 - mil_quality.F.col("quality")).otherwise(mil_quality.F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in mil_quality.score(docs.withColumn("lang", mil_quality.F.lit("z")), wrong).collect()}
    assert all(again[d] == pytest.approx(r["score"], abs=1e-6) for d, r in got.items())


def test_attention_gradient():
    r = np.random.default_rng(0)
    x, sizes, y = r.standard_normal((12, mil_quality.FEATURES)).astype("f8"), np.array([1, 4, 7]), np.array([1.0, 0.0, 1.0])
    model = mil_quality.AttentionModel(5, 3)
    model.p = {k: v.astype("f8") for k, v in model.p.items()}
    loss = lambda: -np.mean(y * np.log(q := model._forward(x, sizes)[-1]) + (1 - y) * np.log(1 - q))
    grads = model._gradient(x, sizes, y)
    for k, g in grads.items():
        at = tuple(int(r.integers(0, n)) for n in model.p[k].shape)
        keep, step = model.p[k][at], 1e-6
        model.p[k][at] = keep + step
        up = loss()
        model.p[k][at] = keep - step
        down = loss()
        model.p[k][at] = keep
        assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6), k
    weights = model.attention(x, sizes)
    assert np.allclose(np.add.reduceat(weights, [0, 1, 5]), 1)


# --- near duplicates


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    values, up = sorted(set(prints)), {}
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_simhash(spark, folder):
    prints = [(d, brute_fingerprint(t)) for d, t in DOCS]
    root = brute_components([p for _, p in prints])
    first = {}
    for d, p in prints:
        if d is not None:
            first[root[p]] = min(first.get(root[p], d), d)
    want = sorted(((d, f"{p:016x}", first.get(root[p])) for d, p in prints), key=repr)
    assert by_row(run(spark, folder, "op9_simhash"), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_first(table(spark, folder, "documents"))
    assert kept.columns == list(NAMES)
    named = {d for d, p in prints if d is not None and first[root[p]] == d}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([*named, None], key=repr)


@pytest.mark.parametrize("shard", [simhash.SHARD, 7])
def test_close_pairs_keep_every_link(spark, shard):
    r = np.random.default_rng(4)
    values = set()
    for _ in range(60):
        seed = int(r.integers(0, 1 << 63)) * 2 + int(r.integers(0, 2))
        for _ in range(int(r.integers(1, 12))):
            values.add(seed)
            for b in r.integers(0, 64, int(r.integers(0, 4))):
                seed ^= 1 << int(b)
    values |= {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.close_pairs(frame, shard=shard).collect()]
    assert all((a ^ b).bit_count() <= 2 and a in values and b in values for a, b in pairs)
    want = brute_components(list(values))
    links = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a bigint, b bigint")
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(links).collect()}
    groups = lambda f: sorted(sorted(v for v in values if f(v) == g) for g in {f(v) for v in values})
    assert groups(lambda v: root.get(v, v)) == groups(lambda v: want[v])


def test_bk_tree_and_bulk_search_agree():
    r = np.random.default_rng(9)
    own = np.unique(r.integers(0, 1 << 12, 300).astype("u8"))
    tree = simhash.BKTree()
    for v in own.tolist():
        tree.add(v)
    found = set()
    simhash.bulk_links(own, own, 2, lambda node, close: found.update((int(node), int(q)) for q in close))
    want = {(a, b) for a in own.tolist() for b in own.tolist() if (a ^ b).bit_count() <= 2}
    assert found == want == {(x, q) for q in own.tolist() for x in tree.within(q, 2)}


# --- all


def test_operators_take_empty_tables(spark, empty):
    for name in queries.QUERIES:
        rows = run(spark, empty, name)
        assert len(rows) == (name == "op5_chat"), name


def test_sql_gives_the_same(spark, folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    # a row that repeats a doc_id is one group in SQL; held against SQL are the others
    for name, key in (("op1_decontaminate", "doc_id"), ("op5_chat", "conv_id"), ("op8_quality_rules", "doc_id")):
        want = con.execute(queries.ORACLE_SQL[name])
        columns = sorted(c[0] for c in want.description)
        theirs = [dict(zip([c[0] for c in want.description], r)) for r in want.fetchall()]
        once = lambda rows: by_row([r for r in rows if r[key] not in (None, 106)], *columns)
        assert once(run(spark, folder, name)) == once(theirs), name


def test_math_is_finite(spark, folder):
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in run(spark, folder, "op10_lm_score"))
