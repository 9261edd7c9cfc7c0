"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words between single spaces (A-Z only; a word is a run of digits, letters a-z and
characters beyond ASCII). Items give windows of ``window`` words; an item with fewer words, but not none, is one window.
The automaton holds every window once, with the items that have it, framed by spaces so that only whole words match. A
document is scanned once; a match's offsets lead to word numbers and from there to code points of the original text.

Items are broadcast as their windows. If these exceed ``limit`` characters in all, they are dealt by hash into shares of about that
size; the driver holds one share at a time, and what one share's automaton finds is written before the next share is scanned, so that no
task holds more than one.

Nulls and empty texts have no words and no hits; items without words match nothing. Repeated documents are each reported;
repeated items with one item_id count once, and those without item_id together as one item that has no name. Empty tables on either side give no hits. Extra columns of documents pass
through ``clean``, whatever their names, and are not read by ``scan``. Very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from loomline.llm.common import bounded_batches, col, discard, free, out_batch, plain_names, slices, stored, with_field

WINDOW, MIN_ITEMS, LIMIT = 8, 2, 8_000_000
#: Byte by byte: what is no word becomes a blank, A-Z become a-z, bytes beyond ASCII stay.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x20]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _by_id(items) -> list[int | None]:
    return sorted(items, key=lambda i: (i is None, i or 0))


def windows(items: list[tuple[int, bytes]], size: int = WINDOW) -> dict[bytes, list[int]]:
    """The windows of the items, and for each the items that have it."""
    found: dict[bytes, set[int]] = defaultdict(set)
    for item, text in items:
        own = words(text)
        for at in range(max(1, len(own) - size + 1)):
            if own:
                found[b" " + b" ".join(own[at : at + size]) + b" "].add(item)
    return {w: _by_id(i) for w, i in found.items()}


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(patterns: dict[bytes, list[int]], key: str) -> ahocorasick.Automaton:
    if key not in _built:
        _built.clear()
        own = ahocorasick.Automaton()
        for w, items in patterns.items():
            own.add_word(w.decode("latin-1"), (w.count(b" ") - 1, items))
        own.make_automaton()
        _built[key] = own
    return _built[key]


def scan_text(text: bytes, automaton) -> tuple[int, list[tuple[int, int]], dict[int, list[tuple[int, int]]]]:
    """Number of words, hit word ranges [first, end) without overlap, and the ranges of each item."""
    own = words(text)
    norm = b" " + b" ".join(own) + b" "
    matches = list(automaton.iter(norm.decode("latin-1"))) if own and len(automaton) else []
    if not matches:
        return len(own), [], {}
    ends = np.cumsum([len(w) + 1 for w in own])  # where the blank after each word is
    spans, items = [], defaultdict(list)
    for end, (n, owners) in matches:
        last = int(np.searchsorted(ends, end))
        spans.append((last - n + 1, last + 1))
        for i in owners:
            items[i].append(spans[-1])
    return len(own), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points [start, end) in the original text of word ranges [first, end)."""
    places = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    chars = lambda at: len(text[:at].decode())
    return [(chars(places[a][0]), chars(places[b - 1][1])) for a, b in ranges]


def _window_rows(size: int):
    schema = pa.schema([("window", pa.binary()), ("item", pa.int64())])

    def cut(batches):
        for batch in batches:
            for part, data in slices(batch, "text"):
                for item, text in zip(part.column("item_id").to_pylist(), data):
                    own = list(windows([(item, text)], size))
                    yield out_batch(schema, (own, [item] * len(own)))

    return cut


def item_shares(benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """The windows of benchmark (item_id, text) as rows (window, item), and into how many shares of about ``limit`` characters they go."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    rows = stored(items.mapInArrow(_window_rows(window), "window binary, item bigint").distinct(), "windows")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()[0]
    return rows, max(1, -(-size // limit))


def load_share(rows: DataFrame, k: int, shares: int) -> dict[bytes, list[int | None]]:
    found = defaultdict(set)
    for batch in rows.filter(F.pmod(F.xxhash64("window"), F.lit(shares)) == k).toArrow().to_batches():
        for w, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[w].add(item)
    return {w: _by_id(i) for w, i in found.items()}


_REPORT = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))])
_HITS = StructType([StructField("n_words", LongType()), StructField("hits", ArrayType(ArrayType(LongType()))), StructField("items", ArrayType(LongType()))])


def _scanner(shared, key: str, text_col: str, name: str, first: bool):
    def scan(batches):
        own = _automaton(shared.value, key)
        for batch in batches:
            for part, data in slices(batch, text_col):
                reports = []
                old = [None] * part.num_rows if first else part.column(part.num_columns - 1).to_pylist()
                for text, was in zip(data, old):
                    n, ranges, items = scan_text(text, own)
                    if was:
                        ranges, items = merged([*map(tuple, was["hits"]), *ranges]), {*was["items"], *items}
                    reports.append({"n_words": n, "hits": [list(r) for r in ranges], "items": _by_id(items)})
                kept = part.columns if first else part.columns[:-1]
                names = part.schema.names[: len(kept)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(reports, _REPORT)], names=[*names, name])

    return scan


def scanned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, limit: int = LIMIT) -> tuple[DataFrame, str]:
    """docs with a last column of n_words, hits (word ranges) and items, and the name of that column."""
    bounded_batches(docs.sparkSession)
    name = free(docs, "report")
    schema = with_field(docs, name, _HITS)
    rows, shares = item_shares(benchmark, window, limit)
    for k in range(shares):
        share = load_share(rows, k, shares)
        key = hashlib.sha256(repr(sorted(share.items())).encode()).hexdigest()
        before, docs = docs, docs.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast(share), key, text_col, name, k == 0), schema)
        if k + 1 < shares:
            docs = stored(docs, "scanned")
            if k:
                discard(before)
    discard(rows)
    return docs, name


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids, ascending), hits (word ranges) and contaminated for each row of docs."""
    found, _ = scanned(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, "text", window, limit)
    n_hit = F.aggregate("report.hits", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.select(
        "doc_id",
        F.col("report.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("report.items").cast("long").alias("n_items"),
        F.col("report.items").alias("items"),
        F.col("report.hits").alias("hits"),
    ).withColumn("contaminated", F.col("n_items") >= min_items)


def _remover(text_at: int):
    def remove(batches):
        for batch in batches:
            out, report = [], batch.column(batch.num_columns - 1)
            for was, hits in zip(batch.column(text_at), pc.struct_field(report, "hits").to_pylist()):
                text = was.as_py()
                if hits:
                    kept, last = [], 0
                    for a, b in original_spans(text.encode(), [tuple(x) for x in hits]):
                        kept.append(text[last:a])
                        last = b
                    text = "".join([*kept, text[last:]])
                out.append(text)
            columns = [pa.array(out, pa.string()) if i == text_at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return remove


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, min_items: int = MIN_ITEMS, limit: int = LIMIT) -> DataFrame:
    """docs without contaminated rows, and without the benchmark passages in the rows that stay."""
    own, at = plain_names(docs), docs.columns.index(text_col)
    found, name = scanned(own, benchmark, own.columns[at], window, limit)
    return found.filter(F.size(col(name)["items"]) < min_items).mapInArrow(_remover(at), own.schema).toDF(*docs.columns)
