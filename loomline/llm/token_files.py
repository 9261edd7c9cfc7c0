"""Token-id files: each document's ids as one zstandard frame with a shared dictionary.

A folder holds ``dict-<sha256>.zdict`` and shards. A shard is, in this order: ``TIDS0001``; the frames of its documents in
ascending doc_id order, each the little-endian ids (16 bits if the vocabulary allows, else 32); an index of four int64
arrays (doc_id, offset, bytes, tokens); a JSON footer with the dictionary's hash, the id width and the index's place; the
footer's length as 8 bytes; ``TIDS0001``. One document is read with the footer, the index and one ranged read.

The dictionary is trained on a bounded sample (``samples`` documents of at most ``sample_bytes`` bytes, those with the
smallest hash of their id): it decides sizes only, never contents. Without enough samples frames have no dictionary, and a warning says so.

Nulls are empty texts and hold the end id alone. Rows that repeat a doc_id are ordered by the hash of their text. An
empty table gives no shard. Long texts are one frame. A task that runs twice writes two files; only the files that
finished tasks name are in the manifest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import warnings
import zlib
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches, by_hash, open_fs, out_batch, rows_of, texts
from loomline.llm.tokens import default_path, encoder

MAGIC, LEVEL, END_ID = b"TIDS0001", 3, 2


@dataclass(frozen=True)
class Shard:
    path: str
    first_doc: int
    documents: int
    tokens: int
    size: int


def train_dictionary(docs: DataFrame, tokenizer: str, samples: int = 1000, sample_bytes: int = 8192, size: int = 32768) -> bytes:
    """A dictionary from the serialized ids of at most ``samples`` short documents; b'' if they are too few."""
    short = docs.filter(F.octet_length("text").between(1, sample_bytes)).select("doc_id", "text")
    rows = by_hash(short, "doc_id", samples).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(samples).collect()
    own = encoder(tokenizer)
    kind = _width(own.vocab_size)
    try:
        return zstandard.train_dictionary(size, [np.array(x, kind).tobytes() for x in own.encode([r["text"] for r in rows])]).as_bytes()
    except zstandard.ZstdError as e:
        warnings.warn(f"no dictionary from {len(rows)} documents of at most {sample_bytes} bytes: {e}", stacklevel=2)
        return b""


def _width(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def _writer(folder: str, tokenizer: str, dictionary: bytes, end_id: int):
    schema = pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), ("size", pa.int64())])

    def write(batches):
        own, fs_at, out = encoder(tokenizer), open_fs(folder), None
        kind, (fs, at) = _width(max(own.vocab_size, end_id + 1)), fs_at
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        name, index, place = f"shard-{uuid.uuid4().hex}.tids", [], len(MAGIC)
        for batch in batches:
            for part in rows_of(batch, 128):
                for doc, ids in zip(part.column("doc_id").to_pylist(), own.encode(texts(part, "text"))):
                    ids.append(end_id)
                    frame = press.compress(np.array(ids, kind).tobytes())
                    if out is None:
                        out = fs.open_output_stream(f"{at}/{name}")
                        out.write(MAGIC)
                    out.write(frame)
                    index.append((-1 << 63 if doc is None else doc, place, len(frame), len(ids)))
                    place += len(frame)
        if out is None:
            return
        table = np.array(index, "<i8").T.copy()
        out.write(table.tobytes())
        foot = json.dumps({"dictionary": hashlib.sha256(dictionary).hexdigest() if dictionary else "", "ids": kind, "documents": len(index), "index": place}).encode()
        out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        out.close()
        yield out_batch(schema, ([f"{folder}/{name}"], [index[0][0]], [len(index)], [int(table[3].sum())], [place]))

    return write


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> list[Shard]:
    """Write docs (doc_id, text) to folder; the shards in ascending doc_id order, one for each range of ids."""
    tokenizer = tokenizer or default_path()
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    fs, at = open_fs(folder)
    fs.create_dir(at, recursive=True)
    dictionary = train_dictionary(docs, tokenizer)
    if dictionary:
        with fs.open_output_stream(f"{at}/dict-{hashlib.sha256(dictionary).hexdigest()}.zdict") as f:
            f.write(dictionary)
    order = ("doc_id", "h")
    ranged = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = ranged.mapInArrow(_writer(folder, tokenizer, dictionary, end_id), "path string, first_doc bigint, documents bigint, tokens bigint, size bigint").collect()
    return sorted((Shard(*r) for r in rows), key=lambda s: s.first_doc)


class ShardFile:
    """One shard, opened for reading single documents or all."""

    def __init__(self, path: str):
        fs, at = open_fs(path)
        self._file, folder = fs.open_input_file(at), at.rpartition("/")[0]
        size = self._file.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        long = int.from_bytes(tail[:8], "little")
        foot = json.loads(self._read(size - 16 - long, long))
        self.kind, self.documents = foot["ids"], foot["documents"]
        self.doc_ids, self.offsets, self.sizes, self.tokens = np.frombuffer(self._read(foot["index"], 32 * foot["documents"]), "<i8").reshape(4, -1)
        shared = None
        if foot["dictionary"]:
            with fs.open_input_file(f"{folder}/dict-{foot['dictionary']}.zdict") as f:
                data = f.read()
            if hashlib.sha256(data).hexdigest() != foot["dictionary"]:
                raise ValueError("the dictionary isn't the one that the shard names")
            shared = zstandard.ZstdCompressionDict(data)
        self._press = zstandard.ZstdDecompressor(dict_data=shared)

    def _read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        return self._file.read(n)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return np.frombuffer(self._press.decompress(self._read(int(self.offsets[k]), int(self.sizes[k]))), self.kind)

    def runs(self, size: int = 8 << 20):
        """(first document, ids of each) of consecutive documents, of about ``size`` compressed bytes: one read for each run."""
        at = 0
        while at < self.documents:
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + size, side="right")) - 1)
            to = self.documents if to >= self.documents - 1 and self.offsets[-1] + self.sizes[-1] <= self.offsets[at] + size else min(to, self.documents)
            data, base = self._read(int(self.offsets[at]), int(self.offsets[to - 1] + self.sizes[to - 1] - self.offsets[at])), int(self.offsets[at])
            yield at, (np.frombuffer(self._press.decompress(data[o - base : o - base + n]), self.kind) for o, n in zip(self.offsets[at:to].tolist(), self.sizes[at:to].tolist()))
            at = to

    def document(self, doc_id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.doc_ids, doc_id))
        return self.ids(k) if k < self.documents and self.doc_ids[k] == doc_id else None


def _reader(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            shard = ShardFile(path)
            starts = base + np.concatenate([[0], np.cumsum(shard.tokens)[:-1]]).astype("i8")
            for at, documents in shard.runs():
                sums, lens = [], []
                for ids in documents:
                    lens.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                to = at + len(lens)
                own = [None if d == -1 << 63 else d for d in shard.doc_ids[at:to].tolist()]
                yield out_batch(schema, (own, starts[at:to], lens, sums))


def read_files(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the checksum of the ids, read back from the files."""
    bases = [0, *accumulate(s.tokens for s in shards)]
    rows = [(s.path, b) for s, b in zip(shards, bases)]
    manifest = spark.createDataFrame(rows, "path string, base bigint").repartition(max(1, len(rows)))
    return manifest.mapInArrow(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
