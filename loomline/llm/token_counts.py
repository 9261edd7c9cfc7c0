"""Token counts with a digest cache.

The cache is a Parquet table (digest, n_tokens), partitioned by tokenizer, in a shared folder. A run joins the digests of its texts with
it, encodes each distinct text that has no count, appends those counts and joins again; where all have counts, no text is moved.
``compact_cache`` rewrites what many runs appended. Texts are normalised (by
default a null becomes the empty text and nothing else changes, so counts are those of the texts as they are) before
they are hashed and encoded. The tokenizer's digest covers its file, so another version never meets old counts.

Repeated rows and equal texts (ties) share one count and keep a row each. An empty table appends nothing. Very long texts are
encoded whole. Extra columns of docs are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches, col, discard, open_fs, out_batch, rows_of, stored
from loomline.llm.tokens import default_path, encoder

LIMIT = 512
CACHE_SCHEMA = "digest binary, n_tokens bigint, tokenizer string"


def no_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _exists(path: str) -> bool:
    fs, at = open_fs(path)
    return fs.get_file_info(at).type.name == "Directory"


def read_cache(spark, path: str, version: str) -> DataFrame:
    """Digests and counts of one tokenizer version; a digest that two runs appended counts once."""
    if not _exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _first_of_task(batches):
    """Digest and text, once for each text of a task: copies leave before the shuffle."""
    seen: set[bytes] = set()
    schema = pa.schema([("digest", pa.binary()), ("text", pa.string())])
    for batch in batches:
        digests, keep = [], []
        for i, x in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
            d = hashlib.sha256(x).digest()
            if d not in seen:
                seen.add(d)
                digests.append(d)
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0).take(pa.array(keep, pa.int64()))], schema=schema)


def _counter(path: str):
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    def count(batches):
        own, seen = encoder(path), set()
        for batch in batches:
            for part in rows_of(batch):
                pairs = {d: x for d, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if d not in seen}
                seen.update(pairs)
                yield out_batch(schema, (list(pairs), [len(x) for x in own.encode(list(pairs.values()))]))

    return count


def count_tokens(
    docs: DataFrame, cache: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = no_null
) -> DataFrame:
    """doc_id, n_bytes and n_tokens of the normalised text of each row; counts that were missing are in the cache afterwards."""
    spark, path = docs.sparkSession, tokenizer or default_path()
    bounded_batches(spark)
    version = encoder(path).digest
    content = no_null(normalise(col(text_col)))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    keyed = docs.select(col(id_col).alias("doc_id"), digest.alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    keyed = stored(keyed, "digests")
    known = read_cache(spark, cache, version)
    missing = stored(keyed.select("digest").distinct().join(known.select("digest"), "digest", "left_anti"), "missing")
    if not missing.isEmpty():
        once = docs.select(content.alias("text")).mapInArrow(_first_of_task, "digest binary, text string")
        if not known.isEmpty():
            once = once.join(missing, "digest", "left_semi")
        fresh = once.repartition("digest").mapInArrow(_counter(path), "digest binary, n_tokens bigint")
        fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    discard(missing)
    # left, and stored counts: a digest is always there, and between plain exchanges large partitions of a left join can be split
    # when copies share one digest
    counts = stored(read_cache(spark, cache, version), "counts")
    return keyed.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def compact_cache(spark: SparkSession, cache: str, compacted: str, files: int) -> None:
    """The cache, one row for each digest and tokenizer, as a new cache of about ``files`` files for each tokenizer."""
    once = spark.read.schema(CACHE_SCHEMA).parquet(cache).groupBy("tokenizer", "digest").agg(F.max("n_tokens").alias("n_tokens"))
    once.repartition(files, "digest").write.partitionBy("tokenizer").parquet(compacted)
