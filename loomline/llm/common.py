"""Shared folders, table reading and small column helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: What ``[^\x20\x09-\x0D]+`` leaves out: the white space between words.
BLANKS = " \t\n\x0b\f\r"
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where it is unset, only a local master may go on: a temporary folder is then set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="loomline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for one run's tables or files in the shared folder."""
    return f"{shared_root(spark)}/loomline/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and lost executors cost no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    _STORED.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: list[str] = []


def stored_paths(since: int = 0) -> list[str]:
    """The folders that stored() has made in this process, from the ``since``-th on."""
    return _STORED[since:]


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders, when nothing reads them any more."""
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files that stored() wrote for tables, when nothing reads them any more."""
    for df in tables:
        delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the batches that Python workers get by bytes, where the session has no smaller bound: rows may be very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", spark.conf.get(key).lower()).groups()
    bound = int(number) << 10 * " kmgt".index(unit if unit and unit != "b" else " ")
    if not 0 < bound <= size:
        spark.conf.set(key, f"{size}b")


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on: functions over Arrow batches can't take every name."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def with_field(df: DataFrame, name: str, kind: DataType) -> StructType:
    """The schema of df with one more column."""
    return StructType([*df.schema.fields, StructField(name, kind)])


def by_hash(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows of df whose key hashes low: about twice ``limit`` keys, however many rows there are.

    A sorted limit alone would have every task send ``limit`` rows; behind this filter all tasks together send few.
    """
    share = min(1.0, 2 * limit / max(1, df.count()))
    return df if share == 1.0 else df.filter(F.xxhash64(key) <= int(share * 2**64) - 2**63)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that driver and executors can open, for a URI or an absolute path; s3a and s3n mean s3."""
    uri = re.sub("^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _ASCII_UPPER, _ASCII_LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over a one-element array binds it."""
    return F.transform(F.array(value), body)[0]


def rows_of(batch: pa.RecordBatch, size: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that Python objects exist for few rows at a time."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, size: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``size`` bytes of texts, each with its texts; a longer text is a slice of its own."""
    data = batch.column(name).cast(pa.large_binary())
    ends = np.cumsum(np.nan_to_num(pc.binary_length(data).to_numpy(zero_copy_only=False).astype(float))) if batch.num_rows else np.zeros(0)
    at, done = 0, 0.0
    while at < batch.num_rows:
        to = min(max(at + 1, int(np.searchsorted(ends, done + size, side="right"))), at + 4096)
        yield batch.slice(at, to - at), [x or b"" for x in data.slice(at, to - at).to_pylist()]
        at, done = to, float(ends[to - 1])


def out_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
