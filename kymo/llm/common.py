"""What the operators of this subpackage share: the shared scratch folder, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one input table; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kymo_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._kymo_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: str) -> F.Column:
    """A text column as its UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def byte_values(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The values of a binary Arrow column, one at a time, without a list of them all."""
    for value in column:
        yield value.as_py() or b""


def arrow_type(name: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[name]


def batch(schema: str, columns: list) -> pa.RecordBatch:
    """A record batch for a schema like ``"doc_id long, n int"``."""
    fields = [x.split() for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, arrow_type(kind)) for (_, kind), c in zip(fields, columns, strict=True)], names=[name for name, _ in fields])


def char_starts(text: bytes) -> np.ndarray:
    """For every byte offset up to the length, how many code points begin before it."""
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(begins)))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches sorted by them; a run may span batches. Callers bound the run's size."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(b.column(k)[0].as_py() for k in keys)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change)
        start = 0
        for c in cuts:
            if c > start:
                held.append(b.slice(start, c - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], int(c)
        held.append(b.slice(start))
        last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by ``keys``, some batch together, with the number of each row's group."""
    held: list[pa.RecordBatch] = []

    def numbered(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts)
        return table, np.concatenate(([0], np.cumsum(_changes([table.column(k).to_numpy() for k in keys]))))

    for b in batches:
        if not b.num_rows:
            continue
        begins = held and any(b.column(k)[0] != held[-1].column(k)[held[-1].num_rows - 1] for k in keys)
        cuts = np.flatnonzero(_changes([b.column(k).to_numpy(zero_copy_only=False) for k in keys])) + 1
        cut = int(cuts[-1]) if len(cuts) else 0
        if cut:
            yield numbered([*held, b.slice(0, cut)])
        elif begins:
            yield numbered(held)
        held = [b.slice(cut)] if cut or begins else [*held, b]
    if held:
        yield numbered(held)


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row but the first differs from the one before."""
    return np.logical_or.reduce([v[1:] != v[:-1] for v in columns])


def texts_of(rows: DataFrame, chosen: list[int]) -> dict[int, bytes]:
    """The texts (column ``bytes``) whose hash is among ``chosen``, each once however often it occurs; the list's length is the bound."""
    few = rows.sparkSession.createDataFrame([(h,) for h in chosen], "hash long")
    found = rows.withColumn("hash", F.xxhash64("bytes")).join(F.broadcast(few), "hash").groupBy("hash").agg(F.first("bytes").alias("bytes")).collect()
    return {r.hash: bytes(r.bytes) for r in found}
