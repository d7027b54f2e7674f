"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.shared import batch_rows, shared_dir, written

__all__ = ["batch_rows", "held_out", "learned_from", "list_array", "offsets_of", "read", "release", "replace_columns", "schema_with", "shared_dir", "slices", "spread", "text_bytes", "written"]

#: Bytes of text that one numpy pass takes at once; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Gives memory that a worker has freed back to the machine, as workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text is divisible by 5; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learned_from(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES):
    """Cuts a record batch into runs of rows of about ``most`` bytes of ``column``."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes + 16) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    begin = 0
    for end in [*cuts.tolist(), n]:
        if end > begin:
            yield batch.slice(begin, end - begin)
        begin = end


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets_of(lengths).astype(np.int32)), pa.array(values, type=kind))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after the other, and the length of each row; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = column.buffers()[2]
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, lengths


def replace_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added, or replaced where the name is there already."""
    names, columns = list(batch.schema.names), list(batch.columns)
    for name, values in new.items():
        if name in names:
            columns[names.index(name)] = values
        else:
            names.append(name)
            columns.append(values)
    return pa.RecordBatch.from_arrays(columns, names=names)


def schema_with(df: DataFrame, **new: str):
    """The schema of ``df`` with columns added or replaced, as DDL types by name."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    fields = {f.name: f for f in df.schema.fields}
    for name, kind in new.items():
        fields[name] = StructField(name, _parse_datatype_string(kind), True)
    return StructType(list(fields.values()))
