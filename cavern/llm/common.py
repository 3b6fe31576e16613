"""Helpers shared by the operators: Arrow batches, ragged arrays, checkpoints and sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import checkpoint_folder, checkpointed, passing_folder  # noqa: F401

#: Unicode White_Space, as the Rust regular expressions of the tokenizers have it (fixed values).
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20
#: Bytes of a written table that a task holds before they go to its file.
WRITTEN_BLOCK = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share; where none is set, a local master gets a local one."""
    return checkpoint_folder(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder: compressed, and read again by column."""
    path = passing_folder(df.sparkSession, name)
    df.write.option("parquet.block.size", WRITTEN_BLOCK).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about `limit` bytes of `column`; a longer row is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column; null counts as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def ragged(values: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[offsets[i] : offsets[i] + lengths[i]] for each i, one after the other."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return values[np.repeat(offsets - starts, lengths) + np.arange(total)]


def n_parts(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def unsigned_crc32(column) -> F.Column:
    """CRC-32 of a string's UTF-8 bytes, as an unsigned long; null counts as the empty string."""
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary"))


def id_fold(column, folds: int = 5) -> F.Column:
    """crc32(id as text) mod folds; a null id counts as the empty text."""
    return unsigned_crc32(column.cast("string")) % folds
