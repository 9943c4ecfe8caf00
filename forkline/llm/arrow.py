"""Arrow helpers of the operators: columns added to a table, and blocks of numbers packed into binary cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_BYTES = 4_000_000  # texts handed to one call


def parts(batch: pa.RecordBatch, column: int, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges whose texts have about ``limit`` bytes; a longer text is a range of its own."""
    sizes = np.frombuffer(
        pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).cast(pa.int64()).buffers()[1], np.int64
    )[: batch.num_rows]
    ends = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def add_columns(
    df: DataFrame, text: str, compute: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField]
) -> DataFrame:
    """``df`` with the columns that ``compute`` gives for its text column; columns of those names are replaced.

    Runs inside the rows: no shuffle, one range of texts in memory at a time.
    """
    names = {f.name for f in fields}
    keep = [c for c in df.columns if c not in names]
    # Private names on the way, so that a column may have any name, one with a dot included.
    source = df.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("__text"))
    made_fields = [T.StructField(f"__made{i}", f.dataType, f.nullable) for i, f in enumerate(fields)]
    schema = T.StructType([*source.schema.fields[:-1], *made_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, batch.num_columns - 1):
                made = compute(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *(f.name for f in fields))


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length as one binary cell."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpacked(cell: memoryview, *kinds: type) -> list[np.ndarray]:
    n, at, out = len(cell) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(cell, k, n, at))
        at += n * np.dtype(k).itemsize
    return out
