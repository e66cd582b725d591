"""Arrow plumbing shared by the operators that run Python on executors.

``append_columns`` adds computed columns to a frame in one ``mapInArrow`` pass. Batches are cut by
bytes as well as by rows, so a run of very long texts cannot blow up a worker.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framewright.llm.joins import column_of, unused

#: Bytes of text that one slice of a batch holds (a single longer text makes a slice of its own).
SLICE_BYTES = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system: an idle Python worker shares its executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def text_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, without copying; nulls read as empty."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, width)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [start, end) of a string array whose texts fill about ``limit`` bytes."""
    _, off = text_view(col)
    start, n = 0, len(col)
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def append_columns(
    df: DataFrame,
    text_col: str,
    outputs: T.StructType,
    make: Callable[[], Callable[[pa.Array], list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``df``'s columns (or ``keep``) plus ``outputs``, computed from ``text_col``.

    ``make`` is called once in each task and returns the function from a slice of the text column
    to one array for each output. An input column named like an output is replaced by it.
    """
    names = [f.name for f in outputs]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = unused(kept, "_framewright_text")
    frame = df.select(*[column_of(c) for c in kept], column_of(text_col).cast("string").alias(source))
    schema = T.StructType([frame.schema[c] for c in kept] + list(outputs.fields))
    types = [to_arrow_type(f.dataType) for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(source))
            for a, b in slices(text):
                part = text.slice(a, b - a)
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(fn(part), types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(kept))] + made, names=kept + names
                )
                del part, made
        del fn
        give_back()

    return frame.mapInArrow(run, schema)
