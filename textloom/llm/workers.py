"""Arrow kernels in bounded memory.

What goes into a kernel and what comes out of it are batches of at most ``LIMIT`` bytes, whatever the texts' lengths (a longer single
row is a batch of its own). On the JVM's side of the pipe Arrow takes memory outside the heap and keeps it, so large batches would stay
with the executor; the session's limit is lowered for that. On the other side, Spark keeps Python workers alive between tasks, and what a
kernel's temporary arrays took stays with the process, since the C library and Arrow's allocator keep freed memory for later; so free
memory is returned to the system when a task ends.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT = 1 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def slices(batch: pa.RecordBatch, limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most limit bytes, or of one row."""
    if batch.num_rows < 2 or batch.nbytes <= limit:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), limit)
        yield from slices(batch.slice(half), limit)


def give_back() -> None:
    """Returns free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, kernel: Kernel, schema) -> DataFrame:
    """df.mapInArrow(kernel, schema) with batches of bounded size, and memory given back at the end of each task."""
    conf = df.sparkSession.conf
    if conf.get(_BYTES) != str(LIMIT):
        conf.set(_BYTES, str(LIMIT))

    def run(batches):
        try:
            for out in kernel(part for whole in batches for part in slices(whole)):
                yield from slices(out)
        finally:
            give_back()

    return df.mapInArrow(run, schema)
