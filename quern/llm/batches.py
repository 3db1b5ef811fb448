"""Arrow batches cut so that each holds a bounded number of text bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.memory import give_back

BATCH_BYTES = 2 << 20
#: The same where a slice's words and their arrays take many times its bytes.
SMALL_BYTES = 1 << 19
#: Bytes of text after which a task returns what it has freed.
GIVE_BACK_BYTES = 16 << 20

_held: dict = {}


def held(key: object, make: Callable):
    """make()'s result, kept for the next tasks of this worker process until another key is asked for: one operator's memory at a time."""
    if key not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[key] = make()
    return _held[key]


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows with about `limit` bytes of text each; a longer text stands alone with its neighbours before it."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 16
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_texts(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, limit: int = BATCH_BYTES) -> DataFrame:
    """Apply make()(slice) to slices of bounded text bytes. make runs once a task, where it may load a tokenizer or a model. Freed memory is returned on the way and at the task's end, as idle workers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, done = make(), 0
        for batch in batches:
            for part in by_bytes(batch, column, limit):
                yield work(part)
                done += part.nbytes
                if done >= GIVE_BACK_BYTES:
                    done = 0
                    give_back()
            batch = part = None  # before the next one is read
        give_back()

    return df.mapInArrow(run, schema)
