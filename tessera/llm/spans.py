"""Spans as (kind, start, end) in code points, end exclusive, and their digests."""

from __future__ import annotations

import bisect
import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import bound_batches

Span = tuple[str, int, int]


class Cover:
    """Disjoint stretches of a text, in order."""

    def __init__(self, stretches: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(stretches):
            self.add(start, end)

    def add(self, start: int, end: int) -> None:
        """Add a stretch; those that it touches become one with it."""
        i, j = bisect.bisect_left(self.ends, start), bisect.bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start

    def holds(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker's free memory goes back to the system.

    Python workers are used again and stay while others work, so what one
    task has needed at its most would otherwise be held by all of them.
    """
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def per_document(docs: DataFrame, schema: str, rows: Callable[[list[str]], list[tuple]], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Map whole texts to rows, one Arrow batch at a time; ids pass through untouched.

    ``rows`` gets the texts of a batch (null: empty) and returns one tuple of
    output values for each. ``columns`` are cast to the types in ``schema``.
    No shuffle; a lost task is simply run again.
    """
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made = rows(texts)
            values = list(zip(*made, strict=True)) if made else [[] for _ in names[len(columns) :]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(v) if len(v) else pa.array(v, pa.null()) for v in values)], names=names)

    bound_batches(docs.sparkSession)
    types = dict(x.split(" ") for x in schema.split(", "))
    return docs.select(*(F.col(c).cast(types[c]) for c in columns), "text").mapInArrow(lambda it: freed(run(it)), schema)
