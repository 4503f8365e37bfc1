"""Work that is sequential within a page, over whole partitions of pages: one Arrow stream, no frame a page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are handed on at a time.
ROWS = 4096


def _parted(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, which follow each other; a page may reach over batches."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            column = batch.column(k)
            for part in (column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)):
                new[1:] |= part[1:] != part[:-1]
        starts = np.flatnonzero(new).tolist()
        for begin, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            own = tuple(batch.column(k)[begin].as_py() for k in keys)
            if held and own != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            now = own
    if held:
        yield pa.Table.from_batches(held)


def by_page(rows: DataFrame, keys: list[str], order: list[str | Column], work: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """The tuples that `work` gives for the columns of each page, whose rows come in `order`. keys: integer columns that tell a page."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kind.types, strict=True)], schema=kind)
        for page in _parted(batches, keys):
            found += work({c: page.column(c).to_numpy() for c in page.column_names})
            if len(found) >= ROWS:
                yield packed()
                found = []
        if found:
            yield packed()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
