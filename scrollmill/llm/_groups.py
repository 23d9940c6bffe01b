"""Groups of rows that arrive sorted by their key in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys (no nulls in keys); only the open group is held."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        cut = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(cut[-1])
    if held is not None:
        yield held
