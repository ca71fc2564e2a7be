"""Groups of rows inside a task, for sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Stretches of rows with equal keys; a stretch may go on over batches. Keys are numbers without nulls."""
    rest: pa.Table | None = None

    def bounds(table: pa.Table) -> list[int]:
        changed = np.zeros(table.num_rows, dtype=bool)
        for key in keys:
            values = table.column(key).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        return [0, *np.flatnonzero(changed).tolist(), table.num_rows]

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        if not table.num_rows:
            continue
        cuts = bounds(table)
        for start, end in zip(cuts[:-2], cuts[1:-1]):
            yield table.slice(start, end - start)
        rest = table.slice(cuts[-2])
    if rest is not None and rest.num_rows:
        yield rest
