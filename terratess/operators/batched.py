"""Ordered walks of many small groups in one task, without a call of a function per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an output batch, about.
ROWS = 1 << 15
Columns = list[np.ndarray]


def by_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[Columns], Columns | None], schema: str) -> DataFrame:
    """``run`` of each group of equal ``keys``, its rows in ``order``: the columns of ``rows`` (keys, order, others; all numeric) to those of ``schema``.

    A task walks its groups from sorted Arrow batches; memory holds one group at a time.
    """
    columns = [*keys, *order, *[c for c in rows.columns if c not in {*keys, *order}]]
    many = len(keys)

    def walk(batches) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        last = None
        out: list[Columns] = []
        size = 0

        def done() -> int:
            group = [np.concatenate(c) for c in zip(*held)] if len(held) > 1 else held[0]
            made = run(group)
            if made is None or not len(made[0]):
                return 0
            out.append(made)
            return len(made[0])

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], [str(k) for k in range(len(out[0]))])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = [np.asarray(c) for c in batch.columns]
            new = np.zeros(batch.num_rows - 1, dtype=bool)
            for k in values[:many]:
                new |= k[1:] != k[:-1]
            cuts = (np.flatnonzero(new) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                now = tuple(v[a] for v in values[:many])
                if held and now != last:
                    size += done()
                    held.clear()
                    if size >= ROWS:
                        yield table()
                        out.clear()
                        size = 0
                held.append([v[a:b] for v in values])
                last = now
        if held:
            done()
        if out:
            yield table()

    sorted_ = rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInArrow(_named(walk, schema), schema)


def _named(walk, schema: str):
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for batch in walk(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    return run
