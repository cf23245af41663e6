"""Runs of equal keys of a sorted partition, handed to Python many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def grouped(
    batches: Iterator[pa.RecordBatch], key: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """Call ``work`` with whole runs of equal ``key`` of a sorted partition; several complete runs may come in one call.

    One Python call serves a whole Arrow batch of runs, so millions of tiny groups cost no call each; a run that
    crosses batches is joined before it is handed on.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            now = pa.concat_tables([rest, now])
        last = {k: now.column(k)[now.num_rows - 1].as_py() for k in key}
        at = now.num_rows
        step = 1024
        while at > 0:
            low = max(0, at - step)
            head = {k: now.column(k)[low].as_py() for k in key}
            if head != last:
                break
            at, step = low, step * 2
        low = max(0, at - step)
        while low < at:
            mid = (low + at) // 2
            if {k: now.column(k)[mid].as_py() for k in key} == last:
                at = mid
            else:
                low = mid + 1
        if at:
            yield from work(now.slice(0, at).combine_chunks())
        rest = now.slice(at).combine_chunks()
    if rest is not None and rest.num_rows:
        yield from work(rest.combine_chunks())
