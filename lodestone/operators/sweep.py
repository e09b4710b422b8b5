"""Whole files, many at a time, as arrays: what lies together by file is cut into chunks that end between files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are gathered before they are worked on together.
CHUNK = 100_000


def by_file(work: Callable[[pa.Table, np.ndarray], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over rows in order of ``file``. ``work`` gets the rows of whole files and their numbers."""

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        file = rows["file"]
        starts = pc.not_equal(file.slice(1), file.slice(0, len(rows) - 1)).combine_chunks().to_numpy(zero_copy_only=False)
        yield from work(rows, np.concatenate(([0], np.cumsum(starts))).astype(np.int64)).to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= CHUNK:
                rows = pa.Table.from_batches(held)
                last = rows["file"][len(rows) - 1]  # its rows may go on in the next batch
                whole = len(rows) - pc.sum(pc.equal(rows["file"], last)).as_py()
                if whole:
                    yield from flush(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                size = len(rows) - whole
        if size:
            yield from flush(pa.Table.from_batches(held))

    return run


def innermost(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each site the innermost symbol that covers its line: rows with ``_pos`` -1 are sites, others symbols.

    A symbol that starts before the line and does not cover it rules out all symbols back to the last one that ends
    later than it does; so the search leaps from end to greater end.
    """

    def work(rows: pa.Table, file: np.ndarray) -> pa.Table:
        pos = rows["_pos"].to_numpy()
        at = rows["_at"].to_numpy().astype(np.int64)
        end = rows["_end"].combine_chunks().fill_null(2**31 - 1).to_numpy().astype(np.int64)
        site = pos < 0
        sym = np.flatnonzero(~site)
        sym = sym[np.lexsort((pos[sym], -end[sym], at[sym], file[sym]))]
        start, stop, of = at[sym], end[sym], file[sym]
        before = np.full(len(sym), -1, np.int64)
        stack: list[int] = []
        stops, ofs = stop.tolist(), of.tolist()
        for i in range(len(sym)):
            while stack and (ofs[stack[-1]] != ofs[i] or stops[stack[-1]] <= stops[i]):
                stack.pop()
            if stack:
                before[i] = stack[-1]
            stack.append(i)
        asked = np.flatnonzero(site)
        key = of << 32 | start & 0xFFFFFFFF
        found = np.searchsorted(key, file[asked] << 32 | at[asked] & 0xFFFFFFFF, side="right") - 1
        if len(sym):
            found[(found >= 0) & (of[found] != file[asked])] = -1
            while len(miss := np.flatnonzero((found >= 0) & (stop[found] < at[asked]))):
                found[miss] = before[found[miss]]
        take = pa.array(np.where(found >= 0, sym[found] if len(sym) else 0, 0), mask=found < 0)
        out = rows.select(columns).take(pa.array(asked))
        return out.append_column("enclosing", rows["_name"].take(take)).append_column("enclosing_line", rows["_at"].take(take))

    return by_file(work)
