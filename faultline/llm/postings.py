"""Numbers of many texts, dealt over hash parts in few binary rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .textcode import U64


def part_of(value: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of the fingerprint space."""
    return ((value >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def deal(value: np.ndarray, row: np.ndarray, parts: int
         ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part that has values: part, rows present, values of each, and the places
    of the values (in row order)."""
    if not len(value):
        return
    part = part_of(value, parts)
    order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")
    sorted_part, sorted_row = part[order], row[order]
    edges = np.flatnonzero(np.r_[True, sorted_part[1:] != sorted_part[:-1]])
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
        r = sorted_row[a:b]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        yield int(sorted_part[a]), r[first], np.diff(np.r_[first, len(r)]), order[a:b]


def by_group(f: Callable, *args) -> Callable:
    """f(*args, group) in the form that applyInArrow recognizes."""
    def run(group: pa.Table) -> pa.Table:
        return f(*args, group)
    return run


def rows_of(keys: list[int], blobs: list[bytes], kinds: list[int] | None = None) -> pa.RecordBatch:
    cols = [pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())]
    names = ["key", "blob"]
    if kinds is not None:
        cols.insert(0, pa.array(kinds, pa.int32()))
        names.insert(0, "kind")
    return pa.RecordBatch.from_arrays(cols, names=names)
