"""Token ids of whole texts by the tokenizers library, unit by unit.

The vocabulary is read with its own pre-tokenizer (no normalizer, no prefix space), whose
pattern always ends a token before a blank that a visible character follows, and between a
letter and one of ``.,;:!?``. Texts are cut there into units; equal units have equal ids, so
that each distinct unit is encoded once. The end-of-text mark has none of these places.
"""

from __future__ import annotations

import gc
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .textcode import flat, pieces, ragged

#: bytes after which a blank surely starts a token: visible ASCII and lead bytes of UTF-8
#: sequences under which there is no white space (not C2, E1, E2, E3)
_VISIBLE = np.zeros(256, bool)
_VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP[[*b".,;:!?"]] = True


def unit_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units start, and how many each row has (an empty row: none)."""
    cut = np.zeros(len(data) + 1, bool)
    cut[:-2][(data[:-1] == 0x20) & _VISIBLE[data[1:]]] = True
    cut[1:-1] |= _LETTER[data[:-1]] & _STOP[data[1:]]
    cut[offs[1:][offs[1:] > 0] - 1] &= ~(data[offs[1:][offs[1:] > 0] - 1] == 0x20)  # the next byte belongs to another row
    cut[offs] = True
    cut[len(data)] = False
    starts = np.flatnonzero(cut)
    return starts, np.diff(np.searchsorted(starts, offs))


class Encoder:
    """Ids of texts; ``most`` distinct units are remembered between calls."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, units: list[bytes]) -> None:
        ids, first, on = [self.ids], [self.first], gc.isenabled()
        gc.disable()  # many small lists, none in a cycle
        try:
            for a in range(0, len(units), 10_000):
                block = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units[a:a + 10_000]], add_special_tokens=False)]
                first.append(first[-1][-1] + np.cumsum(np.fromiter(map(len, block), np.int64, len(block))))
                ids.append(np.fromiter(chain.from_iterable(block), np.uint32))
        finally:
            if on:
                gc.enable()
        self.place.update(zip(units, range(len(self.place), len(self.place) + len(units))))
        self.ids, self.first = np.concatenate(ids), np.concatenate(first)

    def _piece(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, n_units = unit_starts(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        edges = np.append(starts, len(data)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.place) > self.most:
            self._forget()
        self._learn([u for u in names if u not in self.place])
        place = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        first = self.first
        count = np.diff(first)[place]
        total = np.concatenate([[0], np.cumsum(count)])
        edge = np.concatenate([[0], np.cumsum(n_units)])
        return self.ids[ragged(first[place], count)], np.diff(total[edge])

    def __call__(self, texts: pa.Array, end_id: int | None = None, limit: int = 1 << 21):
        """(first row, ids of its rows, their number for each row) in pieces of about
        ``limit`` bytes of text; null is empty; ``end_id`` is added to every row."""
        for a, b, data, offs in pieces(*flat(texts), limit):
            ids, count = self._piece(data, offs)
            if end_id is not None:
                out = np.full(len(ids) + len(count), end_id, np.uint32)
                out[ragged(np.cumsum(count + 1) - count - 1, count)] = ids
                ids, count = out, count + 1
            yield a, ids, count


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, kept between its tasks."""
    return Encoder(path)
