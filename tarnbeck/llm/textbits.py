"""Words, characters and their hashes for whole batches of texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Kept(dict):
    """A cache of one process: what is shipped to executors is an empty one."""

    def __reduce__(self) -> tuple:
        return Kept, ()


_powers = Kept()


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n at least; kept, and made anew only when it grows."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 19), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""
    return mix(a * np.uint64(0x94D049BB133111EB) + b)


@dataclass
class Texts:
    """A run of texts as one byte string, each text ended by a newline; starts has a last entry
    that is the length of all."""

    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


@dataclass
class Words:
    """Words of a run of texts: byte spans, text number, hash; first has, for each text, the
    number of its first word, and a last entry that counts all."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def text_runs(texts: pa.Array, lower: bool = True, most: int = 1 << 19) -> Iterator[tuple[int, int, Texts]]:
    """(from row, to row, Texts) over all of a string column, null as empty, in runs of about so
    many bytes; a longer text is a run of its own, and is whole."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(texts):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, side="right")))
        part = texts.slice(lo, hi - lo).cast(pa.large_string()).fill_null("")
        if lower:
            part = pc.utf8_lower(part)
        size = pc.binary_length(part).to_numpy().astype(np.int64) + 1
        lists = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), part)
        joined = pc.binary_join(lists, pa.scalar("\n", pa.large_string()))[0].as_buffer()
        data = np.concatenate([np.frombuffer(joined, np.uint8), np.array([10], np.uint8)])
        yield lo, hi, Texts(data, np.concatenate(([0], np.cumsum(size))))
        lo = hi


def byte_set(member) -> np.ndarray:
    return np.array([bool(member(b)) for b in range(256)])


#: Letters, digits and all bytes of characters beyond ASCII.
WORD_BYTES = byte_set(lambda b: b >= 128 or chr(b).isalnum())
#: All but blanks.
INK_BYTES = byte_set(lambda b: b != 32 and not 9 <= b <= 13)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans: equal for equal bytes wherever they stand."""
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n)[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * _power_table(_INVERSE, n + 1)[start])


def find_words(texts: Texts, members: np.ndarray = WORD_BYTES) -> Words:
    inside = members[texts.data]
    inside[texts.starts[1:] - 1] = False
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    row = texts.row_of(start)
    first = np.searchsorted(start, texts.starts)
    return Words(start, end, row, hash_spans(texts.data, start, end), first)


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def fold_case(raw: Texts) -> Texts:
    """Lower case without changing a byte's place: A-Z, and capitals of two bytes in Latin-1."""
    data = _LOWER[raw.data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    data[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return Texts(data, raw.starts)


class HashSet:
    """Sorted hashes; most others are ruled out by a bitmap, made where it is first needed."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.table = np.sort(hashes)
        self.seen: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"table": self.table, "seen": None}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the table, -1 if it is not there."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.table):
            low = np.uint64((1 << 22) - 1)
            if self.seen is None:
                self.seen = np.zeros(1 << 22, bool)
                self.seen[self.table & low] = True
            maybe = np.flatnonzero(self.seen[hashes & low])
            at = np.minimum(np.searchsorted(self.table, hashes[maybe]), len(self.table) - 1)
            out[maybe] = np.where(self.table[at] == hashes[maybe], at, -1)
        return out
