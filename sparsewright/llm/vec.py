"""Whole texts as numpy byte arrays: words, lines and hashes without a Python loop per word.

Texts are joined into one buffer with a separator byte between them, in slices
of bounded size (a longer single text is a slice of its own), so memory follows
the slice and not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
U64 = np.uint64

#: Bytes of [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


def table_of(member) -> np.ndarray:
    """A 256-entry truth table of a predicate on bytes."""
    return np.array([bool(member(b)) for b in range(256)])


#: Word bytes of ``[^\x20\x09-\x0D]+``.
NON_SPACE = table_of(lambda b: b not in SPACE)
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased (so A-Z count).
ALNUM = table_of(lambda b: b >= 0x80 or chr(b).isalnum())
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Bytes that begin a code point.
LEAD = table_of(lambda b: b & 0xC0 != 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up = np.full(n, _BASE, dtype=U64)
    up[0] = 1
    inverse = U64(pow(int(_BASE), -1, 1 << 64))
    down = np.full(n, inverse, dtype=U64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each at least."""
    return _powers(max(18, int(n + 1).bit_length()))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] standing for buf[i:j] at offset i."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [begin, end); equal bytes hash alike wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[begin]) * down[begin])


class Slice:
    """Some texts in one buffer; text i is ``buf[at[i]:at[i] + size[i]]`` and a separator byte follows it."""

    def __init__(self, texts: pa.Array, separator: bytes = b"\n"):
        self.n = len(texts)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, self.n], pa.int32()), texts), separator)[0]
        self.bytes = (joined.as_py() if self.n else b"") + separator
        self.buf = np.frombuffer(self.bytes, dtype=np.uint8)
        self.size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.zeros(self.n, dtype=np.int64)
        if self.n:
            np.cumsum(self.size[:-1] + 1, out=self.at[1:])

    def words(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, first): byte spans of maximal runs of member bytes, and the first word of each text (n + 1 entries).

        The separator must not be a member, so no word crosses texts.
        """
        inside = np.zeros(len(self.buf) + 1, dtype=np.int8)
        inside[1:] = member[self.buf]
        edge = np.diff(inside)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.append(np.searchsorted(begin, self.at), len(begin))
        return begin, end, first


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as binary without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.binary())


def slices(batch: pa.RecordBatch, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch with a ``text`` column where its texts pass ``limit`` bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, s in enumerate(size):
        if i > begin and total + s > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(s)
    if begin < len(size):
        yield batch.slice(begin)


def group_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], empty groups 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
