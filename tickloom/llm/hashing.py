"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text handled in one go.
GROUP_BYTES = 1_000_000

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_WHITE_BYTES = WHITE.tobytes()
#: glibc's number of the setting, and bytes from which a block goes back to the system as it is freed.
_MMAP_THRESHOLD, _LARGE = -3, 4_000_000


def give_back(first: bool = False) -> None:
    """Return this process's free memory to the system; at `first` also ask that large blocks always go back as they are freed."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        if first:
            libc.mallopt(_MMAP_THRESHOLD, _LARGE)
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it likes


def frugal(run: Callable) -> Callable:
    """A function for mapInArrow, whose worker gives its free memory back when a task ends: idle workers hold little."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(True)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


_PIECE = 1 << 18
#: Masks of the first 0 to 8 bytes of a little-endian number.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _piece(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    white = np.frombuffer(b"\1" + text.translate(_WHITE_BYTES) + b"\1", np.bool_)
    edges = np.flatnonzero(white[1:] != white[:-1])
    start, n = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(text) + 1, "<u8", text + bytes(8), 0, 1)
    h = mixed(eight[start] & _MASKS[np.minimum(n, 8)], 0)
    at, long = 8, np.flatnonzero(n > 8)
    while len(long):
        left = n[long] - at
        h[long] = mixed(h[long] * np.uint64(3) + (eight[start[long] + at] & _MASKS[np.minimum(left, 8)]), at)
        at, long = at + 8, long[left > 8]
    return start, h + n.astype(np.uint64)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of the words of UTF-8 text: runs of anything but space and \\t-\\r, A-Z as a-z.

    Words are read eight bytes at a time, the first eight of all words at once, then the next of those that are longer.
    Long texts are worked off in pieces of about 256 KB that end at white space.
    """
    text = text.lower()
    data = np.frombuffer(text, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = len(data)
        if end - at > 2 * _PIECE - 2:
            end = at + _PIECE
            step = 1 << 16
            while end < len(data) and not WHITE[data[end - 1]]:
                gap = np.flatnonzero(WHITE[data[end : end + step]])
                end = end + int(gap[0]) + 1 if len(gap) else min(len(data), end + step)
        start, h = _piece(text[at:end])
        starts.append(start + at)
        hashes.append(h)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def grouped(column: pa.Array, size_of_group: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of consecutive rows with about `size_of_group` bytes of text; null counts as empty."""
    first, group, size = 0, [], 0
    for i, x in enumerate(column):
        group.append((x.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= size_of_group:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of all shingles, in order: `words` words, or all words of a text with fewer."""
    start, h = word_hashes(b"\n".join(texts))
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    count = np.bincount(text, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < words))
    n = max(0, len(h) - words + 1)
    out = mixed(h[:n], words)
    for i in range(1, words):
        out = mixed(out + h[i : n + i], words)
    whole = text[:n] == text[words - 1 : n + words - 1]
    owner, out = text[:n][whole], out[whole]
    if len(short):
        first, few = np.cumsum(count) - count, []
        for t in short:
            x = mixed(h[first[t] : first[t] + 1], int(count[t]))
            for i in range(1, count[t]):
                x = mixed(x + h[first[t] + i], int(count[t]))
            few.append(x[0])
        owner, out = np.append(owner, short), np.append(out, np.array(few, np.uint64))
        order = np.argsort(owner, kind="stable")
        owner, out = owner[order], out[order]
    return owner, out


#: Bits of a rarity rank.
RANK_BITS = 11


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Ranks below 2**RANK_BITS that grow with the logarithm of a counter, so that rare members come first."""
    return np.minimum(np.log2(counts + 1.0) * 48, (1 << RANK_BITS) - 1).astype(np.uint16)


def ordered_sets(owner: np.ndarray, h: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, member, place of each owner's first member), members distinct, in order of rank, then of the member.

    `owner` ascends. One sort of 64-bit keys orders all; where two members of an owner agree in their keys, full keys decide.
    """
    if not len(h):
        return owner, h, np.empty(0, np.int64)
    bits = max(1, int(owner[-1]).bit_length())
    tail = np.uint64(64 - bits - RANK_BITS)
    key = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (rank.astype(np.uint64) << tail) | (h >> np.uint64(bits + RANK_BITS))
    order = np.argsort(key)
    key, sorted_h = key[order], h[order]
    same = key[1:] == key[:-1]
    if np.any(same & (sorted_h[1:] != sorted_h[:-1])):
        order = np.lexsort((h, rank, owner))
        sorted_h = h[order]
    owner, h = owner[order], sorted_h
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))
    owner, h = owner[new], h[new]
    return owner, h, np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))


def set_digests(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """128-bit digests of the sets of distinct members that begin at `first`: sums of two scramblings of the members."""
    both = np.stack([np.add.reduceat(mixed(h, s), first) for s in (0x1234567, 0x89ABCDEF)], 1) if len(first) else np.zeros((0, 2), np.uint64)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(np.ascontiguousarray(both).tobytes())]).cast(pa.binary())


def set_signatures(h: np.ndarray, first: np.ndarray, numbers: int) -> np.ndarray:
    """A row of `numbers` 64-bit numbers for each set of distinct members that begins at `first`.

    A member flips one bit, so that the bits in which two signatures differ are at most the members of one set only.
    """
    out = np.zeros((len(first), numbers), np.uint64)
    if len(first) and numbers == 1:
        out[:, 0] = np.bitwise_xor.reduceat(np.uint64(1) << (mixed(h, 0x51617) & np.uint64(63)), first)
    elif len(first):
        at = mixed(h, 0x51617)
        bit, number = np.uint64(1) << (at & np.uint64(63)), (at >> np.uint64(32)) % np.uint64(numbers)
        for k in range(numbers):
            out[:, k] = np.bitwise_xor.reduceat(np.where(number == k, bit, np.uint64(0)), first)
    return out


def differing_bits(a: list[str], b: list[str]) -> Column:
    """Bits in which two signatures, given by the names of their bigint columns, differ."""
    return F.expr(" + ".join(f"bit_count({x} ^ {y})" for x, y in zip(a, b)))
