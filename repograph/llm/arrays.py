"""Batches of texts as numpy arrays inside a task.

A batch is cut into slices of about ``SLICE_BYTES``; a longer text is a slice of its own.  Memory in a
task is some sixty bytes for each byte of a slice, so it follows the longest text, not the data.
Strings are hashed by blocks of eight bytes, each mixed in.  Windows of one short width have polynomial
prefix sums with a final mix; longer strings must not, as some of 1024 bytes and more collide for every base.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import inspect
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.zeros(256, bool)
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
# Scripts that are written without blanks between words.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
    (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x303C), (0x3040, 0x312F), (0x31A0, 0x9FFF),
    (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x11700, 0x1174F),
    (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF))
# Strings up to so many bytes are hashed by blocks, longer ones by a digest.
SHORT = 64
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""

    return mix(a * U64(0xD6E8FEB86659FD93) + b)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; nulls are empty."""

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""

    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = max(start + 1, min(stop, rows))
        yield start, stop
        start = stop


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of each slice of a text column."""

    data, offsets = column_bytes(column)
    for start, stop in slices(offsets, limit):
        yield start, stop, data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, from 0 to n."""

    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        grown = np.full((2, size), BASE, np.uint64)
        grown[1] = U64(pow(int(BASE), -1, 2**64))
        grown[:, 0] = 1
        _powers, _inverses = np.cumprod(grown, axis=1)
    return _powers, _inverses


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(len(data))[0][:len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of short byte ranges; equal strings have equal hashes wherever they stand."""

    return mix((sums[stops] - sums[starts]) * powers(len(sums))[1][starts])


def string_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of any length."""

    lengths = stops - starts
    found = mix(lengths.astype(np.uint64) + BASE)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    left = np.flatnonzero((lengths > 0) & (lengths <= SHORT))
    at, rest = starts[left], lengths[left]
    while len(left):
        found[left] = joined(found[left], eight[at] & _KEPT[np.minimum(rest, 8)])
        on = rest > 8
        left, at, rest = left[on], at[on] + 8, rest[on] - 8
    for i in np.flatnonzero(lengths > SHORT).tolist():
        digest = hashlib.blake2b(data[starts[i]:stops[i]], digest_size=8).digest()
        found[i] = int.from_bytes(digest, "little")
    return found


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of words (no byte of ``between``: 09-0D and 20), and each row's first word."""

    return _bounds(between[data], offsets)


def _bounds(
    space: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before, after = np.ones(len(space), bool), np.ones(len(space), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    if breaks is not None:
        before[breaks[breaks < len(space)]] = True
        after[breaks[breaks > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    stops = np.flatnonzero(~space & after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and each row's first word (with the end)."""

    data = lowered(data)
    starts, stops, first = word_bounds(data, offsets, between)
    return string_hashes(data, starts, stops), first


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 for marks, 2 for characters that are words of their own, 0 for others."""

    kinds = np.zeros(0x110000, np.uint8)
    for first, last in UNSPACED:
        kinds[first:last + 1] = 2
    # Marks and symbols lie in these two ranges.
    for point in (*range(0x20000), *range(0xE0000, 0xE0200)):
        category = unicodedata.category(chr(point))
        if category[0] in "PZ" or category in ("Cc", "Cf", "Sk"):
            kinds[point] = 1
        elif category[0] == "S":
            kinds[point] = 2
    kinds[0xFE00:0xFE10] = kinds[0xE0100:0xE01F0] = 1  # variation selectors
    return kinds


def script_word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes`` with words of all scripts between marks.

    Marks are ``MARKS`` and Unicode punctuation, blanks and format characters.  Each character of a script
    without blanks is a word, as is each symbol that is not ASCII.
    """

    data = lowered(data)
    space, breaks = MARKS[data], None
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        point = data[at].astype(np.int64)
        size = 2 + (point >= 0xE0) + (point >= 0xF0)
        point &= np.array([0x1F, 0x0F, 0x07])[size - 2]
        for i in range(1, 4):
            more = data[np.minimum(at + i, len(data) - 1)] & 0x3F
            point = np.where(size > i, point << 6 | more, point)
        kind = _kinds()[np.minimum(point, 0x10FFFF)]
        for i in range(4):
            space[np.minimum(at + i, len(data) - 1)[(kind == 1) & (size > i)]] = True
        own = kind == 2
        breaks = np.concatenate([at[own], np.minimum(at + size, len(data))[own]])
    starts, stops, first = _bounds(space, offsets, breaks)
    return string_hashes(data, starts, stops), first


def row_numbers(first: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' first elements."""

    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted within each row, and each row's first one.

    A row with 1 to size-1 words has its whole sequence as its only shingle.
    """

    counts = np.diff(first)
    found, rows = [], []
    for length in range(1, size + 1):
        if length < size:
            starts = first[:-1][counts == length]
            owners = np.flatnonzero(counts == length)
        else:
            at = np.arange(max(0, len(words) - size + 1))
            owners = row_numbers(first)[:len(at)]
            inside = at + size <= first[1:][owners]
            starts, owners = at[inside], owners[inside]
        if len(starts):
            value = np.full(len(starts), length, np.uint64)
            for i in range(length):
                value = joined(value, words[starts + i])
            found.append(value)
            rows.append(owners)
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(first), np.int64)
    value, owner = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(first)))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of several runs, one after another."""

    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def release() -> None:
    """Give freed memory back to the system: workers live long and share an executor's memory."""

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(function: Callable) -> Callable:
    """A function on batches or a group's table that releases memory when it is done."""

    if inspect.isgeneratorfunction(function):

        @functools.wraps(function)
        def run(batches):
            try:
                yield from function(batches)
            finally:
                release()
    else:

        @functools.wraps(function)
        def run(table):
            try:
                return function(table)
            finally:
                release()

    return run
