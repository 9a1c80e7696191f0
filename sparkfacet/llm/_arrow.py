"""Helpers for Arrow batches inside tasks: text as byte arrays, and words as 64-bit hashes.

Words and hashes are made for a slice of rows at once, so that the work per row stays in numpy. A slice holds about
SLICE_BYTES of text (or one longer text), which bounds a task's memory whatever the size of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

#: Odd multiplier of polynomial hashes, and the two of the final mixing (fixed values; any others would do).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)

#: Bytes that separate words: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case: digits, letters, everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, nulls as empty, and the n + 1 offsets of its rows in them."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


#: The lowest k bytes of a 64-bit number.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (maximal runs of is_word bytes inside a row, A-Z lower-cased), and the number in each row.

    A word is read as numbers of eight bytes. Each is mixed with its place in the word before they are summed, so that no
    pattern of letters cancels out, as it can in a polynomial; work and memory go with the number of words, not bytes."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = is_word[raw]
    first, last = np.empty(len(raw), bool), np.empty(len(raw), bool)
    first[0], last[-1] = inside[0], inside[-1]
    np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    cut = offsets[1:-1]
    cut = cut[(cut < len(raw)) & (cut > 0)]
    first[cut] |= inside[cut]  # a word ends where its row ends
    last[cut - 1] |= inside[cut - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    letters = np.zeros(len(raw) + 8, np.uint8)
    np.take(LOWER, raw, out=letters[:-8])
    eights = np.ndarray(len(raw), "<u8", letters, strides=(1,))  # from each byte on
    lengths = stops - starts
    parts = (lengths + 7) // 8
    if parts.max() == 1:
        chunk, begin, place = eights[starts] & LOW_BYTES[lengths], None, np.uint64(0)
    else:
        begin = np.cumsum(parts) - parts
        nth = np.arange(int(parts.sum())) - np.repeat(begin, parts)
        chunk = eights[np.repeat(starts, parts) + 8 * nth] & LOW_BYTES[np.minimum(np.repeat(lengths, parts) - 8 * nth, 8)]
        place = mix(nth.astype(np.uint64) * BASE)
    mixed = mix((chunk + BASE) ^ place)
    total = mixed if begin is None else np.add.reduceat(mixed, begin)
    return mix(total + lengths.astype(np.uint64) * MIX1), np.diff(np.searchsorted(starts, offsets))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
