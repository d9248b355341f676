"""Vectorised text kernels on Arrow columns: bytes, words, shingles.

Words are runs of bytes outside the six ASCII white-space characters, with
A-Z lower-cased.  Everything runs on whole blocks of texts at once; what needs
several numbers per byte runs in slices of ``SLICE_BYTES``, so that a very long
text costs memory per word, not per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SLICE_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
# One random-looking number per byte, by rule; white space counts nothing.
_BYTE = (np.arange(1, 257, dtype=np.uint64) * _ODD) ^ ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(29))
_BYTE[_SPACE] = 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_blocks(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array and the len(texts) + 1 borders in it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):  # no chunk at all
            texts = pa.array([], texts.type)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[borders[0] : borders[-1]], borders - borders[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_names(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word (as written) its first byte, its size and a whole number that
    equal words share, and the borders of the documents' words."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = borders[:-1][borders[:-1] < len(data)]
    begins[first] = solid[first]
    starts = np.flatnonzero(begins)
    at = np.searchsorted(starts, borders)
    if not len(starts):
        return starts, starts, starts, at
    sizes = np.add.reduceat(solid, starts, dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])])
    return starts, sizes, words.dictionary_encode().indices.to_numpy().astype(np.int64), at


_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SLICE_BYTES, _ODD)]), dtype=np.uint64)


def word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word, and the borders of the documents' words.

    A word's hash mixes the sum of its bytes' numbers, each times a power by its
    place in the word; a word that goes on in the next slice adds to its sum."""
    starts_of, sums_of = [], []
    firsts = borders[:-1]
    length = 0  # bytes so far of the word that the last slice ended in
    for at in range(0, len(data), SLICE_BYTES):
        part = data[at : at + SLICE_BYTES]
        space = _SPACE[part]
        begins = np.empty(len(part), bool)
        begins[0] = at == 0 or _SPACE[data[at - 1]]
        begins[1:] = space[:-1]
        begins[firsts[np.searchsorted(firsts, at) : np.searchsorted(firsts, at + len(part))] - at] = True
        starts = np.flatnonzero(begins & ~space)
        values = _BYTE[_LOWER[part]]
        head = int(starts[0]) if len(starts) else len(part)
        if length:  # (at most the word goes on here: white space counts nothing)
            base = np.uint64(pow(int(_ODD), length, 1 << 64))
            sums_of[-1][-1:] += base * np.sum(values[:head] * _POWERS[:head], keepdims=True)
            gap = np.flatnonzero(space[:head])
            length = length + head if not len(gap) and not len(starts) else 0
        if len(starts):
            spans = np.diff(np.append(starts, len(part)))
            place = np.arange(starts[0], len(part), dtype=np.int32) - np.repeat(starts.astype(np.int32), spans)
            values = values[head:] * _POWERS[place]
            sums_of.append(np.add.reduceat(values, starts - starts[0]))
            starts_of.append(starts + at)
            length = 0 if space[-1] else len(part) - int(starts[-1])
    if not starts_of:
        return np.empty(0, np.uint64), np.zeros(len(borders), np.int64)
    return mix64(np.concatenate(sums_of)), np.searchsorted(np.concatenate(starts_of), borders)


def shingle_sets(data: np.ndarray, borders: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct 64-bit hashes of its shingles: runs of
    ``width`` words, or all words as one where there are fewer."""
    words, at = word_hashes(data, borders)
    n = len(words)
    many = np.diff(at)
    out = [np.empty(0, np.uint64)] * len(many)
    rolled = mix64(words + np.uint64(1))
    for j in range(min(width, n)):  # ``rolled``: runs of j + 1 words by their first
        if j:
            rolled = rolled[: n - j] * np.uint64(0xC2B2AE3D27D4EB4F)
            rolled += words[j:]
            rolled = mix64(rolled)
        if j < width - 1:
            for r in np.flatnonzero(many == j + 1).tolist():
                out[r] = rolled[at[r] : at[r] + 1] ^ np.uint64(j + 1)
    for r in np.flatnonzero(many >= width).tolist():
        out[r] = np.unique(rolled[at[r] : at[r + 1] - width + 1])
    return out


def _mix32(x: np.ndarray, spare: np.ndarray) -> None:
    """A bijection of 32-bit numbers, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def circulant_minhash(sets: list[np.ndarray], coordinates: int, tile: int = 1 << 15) -> np.ndarray:
    """C-MinHash signatures (one row per set, none may be empty).

    Two permutations of the 32-bit numbers: the first scatters the elements;
    the second, shifted circularly by ``k``, gives coordinate ``k`` as the
    least image.  Sets are worked off in tiles that stay in the cache.
    """
    out = np.empty((len(sets), coordinates), np.uint32)
    begin = 0
    while begin < len(sets):
        end, held = begin + 1, len(sets[begin])
        while end < len(sets) and held + len(sets[end]) <= tile:
            held += len(sets[end])
            end += 1
        flat = np.concatenate(sets[begin:end])
        scattered = (mix64(flat) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[begin : end - 1]])
        x, spare = np.empty_like(scattered), np.empty_like(scattered)
        for k in range(coordinates):
            np.add(scattered, np.uint32(k), out=x)
            _mix32(x, spare)
            out[begin:end, k] = np.minimum.reduceat(x, starts)
        begin = end
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per band of equal width, as int64 (rows x bands)."""
    rows = signatures.shape[1] // bands
    keys = np.empty((len(signatures), bands), np.int64)
    for b in range(bands):
        h = np.full(len(signatures), b + 1, np.uint64) * _ODD
        for c in range(b * rows, (b + 1) * rows):
            h = mix64(h + signatures[:, c].astype(np.uint64))
        keys[:, b] = h.view(np.int64)
    return keys
