"""Blocks of documents as numpy arrays: tokenising with Arrow kernels, and packed number lists.

A block is a run of rows of one input partition, bounded in bytes of text. Corpus tables (words,
n-grams, pairs) are first counted within a block, so that what is shuffled holds each key once a block
however often it stands there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block; a longer text is a block by itself.
BLOCK_BYTES = 8 << 20


def text_blocks(texts: pa.Array, most: int = BLOCK_BYTES):
    """Index ranges of ``texts`` with about ``most`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and held + size > most:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between blanks, tabs and line ends, and the number of words of each text (null: none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(owner[real], minlength=len(sizes))
        words = words.filter(pa.array(real))
    return words, sizes


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers below 2**64 as compressed byte planes; the planes of high zero bytes cost next
    to nothing."""
    raw = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8)
    used = int(np.flatnonzero(raw.any(0)).max(initial=-1)) + 1
    planes = np.ascontiguousarray(raw[:, :used].T).tobytes()
    return len(numbers).to_bytes(8, "little") + bytes([used]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, used = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    if n and used:
        planes = pa.decompress(data[9:], decompressed_size=n * used, codec="zstd", asbytes=True)
        out[:, :used] = np.frombuffer(planes, np.uint8).reshape(used, n).T
    return out.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys, by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
