"""Words of many texts at once, as codes into a dictionary of their bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
SPACE, BREAK = 0x20, 0x0A


def byte_table(lower: bool, space: bytes, breaks: bytes = b"") -> bytes:
    """A table for bytes.translate: A-Z in lower case if asked, all of `space` as blanks, all of `breaks` as line feeds.
    Bytes of UTF-8 above 0x7F belong to words."""
    table = bytearray(range(256))
    if lower:
        for a, b in zip(UPPER, LOWER, strict=True):
            table[a] = b
    for b in space:
        table[b] = SPACE
    for b in breaks:
        table[b] = BREAK
    return bytes(table)


@dataclass(frozen=True)
class Words:
    codes: np.ndarray  # of each word its place in the dictionary
    dictionary: pa.BinaryArray
    text: np.ndarray  # of each word its text
    piece: np.ndarray  # of each word a number that differs between pieces and texts

    def strings(self) -> list[str]:
        return self.dictionary.cast(pa.string()).to_pylist()


def split_words(texts: list[bytes], table: bytes) -> Words:
    """Words of the texts after translation: runs without blank and line feed. Breaks and ends of texts part pieces."""
    buffer = b"\n".join(texts).translate(table)
    raw = np.frombuffer(buffer, np.uint8)
    gap = (raw == SPACE) | (raw == BREAK)
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~gap].tobytes())])
    coded = flat.dictionary_encode()
    before = np.cumsum(raw == BREAK, dtype=np.int32) if len(raw) else np.zeros(0, np.int32)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    text = np.searchsorted(first, starts, "right") - 1
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.binary()), text, before[starts])


def word_hashes(dictionary: pa.BinaryArray) -> np.ndarray:
    """A 64-bit hash of each word; different words may share one."""
    if not len(dictionary):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(dictionary.buffers()[1], np.int32)[dictionary.offset : dictionary.offset + len(dictionary) + 1].astype(np.int64)
    raw = np.frombuffer(dictionary.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    return mixed(np.add.reduceat((raw + np.uint64(1)) * powers[place], starts))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over the whole number."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
