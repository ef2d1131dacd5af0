"""Samples of signal files from packed bytes, by numpy.

A file's signals share a format and lie frame by frame; a signal may have several samples a frame, which are averaged. A signal with a skew of s
frames starts s frames later in the file; what the file doesn't hold of its end is missing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: Bits of a sample in each format; the lowest value stands for a missing sample.
BITS = {"16": 16, "61": 16, "160": 16, "24": 24, "32": 32, "80": 8, "212": 12, "310": 10, "311": 10}
#: Bytes of a group of samples, and samples in it, of the formats that pack several samples together.
PACKED = {"212": (3, 2), "310": (4, 3), "311": (4, 3)}
_FORMAT = re.compile(r"(\d+)(?:x(\d+))?(?::(\d+))?(?:\+(\d+))?")


@dataclass(frozen=True)
class Format:
    code: str
    per_frame: int = 1
    skew: int = 0
    offset: int = 0


def parse_format(text: str) -> Format:
    found = _FORMAT.fullmatch(text)
    if not found or found[1] not in BITS:
        raise ValueError(f"format {text or 'none'} isn't supported")
    return Format(found[1], int(found[2] or 1), int(found[3] or 0), int(found[4] or 0))


def _signed(x: np.ndarray, bits: int) -> np.ndarray:
    x = x.astype(np.int64) & ((1 << bits) - 1)
    return x - ((x >> (bits - 1)) << bits)


def unpack(raw: bytes, code: str, n: int) -> np.ndarray:
    """The first n samples, fewer if the bytes end before."""
    if code in PACKED:
        size, each = PACKED[code]
        whole = -(-n // each) * size
        b = np.frombuffer(raw[:whole].ljust(-(-len(raw[:whole]) // size) * size, b"\0"), np.uint8).reshape(-1, size).astype(np.int64)
        if code == "212":
            parts = [b[:, 0] | (b[:, 1] & 0x0F) << 8, b[:, 2] | (b[:, 1] >> 4) << 8]
        else:
            one, two = b[:, 0] | b[:, 1] << 8, b[:, 2] | b[:, 3] << 8
            if code == "310":
                parts = [one >> 1, two >> 1, one >> 11 | (two >> 11) << 5]
            else:
                word = one | two << 16
                parts = [word, word >> 10, word >> 20]
        held = min(n, len(raw) * each // size)
        return _signed(np.stack(parts, 1).ravel(), BITS[code])[:held]
    if code == "24":
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3)[:n].astype(np.int64)
        return _signed(b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16, 24)
    kind = {"16": "<i2", "61": ">i2", "160": "<u2", "32": "<i4", "80": "u1"}[code]
    x = np.frombuffer(raw[: len(raw) // np.dtype(kind).itemsize * np.dtype(kind).itemsize], kind)[:n].astype(np.int64)
    return x - (1 << (BITS[code] - 1)) if code in ("160", "80") else x


def read_file(raw: bytes, formats: list[Format], length: int) -> np.ndarray:
    """Signals x frames as float, missing samples as NaN, of one file's signals; length 0: as many frames as there are."""
    code, offset = formats[0].code, formats[0].offset
    if any((f.code, f.offset) != (code, offset) for f in formats):
        raise ValueError("signals of one file differ in format")
    frame = sum(f.per_frame for f in formats)
    raw = raw[offset:]
    size, each = PACKED.get(code, (BITS[code] // 8, 1))
    held = len(raw) * each // size // frame
    most = max(f.skew for f in formats)
    length = length or max(0, held - most)
    if held < length:
        raise ValueError(f"{held} of {length} samples")
    frames = min(held, length + most)
    x = unpack(raw, code, frames * frame).reshape(frames, frame).astype(float)
    x[x == -(1 << (BITS[code] - 1))] = np.nan
    out = np.full((len(formats), length), np.nan)
    ends = np.cumsum([f.per_frame for f in formats])
    for row, f, end in zip(out, formats, ends, strict=True):
        own = x[f.skew : f.skew + length, end - f.per_frame : end].mean(1)
        row[: len(own)] = own
    return out
