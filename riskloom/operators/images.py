"""Recordings as images: twelve leads drawn as lines on a white sheet, in numpy over Arrow batches.

Two layouts: `standard_3x4`, four columns of three leads, each over its quarter of the recording, above a strip of lead II over
its whole length; and `stacked_12`, all leads over their whole length below each other. All lines of a recording are drawn in one
pass: every piece between two samples becomes as many points as it spans pixels. A recording that can't be drawn keeps its
row with a message in `error`: no signal, leads missing or of several lengths, no samples, values that aren't finite. Values beyond
the range of a box are drawn on its edge. The same recording always gives the same bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import signals
from riskloom.session import ship

#: The range of a box in mV, and the leads of the grid by row and column.
LOW, HIGH = -2.0, 2.5
GRID = (("I", "aVR", "V1", "V4"), ("II", "aVL", "V2", "V5"), ("III", "aVF", "V3", "V6"))
RHYTHM = "II"
LAYOUTS = ("standard_3x4", "stacked_12")
#: Letters of lead names, rows of three pixels.
GLYPHS = {
    "I": "### .#. .#. .#. ###", "V": "#.# #.# #.# #.# .#.", "a": "... .## #.# #.# .##", "R": "##. #.# ##. #.# #.#", "L": "#.. #.. #.. #.. ###", "F": "### #.. ##. #.. #..",
    "1": ".#. ##. .#. .#. ###", "2": "##. ..# .#. #.. ###", "3": "##. ..# .#. ..# ##.", "4": "#.# #.# ### ..# ..#", "5": "### #.. ##. ..# ##.", "6": ".## #.. ### #.# ###",
}
#: Recordings of an Arrow batch that are drawn and sent together.
BATCH = 32


@dataclass(frozen=True)
class Sheet:
    """Size and layout of an image; margin and gap in pixels, width of lines in pixels."""

    layout: str = "standard_3x4"
    width: int = 384
    height: int = 384
    margin: int = 8
    gap: int = 4
    line: int = 1
    labels: bool = True

    def __post_init__(self) -> None:
        if self.layout not in LAYOUTS:
            raise ValueError(f"layout {self.layout!r} isn't one of {', '.join(LAYOUTS)}")
        if min(self.width, self.height) < 64 or self.line < 1:
            raise ValueError("an image has at least 64 pixels a side and lines of at least one")


@dataclass(frozen=True)
class Box:
    """A lead's place: pixels from left to right and top to bottom, both ends included, and its part of the recording's time."""

    lead: str
    left: int
    right: int
    top: int
    bottom: int
    start: float = 0.0
    end: float = 1.0


def boxes(sheet: Sheet) -> list[Box]:
    def cuts(size: int, parts: int) -> list[tuple[int, int]]:
        room = size - 2 * sheet.margin - (parts - 1) * sheet.gap
        return [(sheet.margin + k * sheet.gap + k * room // parts, sheet.margin + k * sheet.gap + (k + 1) * room // parts - 1) for k in range(parts)]

    ((left, right),) = cuts(sheet.width, 1)
    if sheet.layout == "stacked_12":
        return [Box(lead, left, right, top, bottom) for lead, (top, bottom) in zip(signals.CLINICAL, cuts(sheet.height, 12), strict=True)]
    rows, columns = cuts(sheet.height, 4), cuts(sheet.width, 4)
    grid = [Box(GRID[r][c], *columns[c], *rows[r], c / 4, (c + 1) / 4) for r in range(3) for c in range(4)]
    return [*grid, Box(RHYTHM, left, right, *rows[3])]


def draw(leads: np.ndarray, sheet: Sheet = Sheet()) -> np.ndarray:
    """height x width x 3 bytes of a recording: leads x samples in mV, in clinical order."""
    x, y, own = [], [], []
    places = boxes(sheet)
    for k, box in enumerate(places):
        n = leads.shape[1]
        part = leads[signals.CLINICAL.index(box.lead), round(box.start * n) : max(round(box.end * n), round(box.start * n) + 1)]
        share = np.arange(len(part)) / max(len(part) - 1, 1)
        x.append(box.left + share * (box.right - box.left))
        y.append(box.bottom - (np.clip(part, LOW, HIGH) - LOW) / (HIGH - LOW) * (box.bottom - box.top))
        own.append(np.full(len(part), k))
    x, y, own = np.concatenate(x), np.concatenate(y), np.concatenate(own)
    # points of each piece: one a pixel of its longer side; a box's last sample is a piece of its own
    same = np.append(own[1:] == own[:-1], False)
    dx, dy = np.where(same, np.append(np.diff(x), 0), 0), np.where(same, np.append(np.diff(y), 0), 0)
    steps = np.ceil(np.maximum(np.abs(dx), np.abs(dy))).astype(np.int64).clip(1)
    piece = np.repeat(np.arange(len(x)), steps)
    along = (np.arange(len(piece)) - np.repeat(np.cumsum(steps) - steps, steps)) / steps[piece]
    column, row = np.rint(x[piece] + along * dx[piece]).astype(int), np.rint(y[piece] + along * dy[piece]).astype(int)
    dark = np.zeros((sheet.height, sheet.width), bool)
    top, bottom = (np.array([getattr(b, c) for b in places])[own[piece]] for c in ("top", "bottom"))
    for k in range(sheet.line):
        dark[np.clip(row + k - sheet.line // 2, top, bottom), column] = True
    if sheet.labels:
        for box in places:
            _write(dark, box.lead, box.top, box.left + 2)
    return np.repeat(np.where(dark, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)


def _write(dark: np.ndarray, text: str, top: int, left: int) -> None:
    for letter in text:
        glyph = np.array([[c == "#" for c in line] for line in GLYPHS[letter].split()])
        dark[top : top + 5, left : left + 3] |= glyph
        left += 4


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of height x width x 3 bytes."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width, _ = pixels.shape
    # each line starts with its filter, which is none
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def render(df: DataFrame, keep: Sequence[str], sheet: Sheet = Sheet(), signal: str = "signal", names: str = "leads") -> DataFrame:
    """(keep, image, dark, is_valid, error): image is a PNG file, dark the number of its dark pixels."""
    ship(df.sparkSession)
    ordered = df.select(*keep, signals.reorder(F.col(signal), F.col(names), signals.CLINICAL).alias("_ordered"), signals.lead_error(F.col(signal), F.col(names), signals.CLINICAL).alias("_lead_error"))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("image", T.BinaryType()), T.StructField("dark", T.LongType()), T.StructField("is_valid", T.BooleanType()), T.StructField("error", T.StringType())])

    def one(x: np.ndarray | None, error: str | None) -> tuple[bytes | None, int | None, str | None]:
        if error is None and x is None:
            error = "no signal, or leads of several lengths"
        elif error is None and x.shape[1] == 0:
            error = "no samples"
        elif error is None and not np.isfinite(x).all():
            error = "signal holds null, NaN or infinite values"
        if error is not None:
            return None, None, error
        pixels = draw(x, sheet)
        return png(pixels), int((pixels[:, :, 0] == 0).sum()), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                made = [one(x, e) for x, e in zip(signals._recordings(batch.column("_ordered")), batch.column("_lead_error").to_pylist(), strict=True)]
                columns = [*(batch.column(c) for c in keep), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] is None for m in made]), pa.array([m[2] for m in made], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "image", "dark", "is_valid", "error"])

    return ordered.mapInArrow(run, schema)
