"""Images of recordings: pixels of known lines, files that can be decoded, rows with errors."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import images, signals


def decoded(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, {}
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        chunks[kind], at = body, at + 12 + size
    width, height, depth, colour = struct.unpack(">IIBB", chunks[b"IHDR"][:10])
    assert (depth, colour) == (8, 2) and list(chunks) == [b"IHDR", b"IDAT", b"IEND"]
    lines = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(height, 1 + 3 * width)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(height, width, 3)


def plain(values, box, dark):
    """A polyline by stepping along each piece."""
    n = len(values)
    points = [(box.left + (k / (n - 1) if n > 1 else 0) * (box.right - box.left), box.bottom - (min(max(v, -2.0), 2.5) + 2.0) / 4.5 * (box.bottom - box.top)) for k, v in enumerate(values)]
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[-1]], strict=True):
        steps = max(1, int(np.ceil(max(abs(x1 - x0), abs(y1 - y0)))))
        for k in range(steps):
            dark[int(np.rint(y0 + k / steps * (y1 - y0))), int(np.rint(x0 + k / steps * (x1 - x0)))] = True


@pytest.mark.parametrize("layout,size,n", [("standard_3x4", (384, 384), 500), ("stacked_12", (300, 200), 500), ("standard_3x4", (128, 96), 3), ("stacked_12", (128, 96), 1)])
def test_pixels_of_known_lines(layout, size, n):
    rng = np.random.default_rng(n)
    leads = rng.normal(0, 1.2, (12, n))
    sheet = images.Sheet(layout, *size, labels=False)
    pixels = images.draw(leads, sheet)
    assert pixels.shape == (size[1], size[0], 3) and set(np.unique(pixels)) == {0, 255}
    dark = np.zeros((size[1], size[0]), bool)
    for box in images.boxes(sheet):
        first, last = round(box.start * n), max(round(box.end * n), round(box.start * n) + 1)
        plain(leads[signals.CLINICAL.index(box.lead)][first:last], box, dark)
    assert ((pixels[:, :, 0] == 0) == dark).all() and (pixels[:, :, 0] == pixels[:, :, 2]).all()


def test_a_flat_line_lies_at_its_height():
    sheet = images.Sheet("stacked_12", 200, 400, labels=False)
    pixels = images.draw(np.stack([np.full(50, v) for v in np.linspace(-3, 3, 12)]), sheet)
    for box, v in zip(images.boxes(sheet), np.linspace(-3, 3, 12), strict=True):
        rows = np.flatnonzero((pixels[box.top : box.bottom + 1, :, 0] == 0).any(1)) + box.top
        assert rows.tolist() == [round(box.bottom - (np.clip(v, -2, 2.5) + 2) / 4.5 * (box.bottom - box.top))]
        assert np.flatnonzero(pixels[rows[0], :, 0] == 0).tolist() == list(range(box.left, box.right + 1))


def test_boxes_do_not_overlap_and_labels_differ():
    for layout in images.LAYOUTS:
        sheet = images.Sheet(layout)
        taken = np.zeros((sheet.height, sheet.width), int)
        for b in images.boxes(sheet):
            taken[b.top : b.bottom + 1, b.left : b.right + 1] += 1
        assert taken.max() == 1 and len(images.boxes(sheet)) == {"standard_3x4": 13, "stacked_12": 12}[layout]
    flat = np.zeros((12, 100))
    assert (images.draw(flat) != images.draw(flat, images.Sheet(labels=False))).any()
    thick = images.draw(flat, images.Sheet(labels=False, line=3))
    assert (thick == 0).sum() == 3 * (images.draw(flat, images.Sheet(labels=False)) == 0).sum()


def test_other_layouts_are_errors():
    with pytest.raises(ValueError, match="layout"):
        images.Sheet("circle")
    with pytest.raises(ValueError, match="64"):
        images.Sheet(width=10)


def test_rows_keep_their_errors(spark):
    good = [[float(np.sin(k / 9 + lead)) for k in range(80)] for lead in range(12)]
    rows = [(1, good), (2, None), (3, [[float("nan")] * 5] * 12), (4, [[]] * 12), (5, [[1.0] * 4] * 11), (6, [[1.0] * 4] * 11 + [[1.0] * 5]), (7, [[0.5]] * 12), (8, good)]
    df = spark.createDataFrame(rows, "id int, signal array<array<double>>").withColumn("leads", F.array(*map(F.lit, signals.CLINICAL))).withColumn("IMAGE", F.lit("clash")).repartition(3)
    got = {r.id: r for r in images.render(df, ["id"], images.Sheet("stacked_12", 160, 120)).collect()}
    assert [k for k in sorted(got) if got[k].is_valid] == [1, 7, 8] and bytes(got[1].image) == bytes(got[8].image)
    pixels = decoded(bytes(got[1].image))
    assert pixels.shape == (120, 160, 3) and (pixels[:, :, 0] == 0).sum() == got[1].dark and (pixels == images.draw(np.array(good), images.Sheet("stacked_12", 160, 120))).all()
    assert all(got[k].image is None and got[k].dark is None for k in (2, 3, 4, 5, 6))
    assert "no samples" in got[4].error and "null, NaN" in got[3].error and "differ in number" in got[5].error
