"""Packed samples against a plain encoder of bits."""

import random

import numpy as np
import pytest

from riskloom.sources import recordings, samples


def encode(values, code):
    """Bits written one sample after the other, straight from the formats' descriptions."""
    low = lambda v, bits: v & ((1 << bits) - 1)
    if code == "212":
        out = b""
        for a, b in zip(values[::2], [*values[1::2], 0] if len(values) % 2 else values[1::2], strict=True):
            a, b = low(a, 12), low(b, 12)
            out += bytes([a & 0xFF, a >> 8 | (b >> 8) << 4, b & 0xFF])
        return out
    if code in ("310", "311"):
        values = [*values, *[0] * (-len(values) % 3)]
        out = b""
        for a, b, c in zip(values[::3], values[1::3], values[2::3], strict=True):
            a, b, c = (low(x, 10) for x in (a, b, c))
            if code == "311":
                out += (a | b << 10 | c << 20).to_bytes(4, "little")
            else:
                out += (a << 1 | (c & 31) << 11).to_bytes(2, "little") + (b << 1 | (c >> 5) << 11).to_bytes(2, "little")
        return out
    bits = samples.BITS[code]
    shift = 1 << (bits - 1) if code in ("80", "160") else 0
    return b"".join(low(v + shift, bits).to_bytes(bits // 8, "big" if code == "61" else "little") for v in values)


@pytest.mark.parametrize("code", samples.BITS)
def test_round_trip(code):
    rng = random.Random(code)
    most = 1 << (samples.BITS[code] - 1)
    for n in (0, 1, 2, 3, 4, 5, 100, 101):
        values = [rng.choice([-most, most - 1, 0, -1, rng.randint(-most, most - 1)]) for _ in range(n)]
        assert samples.unpack(encode(values, code), code, n).tolist() == values
        assert len(samples.unpack(encode(values, code), code, n + 1000)) >= n


def test_frames_and_offsets():
    formats = [samples.parse_format(f) for f in ("16x2+4", "16+4")]
    raw = b"head" + np.array([1, 3, 10, -32768, 7, 20, 5, 6, 30], "<i2").tobytes()
    got = samples.read_file(raw, formats, 0)
    assert got[0, [0, 2]].tolist() == [2.0, 5.5] and np.isnan(got[0, 1]) and got[1].tolist() == [10, 20, 30]
    for bad, why in (("8", "format 8"), ("", "format none"), ("16x", "format 16x")):
        with pytest.raises(ValueError, match=why):
            samples.read_file(raw, [samples.parse_format(bad)], 1)
    with pytest.raises(ValueError, match="differ"):
        samples.read_file(raw, [samples.Format("16"), samples.Format("24")], 1)
    with pytest.raises(ValueError, match="3 of 4 samples"):
        samples.read_file(raw, formats, 4)


def test_skewed_signals():
    raw = np.array([[1, 10], [2, 20], [3, 30], [4, 40], [5, -32768]], "<i2").tobytes()
    formats = [samples.parse_format("16"), samples.parse_format("16:2")]
    assert samples.read_file(raw, formats, 0).tolist() == [[1, 2, 3], [30, 40, pytest.approx(np.nan, nan_ok=True)]]
    assert samples.read_file(raw, formats, 2).tolist() == [[1, 2], [30, 40]]
    got = samples.read_file(raw, formats, 5)  # the file ends before the skewed signal does
    assert got[0].tolist() == [1, 2, 3, 4, 5] and got[1, :2].tolist() == [30, 40] and np.isnan(got[1, 2:]).all()
    assert np.isnan(samples.read_file(raw, [samples.parse_format("16"), samples.parse_format("16:9")], 5)[1]).all()


def test_records_of_segments(spark, tmp_path):
    x = np.arange(1, 25).reshape(12, 2)
    for name, rows, leads in (("s1", x[:4], ("I", "II")), ("s2", x[4:9], ("I", "II")), ("s3", x[9:, ::-1], ("II", "I")), ("v1", x[:3, :1], ("II",))):
        (tmp_path / f"{name}.hea").write_text(f"{name} {len(leads)} 100 {len(rows)}\n" + "".join(f"{name}.dat 16 10/mV 16 0 0 0 0 {lead}\n" for lead in leads))
        (tmp_path / f"{name}.dat").write_bytes(rows.astype("<i2").tobytes())
    (tmp_path / "u1.hea").write_text("u1 1 100 4\ns1.dat 16x2 10/uV 16 0 0 0 0 I\n")
    (tmp_path / "r1.hea").write_text("r1 1 50 4\ns1.dat 16x2 10/mV 16 0 0 0 0 I\n")
    (tmp_path / "lay.hea").write_text("lay 3 100 0\n~ 0 10/mV 16 0 0 0 0 I\n~ 0 10/mV 16 0 0 0 0 II\n~ 0 10/mV 16 0 0 0 0 V1\n")
    heads = {
        "fixed": "fixed/2 2 100 9\ns1 4\ns2 5\n", "turned": "turned/2 2 100\ns1 4\ns3 3\n", "varied": "varied/5 3 100 14\nlay 0\nv1 3\n~ 2\ns2 5\ns1 4\n",
        "lost": "lost/3 2 100 9\ns1 4\nnone 2\n~ 3\n", "less": "less/2 2 100 10\ns1 4\ns2 5\n", "wrong": "wrong/1 2 100 5\ns1 5\n", "units": "units/2 2 100 8\ns1 4\nu1 4\n", "rates": "rates/2 2 100 8\ns1 4\nr1 4\n",
        "alien": "alien/2 1 100 7\nv1 3\ns1 4\n", "gaps": "gaps/1 1 100 4\n~ 4\n", "torn": "torn/3 2 100 9\ns1 4\n",
    }
    for name, text in heads.items():
        (tmp_path / f"{name}.hea").write_text(text)
    headers = {r.record.rsplit("/", 1)[1]: r for r in recordings.read_headers(spark, str(tmp_path)).collect()}
    assert len(headers) == len(heads) + 7 and headers["varied"].sig_name == ["I", "II", "V1"] and headers["fixed"].units == ["mV", "mV"] and headers["fixed"].record_name == "fixed"
    assert [tuple(s) for s in headers["fixed"].segments] == [("s1", 4), ("s2", 5)] and headers["s1"].segments is None and "segment lines" in headers["torn"].error
    got = {r.record.rsplit("/", 1)[1]: r for r in recordings.read_recordings(spark, str(tmp_path)).collect()}
    assert len(got) == len(headers) and np.allclose(got["s1"].signal, x[:4].T / 10)
    assert got["fixed"].error is None and np.allclose(got["fixed"].signal, x[:9].T / 10)
    assert got["turned"].leads == ["I", "II"] and np.allclose(got["turned"].signal, np.concatenate([x[:4], x[9:]]).T / 10)
    want = np.full((3, 14), np.nan)
    want[1, :3], want[:2, 5:10], want[:2, 10:] = x[:3, 0], x[4:9].T, x[:4].T
    assert got["varied"].error is None and np.allclose(got["varied"].signal, want / 10, equal_nan=True)
    for name, why in {"lost": "segments without a header: none", "less": "segments of 9 samples, not 10", "wrong": "another rate or length", "units": "other units", "rates": "another rate", "alien": "the record lacks: I", "gaps": "segments without signals", "torn": "segment lines", "lay": "format 0"}.items():
        assert got[name].signal is None and why in got[name].error, name


def test_records_of_several_files_and_formats(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = {c: rng.integers(-500, 500, 40).tolist() for c in ("212", "311", "80")}
    x["80"] = [v % 100 for v in x["80"]]
    (tmp_path / "two.hea").write_text("two 3 100 20\ntwo.d0 212 100(5)/mV 12 0 0 0 0 I\ntwo.d0 212 100/mV 12 0 0 0 0 II\ntwo.d1 311 10/mV 10 0 0 0 0 III\n")
    (tmp_path / "two.d0").write_bytes(encode(x["212"], "212"))
    (tmp_path / "two.d1").write_bytes(encode(x["311"][:20], "311"))
    (tmp_path / "lost.hea").write_text("lost 2 100 20\ntwo.d1 311 10/mV 10 0 0 0 0 I\nnone.d2 80 10/mV 8 0 0 0 0 II\n")
    (tmp_path / "odd.hea").write_text("odd 1 100 20\ntwo.d0 508 10/mV\n")
    (tmp_path / "cut.hea").write_text("cut 1 100 99\ntwo.d1 311 10/mV\n")
    (tmp_path / "long.hea").write_text("long/2 1 100 40\na 20\nb 20\n")
    got = {r.record.rsplit("/", 1)[1]: r for r in recordings.read_recordings(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got["two"].error is None and got["two"].leads == ["I", "II", "III"]
    want = [[(v - 5) / 100 for v in x["212"][::2]], [v / 100 for v in x["212"][1::2]], [v / 10 for v in x["311"][:20]]]
    assert np.allclose(got["two"].signal, want)
    assert got["lost"].error == "no file of samples" and "format 508" in got["odd"].error and "of 99 samples" in got["cut"].error and "segments" in got["long"].error
    assert all(got[k].signal is None for k in ("lost", "odd", "cut", "long"))
