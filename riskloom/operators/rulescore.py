"""The twelve-item rule score over a measurement struct, its category, and array preparation of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds (inclusive) and points of the stepped items, in the units of the published items.
Q_DURATION = ((0.0, 5.0), (15.0, 1.0), (25.0, 3.0), (35.0, 9.0), (45.0, 10.0))
Q_DURATION_ABOVE = 12.0
T_AVR = ((0.5, 6.0), (1.5, 3.0), (2.5, 0.0), (3.5, -2.0), (4.5, -5.0))
#: Upper bounds (exclusive) of the categories.
CATEGORY = ((10.0, "normal"), (15.0, "borderline"), (20.0, "possible_injury"))
CATEGORY_ABOVE = "probable_infarction"
#: The measurements.
FIELDS = ("avl_q_ms", "avl_t_pos", "avl_t_neg", "avr_r", "avr_t_pos", "ii_qr", "avf_qr", "iii_q_ms", "iii_t_neg", "v1_t_pos", "v2_r", "v2_t_neg", "v3_qr", "v5_s")
UNITS = {"uv": 1e-6, "µv": 1e-6, "mv": 1e-3, "v": 1.0}


def _steps(x: Column, steps, above: Column | float) -> Column:
    out = F.when(x <= steps[0][0], F.lit(steps[0][1]))
    for bound, points in steps[1:]:
        out = out.when(x <= bound, F.lit(points))
    return out.otherwise(above)


def _if(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def items(m: dict[str, Column]) -> list[Column]:
    """The twelve items; m: a column per field, amplitudes in mV, durations in ms."""
    r_mm, t_mm = m["avr_r"] * 10.0, m["avr_t_pos"] * 10.0
    return [
        _steps(m["avl_q_ms"], Q_DURATION, F.lit(Q_DURATION_ABOVE)),
        F.when(m["avl_t_neg"] > 0.025, 3.0 + 23.0 * m["avl_t_neg"]).otherwise(_if((m["avl_t_pos"] <= 0.05) | (m["avl_t_pos"] > 0.30), 3.0)),
        F.when(r_mm < 5.0, -r_mm).otherwise(F.lit(0.0)),
        _steps(t_mm, T_AVR, -5.0 - 2.0 * (t_mm - 4.0)),
        _if(F.greatest(m["ii_qr"], m["avf_qr"]) >= 0.25, 12.0),
        _if(F.greatest(m["iii_q_ms"], m["avl_q_ms"]) >= 40.0, 5.0),
        _if(m["iii_t_neg"] > 0.10, 7.0),
        _if(m["v1_t_pos"] > 0.20, 5.0),
        _if((m["v2_r"] < 0.30) | (m["v2_r"] > 1.40), 5.0),
        _if(m["v2_t_neg"] >= 0.025, 5.0),
        _if(m["v3_qr"] > 0.05, 9.0),
        _if(m["v5_s"] < 0.20, 5.0),
    ]


def rule_score(m: dict[str, Column]) -> Column:
    return sum(items(m)[1:], items(m)[0])


def simplified_score(m: dict[str, Column]) -> Column:
    """Items 1, 5, 10 and 12."""
    x = items(m)
    return x[0] + x[4] + x[9] + x[11]


def category(score: Column) -> Column:
    out = F.when(score < CATEGORY[0][0], CATEGORY[0][1])
    for bound, name in CATEGORY[1:]:
        out = out.when(score < bound, name)
    return out.otherwise(CATEGORY_ABOVE)


def alignment_strength(rho: Column) -> Column:
    return F.when(F.abs(rho) < 0.30, "weak").when(F.abs(rho) < 0.70, "moderate").otherwise("strong")


def pad_or_crop(signal: Column, length: int, align: str = "start", mode: str = "constant") -> Column:
    n = F.size(signal)
    start = {"start": F.lit(1), "end": n - length + 1, "center": F.floor((n - length) / 2).cast("int") + 1}[align]
    fill = F.lit(0.0) if mode == "constant" else F.element_at(signal, -1)
    return F.when(n >= length, F.slice(signal, start, length)).otherwise(F.concat(signal, F.array_repeat(fill, F.lit(length) - n)))


def scale_units(signal: Column, source: str, target: str) -> Column:
    try:
        factor = UNITS[source.strip().lower()] / UNITS[target.strip().lower()]
    except KeyError as e:
        raise ValueError(f"unknown unit {e}") from None
    return F.transform(signal, lambda x: x * F.lit(factor))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a norm is under 1e-12."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(dot(a, b) / (na * nb))
