"""Twelve-lead recordings: lead order, resampling, filtering, median beats, lead features and scores.

A recording is an array of leads, each an array of samples in mV, with its lead names. Filters and beat detection
run in numpy over Arrow batches; order, features and scores are column expressions. A recording that can't be
scored keeps its row with a message in `error` and null results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import rulescore
from riskloom.session import ship

#: Lead orders.
CANONICAL = ("I", "II", "III", "aVR", "aVF", "aVL", "V1", "V2", "V3", "V4", "V5", "V6")
CLINICAL = ("I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6")
CABRERA = ("aVL", "I", "-aVR", "II", "aVF", "III", "V1", "V2", "V3", "V4", "V5", "V6")
#: Filters in Hz, times in seconds, amplitudes in mV.
HIGH_PASS = 0.67
QRS_BAND = (5.0, 18.0)
ENERGY_WINDOW, REFRACTORY, REFINE = 0.10, 0.28, 0.08
ENERGY_DEVIATIONS = 0.4
BEFORE, AFTER = 0.25, 0.45
QUIET, LEAST_Q, LEAST_R, NO_R_RATIO = 0.015, 0.02, 0.02, 10.0
#: Parts of a beat, from and up to seconds after the R peak.
SPANS = {"baseline": (-0.08, -0.03), "onset": (-0.08, 0.0), "r": (-0.02, 0.04), "s": (0.0, 0.08), "t": (0.06, 0.40)}
#: Lead and feature of each measurement of the rule score.
MEASURED = {
    "avl_q_ms": ("aVL", "q_ms"), "avl_t_pos": ("aVL", "t_pos"), "avl_t_neg": ("aVL", "t_neg"), "avr_r": ("-aVR", "r"), "avr_t_pos": ("-aVR", "t_pos"),
    "ii_qr": ("II", "qr"), "avf_qr": ("aVF", "qr"), "iii_q_ms": ("III", "q_ms"), "iii_t_neg": ("III", "t_neg"), "v1_t_pos": ("V1", "t_pos"),
    "v2_r": ("V2", "r"), "v2_t_neg": ("V2", "t_neg"), "v3_qr": ("V3", "qr"), "v5_s": ("V5", "s"),
}
#: Recordings filtered together.
BLOCK = 32


def lead_error(signal: Column, names: Column, target: Sequence[str] = CANONICAL) -> Column:
    """Why a recording can't be brought into the target order, or null."""
    given = F.when(F.array_contains(names, "aVR"), F.array_append(names, F.lit("-aVR"))).otherwise(names)
    missing = F.array_except(F.array(*map(F.lit, target)), given)
    return (
        F.when(signal.isNull() | names.isNull(), F.lit("no signal or no lead names"))
        .when(F.size(signal) != F.size(names), F.lit("signal and lead names differ in number"))
        .when(F.size(F.array_distinct(names)) != F.size(names), F.lit("repeated lead name"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing leads: "), F.array_join(missing, ", ")))
    )


def reorder(signal: Column, names: Column, target: Sequence[str] = CANONICAL) -> Column:
    """The leads in target order; -aVR is aVR negated where it isn't given. Null where lead_error has a message."""
    lead = lambda t: F.get(signal, F.array_position(names, t).cast("int") - 1)
    picked = [F.coalesce(lead(t), F.transform(lead("aVR"), lambda v: -v)) if t == "-aVR" else lead(t) for t in target]
    return F.when(lead_error(signal, names, target).isNull(), F.array(*picked))


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Fourier resampling along the last axis, to round(n * target / source) samples."""
    if min(source, target) <= 0:
        raise ValueError("sampling rates must be positive")
    n = x.shape[-1]
    m = n if source == target else int(round(n * (target / source)))
    if n == m:  # also of no samples at all
        return x.copy()
    if m < 1:
        raise ValueError("no samples are left at the target rate")
    kept = min(n, m) // 2 + 1
    spectrum = np.zeros((*x.shape[:-1], m // 2 + 1), complex)
    spectrum[..., :kept] = np.fft.rfft(x, axis=-1)[..., :kept]
    if min(n, m) % 2 == 0:  # the top frequency of the shorter one stands for two of the longer one
        spectrum[..., kept - 1] *= 2.0 if m < n else 0.5
    return np.fft.irfft(spectrum, m, axis=-1) * (m / n)


def _digital(analog: Sequence[float]) -> np.ndarray:
    """Coefficients after s = (z - 1) / (z + 1), of a polynomial in s with the highest power first."""
    order, out = len(analog) - 1, np.zeros(len(analog))
    for k, weight in enumerate(analog):
        term = np.ones(1)
        for factor in [[1.0, -1.0]] * (order - k) + [[1.0, 1.0]] * k:
            term = np.convolve(term, factor)
        out += weight * term
    return out


def high_pass(fs: int, cutoff: float = HIGH_PASS) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth high-pass."""
    w = np.tan(np.pi * cutoff / fs)
    b, a = _digital([1.0, 0.0, 0.0]), _digital([1.0, np.sqrt(2.0) * w, w * w])
    return b / a[0], a / a[0]


def band_pass(fs: int, band: tuple[float, float] = QRS_BAND) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth prototype as a band-pass, so four poles."""
    low, high = (np.tan(np.pi * f / fs) for f in band)
    width, middle = high - low, low * high
    b = _digital([0.0, 0.0, width * width, 0.0, 0.0])
    a = _digital([1.0, np.sqrt(2.0) * width, 2.0 * middle + width * width, np.sqrt(2.0) * width * middle, middle * middle])
    return b / a[0], a / a[0]


def _one_way(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter along the first axis, from the steady state of the first sample."""
    gain = b.sum() / a.sum()
    state = np.cumsum((b[1:] - a[1:] * gain)[::-1])[::-1][:, None] * x[0]
    out = np.empty_like(x)
    feed, back = b[1:, None], a[1:, None]
    for t in range(len(x)):
        y = b[0] * x[t] + state[0]
        out[t] = y
        moved = feed * x[t] - back * y
        moved[:-1] += state[1:]
        state = moved
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over rows of samples, ends extended by odd reflection."""
    pad = 3 * len(a)
    if x.shape[-1] <= pad:
        raise ValueError("too few samples to filter")
    x = np.ascontiguousarray(x.T)
    longer = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return _one_way(b, a, _one_way(b, a, longer)[::-1])[::-1][pad:-pad].T


def peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima (the middle of flat ones) of at least this height; of two closer than distance the higher stays."""
    runs = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    value, last = x[runs], np.append(runs[1:], len(x)) - 1
    top = np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])) + 1 if len(value) > 2 else np.zeros(0, int)
    top = top[value[top] >= height]
    at, stays = (runs[top] + last[top]) // 2, np.ones(len(top), bool)
    for k in np.argsort(value[top], kind="stable")[::-1]:
        if stays[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            stays &= ~near
    return at[stays]


def slope_energy(banded: np.ndarray, width: int) -> np.ndarray:
    """Squared steps of each row, averaged over `width` samples around each; beyond the ends there is none."""
    n = banded.shape[-1]
    steps = np.zeros_like(banded)
    steps[:, 1:] = banded[:, 1:] - banded[:, :-1]
    total = np.zeros((len(banded), n + 1))
    np.cumsum(steps * steps, axis=1, out=total[:, 1:])
    ends = np.minimum(np.arange(n) + (width - 1) // 2 + 1, n)
    return (total[:, ends] - total[:, np.maximum(np.arange(n) - width // 2, 0)]) / width


def r_peaks(leads: np.ndarray, fs: int, banded: np.ndarray | None = None) -> list[np.ndarray]:
    """Places of the R peaks in each row of leads, all of one length; none for under a second."""
    n = leads.shape[-1]
    if n < fs:
        return [np.zeros(0, int)] * len(leads)
    energy = slope_energy(zero_phase(*band_pass(fs), leads) if banded is None else banded, max(1, int(ENERGY_WINDOW * fs)))
    floors = energy.mean(1) + ENERGY_DEVIATIONS * energy.std(1)
    around = np.arange(-int(REFINE * fs), int(REFINE * fs))
    size, out = np.abs(leads), []
    for row, height, own in zip(energy, floors, size, strict=True):
        # every peak moves to the largest deflection around it
        grid = peaks(row, height, max(1, int(REFRACTORY * fs)))[:, None] + around
        inside = (grid >= 0) & (grid < n)
        best = np.where(inside, own[np.clip(grid, 0, n - 1)], -1.0).argmax(1) if grid.size else np.zeros(0, int)
        out.append(grid[np.arange(len(grid)), best] if grid.size else np.zeros(0, int))
    return out


def median_beat(leads: np.ndarray, at: np.ndarray, fs: int) -> np.ndarray:
    """Median over the complete beats, per lead and sample."""
    grid = at[:, None] + np.arange(-int(BEFORE * fs), int(AFTER * fs))
    grid = grid[(grid[:, 0] >= 0) & (grid[:, -1] < leads.shape[1])]
    if not len(grid):
        raise ValueError("no complete beat")
    return np.median(leads[:, grid], axis=1)


def _recordings(column: pa.ListArray) -> list[np.ndarray | None]:
    """Each recording as leads by samples; None where it is null or its leads differ in length."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    leads = column.flatten()
    lengths = leads.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values, out, lead, sample = leads.flatten().to_numpy(zero_copy_only=False), [], 0, 0
    for n in counts:
        mine = lengths[lead : lead + n]
        total = int(mine.sum())
        same = n > 0 and (mine == mine[0]).all()
        out.append(values[sample : sample + total].astype(float).reshape(n, -1) if same else None)
        lead, sample = lead + n, sample + total
    return out


def _beats(found: list[np.ndarray | None], fs: int, primary: int, second: int) -> list[tuple[np.ndarray | None, str | None]]:
    out: list[tuple[np.ndarray | None, str | None]] = [(None, "no signal, or leads of several lengths")] * len(found)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for k, x in enumerate(found):
        if x is None:
            continue
        if not np.isfinite(x).all():
            out[k] = (None, "signal holds null, NaN or infinite values")
        elif x.shape[1] < fs:
            out[k] = (None, f"too short: {x.shape[1]} samples at {fs} Hz")
        elif len(x) <= max(primary, second):
            out[k] = (None, "too few leads")
        else:
            alike[x.shape].append(k)
    for (n_leads, n), members in alike.items():
        for at in range(0, len(members), BLOCK):
            block = members[at : at + BLOCK]
            try:
                clean = zero_phase(*high_pass(fs), np.concatenate([found[k] for k in block])).reshape(len(block), n_leads, n)
                banded = zero_phase(*band_pass(fs), clean[:, primary])
            except ValueError as e:
                out = [(None, str(e)) if k in block else o for k, o in enumerate(out)]
                continue
            found_r = r_peaks(clean[:, primary], fs, banded)
            few = [i for i, r in enumerate(found_r) if len(r) < 2]
            if few:
                found_r = [dict(zip(few, r_peaks(clean[few][:, second], fs), strict=True)).get(i, r) for i, r in enumerate(found_r)]
            for k, x, r in zip(block, clean, found_r, strict=True):
                try:
                    if len(r) < 2:
                        raise ValueError(f"too few R peaks: {len(r)}")
                    out[k] = (median_beat(x, r, fs), None)
                except ValueError as e:
                    out[k] = (None, str(e))
    return out


def median_beats(df: DataFrame, signal: str, fs: int, keep: Sequence[str], primary: int, second: int) -> DataFrame:
    """(keep, beat, error): the median beat of each recording, its R peak at sample int(BEFORE * fs).

    R peaks come from the lead at place `primary`, or `second` where that has under two.
    """
    ship(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("beat", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4 * BLOCK):
                batch = whole.slice(at, 4 * BLOCK)
                done = _beats(_recordings(batch.column(signal)), fs, primary, second)
                beats = pa.array([None if x is None else list(x) for x, _ in done], pa.list_(pa.list_(pa.float64())))
                columns = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, beats, pa.array([e for _, e in done], pa.string())], [*keep, "beat", "error"])

    return df.select(*keep, signal).mapInArrow(run, schema)


def lead_features(beats: Column, fs: int) -> Column:
    """Per lead of a median beat: q_ms, q, r, s, t_pos, t_neg, qr. Staged, so that no part is worked out twice."""
    r = int(BEFORE * fs)
    n = r + int(AFTER * fs)
    # first sample and length of each part, at least one sample within the beat
    parts = {}
    for name, span in SPANS.items():
        start, stop = (min(max(r + int(np.sign(x)) * int(abs(x) * fs), 0), n) for x in span)
        start = min(start, n - 1)
        parts[name] = (start, max(1, stop - start))
    of = lambda z, name: F.slice(z, parts[name][0] + 1, parts[name][1])
    above = lambda z, name: F.greatest(F.lit(0.0), F.array_max(of(z, name)))
    below = lambda z, name: F.greatest(F.lit(0.0), -F.array_min(of(z, name)))
    first, width = parts["onset"][0], parts["baseline"][1]

    def level(x: Column) -> Column:
        return F.transform(F.array(F.sort_array(of(x, "baseline"))), lambda s: (F.get(s, (width - 1) // 2) + F.get(s, width // 2)) / 2.0)[0]

    def shapes(z: Column) -> Column:
        # the last quiet sample after the first of the search, up to the R peak
        quiet = F.transform(F.slice(z, first + 2, max(r - first, 1)), lambda v, k: F.when(F.abs(v) < QUIET, k + first + 1))
        onset = F.coalesce(F.array_max(quiet), F.lit(first))
        return F.struct(z.alias("z"), onset.alias("onset"), above(z, "r").alias("r"), below(z, "s").alias("s"), above(z, "t").alias("t_pos"), below(z, "t").alias("t_neg"))

    def with_q(f: Column) -> Column:
        lowest = F.when(f["onset"] < r, F.array_min(F.slice(f["z"], f["onset"] + 1, F.greatest(F.lit(r) - f["onset"], F.lit(1)))))
        return F.struct(lowest.alias("low"), *(f[c].alias(c) for c in ("onset", "r", "s", "t_pos", "t_neg")))

    def finish(f: Column) -> Column:
        deep = f["low"] < -LEAST_Q
        q = F.when(deep, -f["low"]).otherwise(0.0)
        ratio = F.when(f["r"] > LEAST_R, q / f["r"]).when(q > LEAST_Q, NO_R_RATIO).otherwise(0.0)
        length = F.when(deep, (F.lit(r) - f["onset"]) / float(fs) * 1000.0).otherwise(0.0)
        return F.struct(length.alias("q_ms"), q.alias("q"), f["r"].alias("r"), f["s"].alias("s"), f["t_pos"].alias("t_pos"), f["t_neg"].alias("t_neg"), ratio.alias("qr"))

    levelled = F.transform(beats, lambda x: F.struct(x.alias("x"), level(x).alias("m")))
    zeroed = F.transform(levelled, lambda p: F.transform(p["x"], lambda v: v - p["m"]))
    return F.transform(F.transform(F.transform(zeroed, shapes), with_q), finish)


def score_recordings(df: DataFrame, fs: int, signal: str = "signal", names: str = "leads", keep: Sequence[str] = ()) -> DataFrame:
    """The rule score of each recording: keep, the measurements, total, simplified, category, cornell, sokolow_lyon, is_valid, error.

    cornell is R in aVL and S in V3, sokolow_lyon S in V1 and the larger R of V5 and V6, in mV.
    """
    ordered = df.select(*keep, reorder(F.col(signal), F.col(names)).alias("_ordered"), lead_error(F.col(signal), F.col(names)).alias("_lead_error"))
    beats = median_beats(ordered, "_ordered", fs, [*keep, "_lead_error"], CANONICAL.index("II"), CANONICAL.index("V5"))
    place = {lead: k for k, lead in enumerate((*CANONICAL, "-aVR"))}
    both = F.concat("beat", F.array(F.transform(F.get("beat", place["aVR"]), lambda v: -v)))
    found = beats.withColumn("_f", F.when(F.col("beat").isNotNull(), lead_features(both, fs)))
    of = lambda lead, feature: F.get("_f", place[lead])[feature]
    error = F.coalesce("_lead_error", "error")
    found = found.select(
        *keep, *(of(*MEASURED[f]).alias(f) for f in rulescore.FIELDS), (of("aVL", "r") + of("V3", "s")).alias("cornell"),
        (of("V1", "s") + F.greatest(of("V5", "r"), of("V6", "r"))).alias("sokolow_lyon"), error.isNull().alias("is_valid"), error.alias("error"),
    )
    m = {f: F.col(f) for f in rulescore.FIELDS}
    whole = lambda c: F.when(F.col("is_valid"), c)
    total = whole(rulescore.rule_score(m))
    return found.withColumns({"total": total, "simplified": whole(rulescore.simplified_score(m)), "category": whole(rulescore.category(rulescore.rule_score(m)))})
