"""Pitch and tempo of sounds by numpy, in Arrow batches: what higher-order functions would do in quadratic time.

Pitch: difference functions by Fourier transform, their dips weighted by the share of thresholds
under which each is the first, and the likeliest path through the frames' dips.  Tempo: the
autocorrelation of onset strength, its strongest lag near a usual tempo, made exact at its multiples.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 65.40639132514966, 2093.004522404789
BLOCK = 512  # frames worked on at once
HELD_SAMPLES = 1 << 20  # samples of the sounds whose paths go on together


def _frames(x: np.ndarray, size: int, hop: int):
    """Blocks of frames around every ``hop``-th sample, zeros beyond both ends."""
    padded = np.concatenate([np.zeros(size // 2), x, np.zeros(size)])
    every = np.lib.stride_tricks.sliding_window_view(padded, size)[: len(x) : hop]
    for b in range(0, len(every), BLOCK):
        yield every[b : b + BLOCK]


def _below(v: np.ndarray) -> np.ndarray:
    """Share of thresholds below v, if thresholds have a beta distribution of 2 and 18."""
    v = np.clip(v, 0.0, 1.0)
    return 1 - (1 - v) ** 19 - 19 * v * (1 - v) ** 18


def _dips(frames: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame, period in samples and weight of every dip of the normalised difference that is lower than all before it."""
    width = frames.shape[1] - last
    size = 1 << (frames.shape[1] - 1).bit_length()  # lags up to ``last`` don't wrap
    products = np.fft.irfft(np.fft.rfft(frames, size) * np.conj(np.fft.rfft(frames[:, :width], size)), size)[:, : last + 1]
    power = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    own = power[:, width : width + last + 1] - power[:, : last + 1]
    diff = np.maximum(own[:, :1] + own - 2 * products, 0.0)
    run = np.cumsum(diff[:, 1:], axis=1)
    level = np.ones_like(diff)
    np.divide(diff[:, 1:] * np.arange(1, last + 1), run, out=level[:, 1:], where=run > 1e-9 * power[:, -1:])
    mid = level[:, first:last]
    low = np.where((mid < level[:, first - 1 : last - 1]) & (mid <= level[:, first + 1 : last + 1]) & (mid < 1), mid, np.inf)
    before = np.concatenate([np.full((len(frames), 1), np.inf), np.minimum.accumulate(low, axis=1)[:, :-1]], axis=1)
    row, at = np.nonzero(low < before)
    value = low[row, at]
    weight = _below(np.minimum(before[row, at], 1.0)) - _below(value)
    lowest = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    weight[lowest] += 0.01 * _below(value[lowest])
    a, b, c = level[row, at + first - 1], value, level[row, at + first + 1]
    bend = a - 2 * b + c
    shift = np.where(bend > 0, (a - c) / np.where(bend > 0, 2 * bend, 1.0), 0.0)
    return row, at + first + shift, weight


def pitch_track(x: np.ndarray, rate: int, **how) -> np.ndarray:
    """Hz at every hop of one sound, NaN where unvoiced; see ``pitch_tracks``."""
    return pitch_tracks([x], rate, **how)[0]


def pitch_tracks(sounds: Sequence[np.ndarray], rate: int, low: float = LOW, high: float = HIGH, frame: int | None = None, hop: int | None = None, steepest: float = 36.0, switch: float = 0.01) -> list[np.ndarray]:
    """Hz at every ``hop`` samples of each sound, NaN where unvoiced.

    ``frame`` is four of the longest periods and ``hop`` a quarter of it unless given.  A path may
    climb ``steepest`` octaves a second, and changes between voiced and unvoiced with probability
    ``switch``.  The paths of all sounds go on frame by frame together.  Memory grows with the
    dips of the sounds, work with their length.
    """
    first, last = max(1, int(rate / high)), max(2, int(np.ceil(rate / low)) + 1)
    frame = max(frame or 4 * last, 2 * last)
    hop = hop or max(1, frame // 4)
    sizes = np.array([-(-len(x) // hop) for x in sounds], int)
    order = np.argsort(-sizes, kind="stable")  # at every frame the sounds that go on come first
    tracks = [np.full(n, np.nan) for n in sizes]
    steps = int(sizes.max(initial=0))
    if not steps:
        return tracks
    active = np.searchsorted(-sizes[order], -np.arange(steps), side="left")
    starts = np.concatenate([[0], np.cumsum(active)])
    rows, periods, weights = [], [], []
    for rank, at in enumerate(order[: active[0]]):
        n = 0
        for block in _frames(np.asarray(sounds[at], float), frame, hop):
            r, p, w = _dips(block, first, last)
            rows.append(starts[n + r] + rank)
            periods.append(p)
            weights.append(w)
            n += len(block)
    row, weight = np.concatenate(rows), np.concatenate(weights)
    by = np.argsort(row, kind="stable")
    row, weight, found = row[by], weight[by], rate / np.concatenate(periods)[by]
    # a row for each frame of each sound, frame by frame, and a column for each dip
    counts = np.bincount(row, minlength=starts[-1])
    column = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    shape = (starts[-1], max(1, counts.max()))
    hz, seen = np.ones(shape), np.full(shape, -np.inf)
    hz[row, column], seen[row, column] = found, np.log(np.maximum(weight, 1e-12))
    octave, unheard = np.log2(hz), np.log(np.maximum(1 - np.bincount(row, weight, minlength=len(hz)), 1e-12))
    stay, leave, reach = np.log(1 - switch), np.log(switch), steepest * hop / rate
    # scores of the dips and of the unvoiced state, which comes last: of equal scores the first counts
    score, silent, places = np.full((active[0], 1), -np.inf), np.zeros(active[0]), np.zeros((active[0], 1))
    back, state = [], np.full(active[0], -1)
    for i in range(steps):
        n, own = active[i], slice(starts[i], starts[i + 1])
        width = max(1, counts[own].max())
        here = octave[own, :width]
        moved = score[:n, :, None] + (stay + np.log(np.maximum(1 - np.abs(places[:n, :, None] - here[:, None, :]) / reach, 1e-4)))
        best, most = moved.argmax(axis=1), moved.max(axis=1)
        top, up = score[:n].argmax(axis=1), score[:n].max(axis=1)
        risen, kept = silent[:n, None] + leave, silent[:n] + stay
        back.append((np.where(risen > most, -1, best).astype(np.int16), np.where(kept > up + leave, -1, top).astype(np.int16)))
        score, silent = np.maximum(most, risen) + seen[own, :width], np.maximum(up + leave, kept) + unheard[own]
        highest = np.maximum(score.max(axis=1), silent)
        score, silent, places = score - highest[:, None], silent - highest, here
        ends = slice(active[i + 1] if i + 1 < steps else 0, n)
        state[ends] = np.where(score[ends].max(axis=1) >= silent[ends], score[ends].argmax(axis=1), -1)
    out = np.full(starts[-1], np.nan)
    for i in range(steps - 1, -1, -1):
        n, (dips, quiet) = active[i], back[i]
        at, each = state[:n], np.arange(n)
        voiced, dip = at >= 0, np.maximum(at, 0)
        out[starts[i] : starts[i + 1]] = np.where(voiced, hz[starts[i] + each, dip], np.nan)
        state[:n] = np.where(voiced, dips[each, dip], quiet)
    for rank, at in enumerate(order[: active[0]]):
        tracks[at] = out[starts[: sizes[at]] + rank]
    return tracks


def onset_strength(x: np.ndarray, rate: int, step: float = 0.01) -> np.ndarray:
    """Mean rise of the log spectrum from one ``step`` of seconds to the next."""
    hop = max(1, round(rate * step))
    size = 4 * hop
    window, last, out = np.hanning(size), None, []
    top = max(float(np.max(np.abs(x), initial=0.0)), 1e-12)
    for block in _frames(np.asarray(x, float) / top, size, hop):
        level = np.log1p(1000 * np.abs(np.fft.rfft(block * window, axis=1)) / size)
        before = np.concatenate([level[:1] if last is None else last, level[:-1]])
        out.append(np.maximum(level - before, 0.0).mean(axis=1))
        last = level[-1:]
    return np.concatenate(out) if out else np.zeros(0)


def tempo_of(x: np.ndarray, rate: int, usual: float = 120.0, slowest: float = 30.0, fastest: float = 300.0, step: float = 0.01) -> float:
    """Beats a minute; ``usual`` for a sound without a repeated onset.

    Lags weigh by how many octaves they lie from the usual tempo, so beats far from it may count as half or twice as many.  The lag found is measured again
    at its doubles for as long as these are peaks inside the sound, which divides its error.
    """
    strength = onset_strength(x, rate, step)
    second = rate / max(1, round(rate * step))
    shortest, longest = max(1, int(60 * second / fastest)), min(int(60 * second / slowest), len(strength) - 2)
    if longest <= shortest or not np.any(strength > 0):
        return usual
    strength = strength - strength.mean()
    size = 1 << (2 * len(strength)).bit_length()
    ac = np.fft.irfft(np.abs(np.fft.rfft(strength, size)) ** 2, size)[: len(strength)]
    lags = np.arange(shortest, longest + 1)
    weighted = ac[lags] * np.exp(-0.5 * np.log2(60 * second / lags / usual) ** 2)
    if weighted.max() <= 1e-9 * ac[0]:
        return usual

    def peak(k: int) -> float:
        a, b, c = ac[k - 1], ac[k], ac[k + 1]
        bend = a - 2 * b + c
        return k + float(np.clip((a - c) / (2 * bend), -0.5, 0.5)) if bend < 0 else float(k)

    lag = peak(int(lags[weighted.argmax()]))
    many = 2
    while many * lag + 3 < len(strength):
        middle = round(many * lag)
        near = np.arange(max(1, middle - 2), min(middle + 3, len(ac) - 1))
        k = int(near[ac[near].argmax()])
        if k in (near[0], near[-1]) or ac[k] < 0.2 * ac[0]:
            break
        lag = peak(k) / many
        many *= 2
    return 60 * second / lag


def _sounds(arrays: pa.Array) -> Iterator[np.ndarray]:
    """Signals of an Arrow array; null, infinite and NaN samples are silence, as is a null signal."""
    for value in arrays:
        x = np.asarray(value.values.to_numpy(zero_copy_only=False) if value.is_valid else (), float)
        yield x if np.isfinite(x).all() else np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def _held(sounds: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sounds in order, together up to about ``HELD_SAMPLES``."""
    some, held = [], 0
    for x in sounds:
        some.append(x)
        held += len(x)
        if held >= HELD_SAMPLES:
            yield some
            some, held = [], 0
    if some:
        yield some


def tracked(sounds: DataFrame, samples: str, rate: int, pitch_only: bool = False, **pitch) -> DataFrame:
    """``sounds`` with ``pitch_track`` (array of Hz, null where unvoiced) and, unless ``pitch_only``, ``tempo``.

    A null or empty signal has no frames and the usual tempo; null, infinite and NaN samples count
    as silence.  ``pitch``: see ``pitch_track``.
    """
    _free(sounds, "pitch_track", *([] if pitch_only else ["tempo"]))

    def run(arrays: pa.Array) -> pa.Array:
        tracks = [pa.array(t, from_pandas=True) for some in _held(_sounds(arrays)) for t in pitch_tracks(some, rate, **pitch)]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in tracks])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(tracks) if tracks else pa.array([], pa.float64()))

    run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    heard = sounds.withColumn("pitch_track", F.arrow_udf(run, "array<double>")(F.col(samples).cast("array<double>")))
    return heard if pitch_only else timed(heard, samples, rate)


def timed(sounds: DataFrame, samples: str, rate: int) -> DataFrame:
    """``sounds`` with ``tempo`` alone, which costs a tenth of a pitch."""
    _free(sounds, "tempo")

    def run(arrays: pa.Array) -> pa.Array:
        return pa.array([tempo_of(x, rate) for x in _sounds(arrays)], pa.float64())

    run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return sounds.withColumn("tempo", F.arrow_udf(run, "double")(F.col(samples).cast("array<double>")))


def _free(sounds: DataFrame, *names: str) -> None:
    clash = set(names) & {c.lower() for c in sounds.columns}
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
