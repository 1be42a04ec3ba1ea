"""Numpy kernels of what array expressions can't say or say slowly: pivots, wavelets, warping, matrix profiles, movements."""

from __future__ import annotations

from collections import deque

import numpy as np

from tidelode.schema import EPS, MOVEMENT, DataError

# Scaling filters of the orthogonal wavelets, as published (reconstruction low-pass).
FILTERS = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "db1": [0.7071067811865476, 0.7071067811865476],
    "db2": [0.48296291314469025, 0.836516303737469, 0.22414386804185735, -0.12940952255092145],
    "coif1": [-0.07273261951252645, 0.3378976624574818, 0.8525720202116004, 0.3848648468648578, -0.07273261951252645, -0.015655728135791993],
    "sym5": [0.019538882735286728, -0.021101834024758855, -0.17532808990845047, 0.01660210576452232, 0.6339789634582119, 0.7234076904024206, 0.1993975339773936, -0.039134249302383094, 0.029519490925774643, 0.027333068345077982],
}


def _filters(name: str) -> tuple[np.ndarray, np.ndarray]:
    if name not in FILTERS:
        raise DataError(f"no such wavelet: {name}")
    rec = np.array(FILTERS[name])
    low = rec[::-1]
    high = rec * (-1.0) ** np.arange(1, len(rec) + 1)
    return low, high


def dwt(x: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """One level of rows x with half-point symmetric borders: (approximation, detail)."""
    n, width = x.shape[1], len(FILTERS[name])
    at = np.arange(-(width - 1), n + width - 1) % (2 * n)
    padded = x[:, np.where(at < n, at, 2 * n - 1 - at)]
    both = []
    views = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)
    for f in _filters(name):
        both.append((views @ f[::-1])[:, 1::2])
    return both[0], both[1]


def wavedec(x: np.ndarray, name: str) -> np.ndarray:
    """[approximation, detail of the coarsest level, ..., of the finest], as deep as the filter allows."""
    n, width = x.shape[1], len(FILTERS.get(name, ())) or len(_filters(name)[0])
    levels = int(np.floor(np.log2(n / (width - 1)))) if n >= width - 1 and n > 0 else 0
    details = []
    for _ in range(max(levels, 0)):
        x, d = dwt(x, name)
        details.append(d)
    return np.concatenate([x, *details[::-1]], axis=1)


def top(x: np.ndarray, n: int) -> np.ndarray:
    """Of each row the n values of largest magnitude (the first, of equal ones), in their order."""
    order = np.argsort(-np.round(np.abs(x), 9), axis=1, kind="stable")[:, :n]
    return np.take_along_axis(x, np.sort(order, axis=1), 1)


def _chord_distance(x: np.ndarray, a: np.ndarray, b: np.ndarray, measure: int) -> np.ndarray:
    """Distance of every place from the chord between its bracketing points a and b (places, as x's shape)."""
    i = np.arange(x.shape[1], dtype=float)[None, :]
    xa, xb = np.take_along_axis(x, a, 1), np.take_along_axis(x, b, 1)
    if measure == 1:
        return np.hypot(a - i, xa - x) + np.hypot(b - i, xb - x)
    slope = (xb - xa) / np.maximum(b - a, 1)
    off = np.abs(slope * (i - a) + xa - x)
    return off / np.sqrt(slope**2 + 1) if measure == 2 else off


def important_points(x: np.ndarray, n: int, measure: int) -> np.ndarray:
    """Places of n important points of each row: the ends, then always the farthest inner point."""
    rows, size = x.shape
    if size < n or n < 2:
        raise DataError(f"{n} points of a window of {size}")
    chosen = np.zeros((rows, size), bool)
    chosen[:, [0, size - 1]] = True
    place = np.broadcast_to(np.arange(size), (rows, size))
    for _ in range(n - 2):
        a = np.maximum.accumulate(np.where(chosen, place, 0), axis=1)
        b = np.minimum.accumulate(np.where(chosen, place, size - 1)[:, ::-1], axis=1)[:, ::-1]
        d = np.where(chosen, -1.0, _chord_distance(x, a, b, measure))
        chosen[np.arange(rows), np.argmax(np.round(d, 12), axis=1)] = True
    return np.nonzero(chosen)[1].reshape(rows, n)


def pivot_places(x: np.ndarray, n: int, min_movement: float) -> np.ndarray:
    """Places of up to n pivots of each row, ascending, -1 for those that aren't there.

    The ends, then the largest vertical deviation from the chord of a segment that moves enough; deviations are
    compared to nine places of the row's range, the first of equal ones counts. All rows at once: a
    place's segment is known by running maxima and minima over the pivots so far."""
    rows, size = x.shape
    chosen = np.zeros((rows, size), bool)
    chosen[:, [0, size - 1]] = True
    place = np.broadcast_to(np.arange(size), (rows, size))
    span = (x.max(1) - x.min(1))[:, None]
    for _ in range(n - 2 if size > 2 else 0):
        a = np.maximum.accumulate(np.where(chosen, place, 0), axis=1)
        b = np.minimum.accumulate(np.where(chosen, place, size - 1)[:, ::-1], axis=1)[:, ::-1]
        moves = np.abs(np.take_along_axis(x, b, 1) - np.take_along_axis(x, a, 1)) >= span * min_movement
        d = np.round(_chord_distance(x, a, b, 3) / np.where(span > 0, span, 1), 9)
        d = np.where(chosen | ~moves, 0.0, d)
        best = np.argmax(d, axis=1)
        more = np.flatnonzero(d[np.arange(rows), best] > 0)
        if not len(more):
            break
        chosen[more, best[more]] = True
    out = np.full((rows, max(n, 1 + (size > 1))), -1)
    row, at = np.nonzero(chosen)
    out[row, np.cumsum(chosen, axis=1)[row, at] - 1] = at
    return out


def pivots(x: np.ndarray, n: int, min_movement: float) -> list[int]:
    """Those of one row."""
    found = pivot_places(np.asarray(x, float)[None], n, min_movement)[0]
    return found[found >= 0].tolist()


def _segment_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] of each row and segment, by running sums."""
    sums = np.concatenate([np.zeros((len(values), 1)), np.cumsum(values, axis=1)], axis=1)
    return np.take_along_axis(sums, end, 1) - np.take_along_axis(sums, start, 1)


def segments(x: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    """Of each row's segments between neighbouring pivots, nan where there is none: rise, run, angle, speed,
    wild (deviation of the steps), slope (of the least-squares line); and start and end places."""
    there = places[:, 1:] >= 0
    start, end = np.where(there, places[:, :-1], 0), np.where(there, places[:, 1:], 0)
    run = np.where(there, end - start, 1).astype(float)
    rise = np.take_along_axis(x, end, 1) - np.take_along_axis(x, start, 1)
    step = np.diff(x, axis=1)
    owner = np.cumsum((places[:, None, :] == np.arange(x.shape[1] - 1)[None, :, None]).any(2), axis=1) - 1  # of each step
    off = (step - np.take_along_axis(rise / run, np.minimum(owner, there.shape[1] - 1), 1)) ** 2 if there.shape[1] else step
    wild = np.sqrt(_segment_sums(off, start, end) / run)
    centered = x - x.mean(1, keepdims=True)
    i = np.arange(x.shape[1], dtype=float)
    n, middle = run + 1, (start + end) / 2
    cross = _segment_sums(centered * i, start, end + 1) - middle * _segment_sums(centered, start, end + 1)
    slope = cross / (n * (n * n - 1) / 12)
    out = {"rise": rise, "run": run, "angle": np.arctan2(rise, run) / np.pi, "speed": rise / run, "wild": wild, "slope": slope}
    return {k: np.where(there, v, np.nan) for k, v in out.items()} | {"start": start, "end": end}


def movement_rows(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Raw features of each row's segments, eight for each, nan where there is none."""
    s = segments(x, places)
    before = np.concatenate([s["speed"][:, :1], s["speed"][:, :-1]], axis=1)
    size = np.nanmean(np.abs(s["rise"]), axis=1, keepdims=True) if s["rise"].size else s["rise"]
    return np.stack([s["rise"], s["run"], s["angle"], s["speed"], s["speed"] - before, s["rise"] / (size + EPS), s["wild"], s["slope"]], axis=2)


def movements(x: np.ndarray, places: list[int]) -> np.ndarray:
    """Those of one row."""
    if len(places) < 2:
        return np.zeros((0, len(MOVEMENT)))
    return movement_rows(np.asarray(x, float)[None], np.asarray(places)[None])[0]


def moving_trends(x: np.ndarray, width: int) -> np.ndarray:
    """How far each value of each row is from the mean of the width values that end there, in deviations, within -1 and 1."""
    if x.shape[1] < width:
        return np.zeros(x.shape)
    average = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).mean(2)
    average = np.concatenate([np.repeat(average[:, :1], width - 1, axis=1), average], axis=1)
    return np.clip((x - average) / (x.std(1, keepdims=True) + EPS), -1, 1)


STATS = ("price_std", "price_mean", "speed_std", "speed_mean", "volatility_std", "volatility_mean")
#: What the statistics are before the first window.
START = (1.0, 0.0, 1.0, 0.0, 1.0, 0.0)


def _history_stats(h: np.ndarray, window: int) -> np.ndarray:
    """The statistics of rows of history."""
    w, every = min(window, h.shape[1]), np.diff(h, axis=1) if h.shape[1] > 1 else np.zeros((len(h), 1))
    change = every[:, -(w - 1) :] if every.shape[1] > w > 1 else every
    i = np.arange(1, change.shape[1] + 1)
    size = np.abs(change)
    return np.column_stack([every.std(1) + EPS, h[:, -w:].mean(1), (change / i).std(1) + EPS, size.mean(1) / i.mean(), size.std(1) + EPS, size.mean(1)])


def window_stats(x: np.ndarray, lookback: int, window: int) -> np.ndarray:
    """Of rows that are windows in order: the statistics of the values of the lookback - 1 windows before each (of its own, for the first)."""
    rows, size = x.shape
    past = max(lookback - 1, 1)
    out = np.empty((rows, len(STATS)))
    for r in range(min(past, rows)):
        out[r] = _history_stats((x[:r] if r else x[:1]).reshape(1, -1), window)[0]
    flat = np.ascontiguousarray(x).reshape(-1)
    for a in range(past, rows, 1024):  # the views are made into arrays
        b = min(a + 1024, rows)
        views = np.lib.stride_tricks.sliding_window_view(flat[(a - past) * size : (b - 1) * size], past * size)[::size]
        out[a:b] = _history_stats(views, window)
    return out


def fade(new: np.ndarray, alpha: float, block: int = 64) -> np.ndarray:
    """Exponential means of rows in order from 0: out[t] = (1 - alpha) out[t - 1] + alpha new[t], a block of rows at a time."""
    i = np.arange(block)
    weights = np.where(i[:, None] >= i[None, :], alpha * (1 - alpha) ** np.maximum(i[:, None] - i[None, :], 0), 0.0)
    carried = ((1 - alpha) ** (i + 1))[:, None]
    out, last = np.empty(new.shape), np.zeros(new.shape[1])
    for a in range(0, len(new), block):
        part = new[a : a + block]
        k = len(part)
        out[a : a + k] = weights[:k, :k] @ part + carried[:k] * last
        last = out[a + k - 1]
    return out


def raw_movements(x: np.ndarray, n: int, min_movement: float, trend_window: int, window: int) -> dict[str, np.ndarray]:
    """Of rows that are windows in order: what n segments of each have before statistics of earlier windows normalise them.

    The speed before a window's first is the last one of the window before; magnitudes compare with the mean last rise of
    up to so many windows before."""
    places = pivot_places(x, n + 1, min_movement)
    s = segments(x, places)
    count = (places[:, 1:] >= 0).sum(1)
    last = np.maximum(count - 1, 0)[:, None]
    speed, rise = s["speed"], np.nan_to_num(np.take_along_axis(s["rise"], last, 1)[:, 0])
    ends = np.take_along_axis(speed, last, 1)
    before = np.concatenate([np.concatenate([speed[:1, :1], ends[:-1]]), speed[:, :-1]], axis=1)
    sums = np.concatenate(([0.0], np.cumsum(np.abs(rise))))
    at = np.arange(len(x))
    first = np.maximum(at - window, 0)
    scale = (sums[at] - sums[first]) / np.maximum(at - first, 1) + EPS
    size = np.where((at > 0)[:, None], s["rise"] / scale[:, None], np.where(np.isnan(speed), np.nan, 1.0))
    trend = _segment_sums(moving_trends(x, trend_window), s["start"], s["end"] + 1) / (s["run"] + 1)
    return {"vertical": s["rise"], "horizontal": s["run"], "angle": s["angle"], "speed": speed, "acceleration": speed - before, "magnitude": size, "volatility": s["wild"], "trend": trend}


class MovementState:
    """Movement vectors of one series' windows in order, one at a time, as they come in a stream.

    Speeds and magnitudes are compared raw with raw, and one pivot more than segments is looked for, so
    that every segment asked for is filled where the window allows."""

    def __init__(self, n: int, features=None, normalize_window=100, lookback=10, min_movement=0.001, trend_window=20, alpha=0.1):
        self.names = tuple(features or MOVEMENT)
        if unknown := [f for f in self.names if f not in MOVEMENT]:
            raise DataError(f"no such features: {unknown}")
        if n % len(self.names):
            raise DataError("n must be a multiple of the number of features")
        if not (0 < min_movement < 1 and 0 < alpha < 1):
            raise DataError("min_movement and alpha must be between 0 and 1")
        self.n, self.segments = n, n // len(self.names)
        self.normalize_window, self.min_movement, self.trend_window, self.alpha = normalize_window, min_movement, trend_window, alpha
        self.windows: deque[np.ndarray] = deque(maxlen=max(lookback - 1, 1))
        self.recent: deque[float] = deque(maxlen=normalize_window)  # the last rise of each window
        self.stats = dict(zip(STATS, START, strict=True))
        self.last_speed: float | None = None

    def step(self, x: np.ndarray) -> list[float]:
        history = np.concatenate(self.windows) if self.windows else x
        new = _history_stats(history[None], self.normalize_window)[0]
        self.stats = {k: (1 - self.alpha) * self.stats[k] + self.alpha * float(v) for k, v in zip(STATS, new, strict=True)}
        self.windows.append(x)
        s = self.stats
        every = {k: v[0] for k, v in raw_movements(x[None], self.segments, self.min_movement, self.trend_window, self.normalize_window).items()}
        rise, speed = every["vertical"], every["speed"]
        there = ~np.isnan(rise)
        if self.last_speed is not None:
            every["acceleration"] = np.concatenate(([speed[0] - self.last_speed], every["acceleration"][1:]))
        if self.recent:
            every["magnitude"] = rise / (np.mean(np.abs(self.recent)) + EPS)
        every["vertical"] = (rise - s["price_mean"]) / s["price_std"]
        every["speed"] = (speed - s["speed_mean"]) / s["speed_std"]
        every["volatility"] = every["volatility"] / s["volatility_std"]
        if there.any():
            self.last_speed = float(speed[there][-1])
        self.recent.append(float(rise[there][-1]) if there.any() else 0.0)
        return [float(v) for v in np.nan_to_num(np.column_stack([every[f] for f in self.names])).ravel()]


def dtw_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic time warping distance of each row of a and the same row of b: root of the least sum of squares.

    Cells of an anti-diagonal depend on the two before it alone, so three of them are kept, for all rows at once."""
    (rows, n), m = a.shape, b.shape[1]
    two, one = np.full((rows, n + 1), np.inf), np.full((rows, n + 1), np.inf)
    two[:, 0] = 0
    for d in range(2, n + m + 1):  # the cells (i, d - i), counted from 1
        low, high = max(1, d - m), min(n, d - 1)
        now = np.full((rows, n + 1), np.inf)
        cost = (a[:, low - 1 : high] - b[:, d - high - 1 : d - low][:, ::-1]) ** 2
        now[:, low : high + 1] = cost + np.minimum(np.minimum(one[:, low - 1 : high], one[:, low : high + 1]), two[:, low - 1 : high])
        two, one = one, now
    return np.sqrt(one[:, n])


def _banded(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, path: bool) -> tuple[float, np.ndarray]:
    """Warping of one pair where place i of a meets only places low[i] to high[i] of b, both ascending: squared distance, and if asked the path."""
    n, m = len(a), len(b)
    i = np.arange(n)
    first, last = i + low, i + high  # the anti-diagonals that each place of a is on
    two, one = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    two[0] = 0
    turns: list[tuple[int, np.ndarray]] = []
    for d in range(n + m - 1):
        p, q = int(np.searchsorted(last, d)), int(np.searchsorted(first, d, side="right"))
        now = np.full(n + 1, np.inf)
        if p < q:
            ways = np.stack([two[p:q], one[p:q], one[p + 1 : q + 1]])  # from both before, from a's before, from b's before
            turn = ways.argmin(0)
            now[p + 1 : q + 1] = (a[p:q] - b[d - i[p:q]]) ** 2 + np.take_along_axis(ways, turn[None], 0)[0]
        if path:
            turns.append((p, turn.astype(np.int8) if p < q else np.zeros(0, np.int8)))
        two, one = one, now
        if d == 0:
            two = np.full(n + 1, np.inf)
    steps = []
    if path:
        x, y = n - 1, m - 1
        while x >= 0 and y >= 0:
            steps.append((x, y))
            p, turn = turns[x + y]
            t = turn[x - p]
            x, y = x - (t != 2), y - (t != 1)
    return float(one[n]), np.array(steps[::-1])


#: Pairs whose product of lengths is no more are warped whole to begin with.
WHOLE_CELLS = 1 << 16


def _halved(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x[-1:]])[: len(x) + len(x) % 2].reshape(-1, 2).mean(1)


def _warp(a: np.ndarray, b: np.ndarray, radius: int, path: bool) -> tuple[float, np.ndarray]:
    n, m = len(a), len(b)
    if n * m <= WHOLE_CELLS or min(n, m) <= 2 * radius + 2 or radius >= max(n, m):
        return _banded(a, b, np.zeros(n, int), np.full(n, m - 1), path)
    _, coarse = _warp(_halved(a), _halved(b), radius, True)
    low, high = np.full(n, m - 1), np.zeros(n, int)
    for k in (0, 1):
        at = np.minimum(2 * coarse[:, 0] + k, n - 1)
        np.minimum.at(low, at, 2 * coarse[:, 1])
        np.maximum.at(high, at, 2 * coarse[:, 1] + 1)
    wide = lambda v, f: f.reduce(np.lib.stride_tricks.sliding_window_view(np.pad(v, radius, mode="edge"), 2 * radius + 1), axis=1)
    low = np.maximum(wide(low, np.minimum) - radius, 0)
    high = np.minimum(wide(high, np.maximum) + radius, m - 1)
    low[0], high[-1] = 0, m - 1
    return _banded(a, b, np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high), path)


def dtw_near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """The same within a window around the path of series of half the length, radius places to each side; exact if that is everything.

    Time and memory grow with length times radius, not with the product of lengths."""
    return np.sqrt([_warp(x, y, radius, False)[0] for x, y in zip(a, b, strict=True)])


def dtw(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every row of a to every row of b."""
    return np.stack([dtw_pairs(a, np.broadcast_to(y, (len(a), len(y)))) for y in b], axis=1)


def profile_width(n: int) -> int:
    return max(4, n // 4)


def matrix_profile(x: np.ndarray, width: int | None = None) -> np.ndarray:
    """Of each row: every subsequence's distance to the nearest one that starts width places away or more."""
    w = width or profile_width(x.shape[1])
    sub = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)
    m = sub.shape[1]
    if m <= w:
        raise DataError(f"a series of {x.shape[1]} is too short for subsequences of {w}")
    square = (sub**2).sum(2)
    d = square[:, :, None] + square[:, None, :] - 2 * sub @ sub.transpose(0, 2, 1)
    i = np.arange(m)
    d[:, np.abs(i[:, None] - i[None, :]) < w] = np.inf
    return np.sqrt(np.maximum(d.min(2), 0))


def sliding_profile(x: np.ndarray, width: int | None = None) -> np.ndarray:
    """The same in memory of a few rows, whatever their length.

    The products of the first subsequence with all others come from one Fourier transform. Along a diagonal, places
    a fixed lag apart, a product is the one before less what leaves and plus what enters: a running sum. Means are
    taken out first, so that sums stay small. Each place's nearest is found diagonal by diagonal, and its
    distance taken from the values themselves."""
    rows, n = x.shape
    w = width or profile_width(n)
    m = n - w + 1
    if m <= w:
        raise DataError(f"a series of {n} is too short for subsequences of {w}")
    c = x - x.mean(1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    first = np.fft.irfft(np.fft.rfft(c, size, axis=1) * np.conj(np.fft.rfft(c[:, :w], size, axis=1)), size, axis=1)[:, :m]
    sums = np.concatenate([np.zeros((rows, 1)), np.cumsum(c * c, axis=1)], axis=1)
    square = sums[:, w:] - sums[:, :-w]
    best, where = np.full((rows, m), np.inf), np.zeros((rows, m), int)
    for lag in range(w, m):
        k = m - lag
        change = np.concatenate([first[:, lag : lag + 1], c[:, w : n - lag] * c[:, w + lag :] - c[:, : k - 1] * c[:, lag : m - 1]], axis=1)
        d = square[:, :k] + square[:, lag:] - 2 * np.cumsum(change, axis=1)
        for mine, other in ((slice(0, k), np.arange(lag, m)), (slice(lag, m), np.arange(k))):
            nearer = d < best[:, mine]
            best[:, mine] = np.where(nearer, d, best[:, mine])
            where[:, mine] = np.where(nearer, other, where[:, mine])
    out = np.empty((rows, m))
    subs = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)
    each = max(1, (1 << 20) // w)
    for r in range(rows):
        for a in range(0, m, each):
            out[r, a : a + each] = np.sqrt(((subs[r, a : a + each] - subs[r, where[r, a : a + each]]) ** 2).sum(1))
    return out


#: Subsequences in a series from which the profile is made by running sums.
SLIDING_FROM = 128


def profile(x: np.ndarray, width: int | None = None) -> np.ndarray:
    """Of each row, by what costs less."""
    return (sliding_profile if x.shape[1] - (width or profile_width(x.shape[1])) >= SLIDING_FROM else matrix_profile)(x, width)


def mpdist(a: np.ndarray, b: np.ndarray, width: int | None = None) -> np.ndarray:
    """Mean absolute difference of the matrix profiles of each row of a and each row of b."""
    return np.abs(profile(a, width)[:, None] - profile(b, width)[None]).mean(2)


def mpdist_pairs(a: np.ndarray, b: np.ndarray, width: int | None = None, of=profile) -> np.ndarray:
    """The same for each row of a and the same row of b."""
    return np.abs(of(a, width) - of(b, width)).mean(1)
