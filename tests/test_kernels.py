"""Kernels and the t distribution against definitions and known values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from tidelode.functions import kernels, student
from tidelode.schema import DataError, seconds

values = st.floats(-1e3, 1e3, allow_nan=False)
series = hnp.arrays(float, st.integers(8, 40), elements=values)


@settings(max_examples=60, deadline=None)
@given(series, st.integers(2, 6), st.sampled_from([1, 2, 3]))
def test_important_points(x, n, measure):
    p = kernels.important_points(x[None], n, measure)[0]
    assert len(p) == n and p[0] == 0 and p[-1] == len(x) - 1 and (np.diff(p) > 0).all()


def test_important_points_known():
    x = np.array([[0.0, 0, 5, 0, 0], [1, 2, 3, 9, 5]])
    for measure in (1, 2, 3):
        p = kernels.important_points(x, 3, measure)
        assert np.take_along_axis(x, p, 1)[0].tolist() == [0, 5, 0]
    with pytest.raises(DataError):
        kernels.important_points(x, 6, 1)


@pytest.mark.parametrize("name", kernels.FILTERS)
def test_filters_are_orthonormal(name):
    f = np.array(kernels.FILTERS[name])
    assert f.sum() == pytest.approx(math.sqrt(2), abs=1e-9)
    for k in range(0, len(f), 2):
        assert (f[k:] * f[: len(f) - k]).sum() == pytest.approx(float(k == 0), abs=1e-9)
    low, high = kernels._filters(name)
    assert high.sum() == pytest.approx(0, abs=1e-9)


@settings(max_examples=40, deadline=None)
@given(hnp.arrays(float, (1, 16), elements=values))
def test_haar_keeps_energy(x):
    assert (kernels.wavedec(x, "haar") ** 2).sum() == pytest.approx((x**2).sum(), rel=1e-9, abs=1e-6)


def test_wavelet_lengths_and_constants():
    for name, width in (("db2", 4), ("coif1", 6), ("sym5", 10)):
        a, d = kernels.dwt(np.ones((1, 25)), name)
        assert a.shape[1] == d.shape[1] == (25 + width - 1) // 2
        assert np.allclose(d, 0, atol=1e-9) and np.allclose(a, math.sqrt(2))
    assert kernels.wavedec(np.ones((2, 3)), "sym5").shape == (2, 3)
    with pytest.raises(DataError):
        kernels.wavedec(np.ones((1, 8)), "db9")


@settings(max_examples=40, deadline=None)
@given(hnp.arrays(float, (2, 9), elements=values))
def test_dtw(x):
    a, b = x[:1], x[1:]
    d = kernels.dtw(a, b)[0, 0]
    assert kernels.dtw(a, a)[0, 0] == 0
    assert d == pytest.approx(kernels.dtw(b, a)[0, 0])
    assert d <= np.linalg.norm(a - b) + 1e-9


def test_dtw_known():
    assert kernels.dtw(np.array([[0.0, 1, 2]]), np.array([[0.0, 0, 1, 2]]))[0, 0] == 0


def test_matrix_profile_by_definition():
    x = np.random.default_rng(0).normal(size=24)
    w = kernels.profile_width(24)
    sub = [x[i : i + w] for i in range(24 - w + 1)]
    want = [min(np.linalg.norm(a - b) for j, b in enumerate(sub) if abs(i - j) >= w) for i, a in enumerate(sub)]
    assert np.allclose(kernels.matrix_profile(x[None])[0], want)
    assert kernels.mpdist(x[None], x[None])[0, 0] == 0
    with pytest.raises(DataError):
        kernels.matrix_profile(np.ones((1, 6)))


@pytest.mark.parametrize(("n", "width"), [(64, 16), (24, 6), (200, 20), (64, None)])
def test_sliding_profile(n, width):
    x = np.random.default_rng(2).normal(size=(4, n)) * 10 + 1000
    x[0] = np.tile(x[0, : n // 4], 4)  # repeats: distances of 0
    x[1] = 5.0
    assert np.allclose(kernels.sliding_profile(x, width), kernels.matrix_profile(x, width), atol=1e-4)
    assert kernels.sliding_profile(x, width)[0].max() == 0


def test_sliding_profile_of_a_long_series():
    x = np.random.default_rng(3).normal(size=(1, 20_000)).cumsum(1)
    p = kernels.sliding_profile(x, 64)
    assert p.shape == (1, 20_000 - 63)
    sub = np.lib.stride_tricks.sliding_window_view(x[0], 64)
    for i in (0, 63, 9_999, 19_936):
        d = np.sqrt(((sub - sub[i]) ** 2).sum(1))
        d[max(i - 63, 0) : i + 64] = np.inf
        assert p[0, i] == pytest.approx(d.min(), rel=1e-6)
    assert kernels.profile(x[:, :2000]).shape == (1, 1501)


def warped(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1] ** 0.5


@pytest.mark.parametrize(("n", "m"), [(1, 1), (1, 6), (6, 1), (17, 23), (90, 64)])
def test_dtw_by_the_recurrence(n, m, monkeypatch):
    monkeypatch.setattr(kernels, "WHOLE_CELLS", 16)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(3, n)).cumsum(1), rng.normal(size=(3, m)).cumsum(1)
    want = [warped(x, y) for x, y in zip(a, b, strict=True)]
    assert np.allclose(kernels.dtw_pairs(a, b), want)
    assert np.allclose(kernels.dtw_near(a, b, max(n, m)), want)
    near = kernels.dtw_near(a, b, 4)
    assert (near >= np.array(want) - 1e-9).all() and (near <= 1.5 * np.array(want) + 1e-9).all()


def test_dtw_of_long_series():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(1, 5000)).cumsum(1)
    b = np.repeat(a, 2, axis=1)[:, 1000:6000] + 0.1
    whole = kernels.dtw_pairs(a, b)
    assert kernels.dtw_near(a, b, 5000) == pytest.approx(whole)
    assert kernels.dtw_near(a, b, 100) >= whole - 1e-9
    assert kernels.dtw_pairs(a, np.repeat(a, 2, axis=1))[0] == 0


def test_segments_of_all_windows_at_once():
    x = np.round(np.random.default_rng(6).normal(size=(200, 14)).cumsum(1), 2)
    x[:5] = 1.0
    places = kernels.pivot_places(x, 5, 0.2)
    rows = kernels.movement_rows(x, places)
    for r in range(len(x)):
        p = [0, 13]
        while len(p) < 5:  # one window, segment by segment
            best = (0.0, None)
            for a, b in zip(p[:-1], p[1:], strict=True):
                if abs(x[r, b] - x[r, a]) >= np.ptp(x[r]) * 0.2:
                    for i in range(a + 1, b):
                        d = round(abs(x[r, a] + (x[r, b] - x[r, a]) * (i - a) / (b - a) - x[r, i]) / (np.ptp(x[r]) or 1), 9)
                        best = max(best, (d, -i), key=lambda t: (t[0], t[1] or -99))
            if best[1] is None or best[0] == 0:
                break
            p = sorted([*p, -best[1]])
        assert [v for v in places[r].tolist() if v >= 0] == p
        for j, (a, b) in enumerate(zip(p[:-1], p[1:], strict=True)):
            seg = x[r, a : b + 1]
            assert rows[r, j, 6] == pytest.approx(np.diff(seg).std(), abs=1e-9)
            assert rows[r, j, 7] == pytest.approx(np.polyfit(np.arange(len(seg)), seg, 1)[0], abs=1e-9)
        assert np.isnan(rows[r, len(p) - 1 :]).all()


def test_fading_means_compose():
    new = np.random.default_rng(7).normal(size=(500, 2))
    out, last = kernels.fade(new, 0.1), np.zeros(2)
    for i, v in enumerate(new):
        last = 0.9 * last + 0.1 * v
        assert np.allclose(out[i], last)
    k = 333  # the map of the second part, applied to what the first leaves
    assert np.allclose(kernels.fade(new[k:], 0.1) + 0.9 ** np.arange(1, 500 - k + 1)[:, None] * out[k - 1], out[k:])


def test_pivots_and_movements():
    x = np.array([0.0, 1, 2, 3, 2, 1, 0.5])
    p = kernels.pivots(x, 3, 0.001)
    assert p == [0, 3, 6]
    m = kernels.movements(x, p)
    assert m.shape == (2, 8) and m[0].tolist()[:4] == [3, 3, math.atan2(3, 3) / math.pi, 1]
    assert m[0][7] == pytest.approx(1) and m[0][4] == 0
    assert kernels.pivots(np.ones(5), 4, 0.001) == [0, 4]
    assert kernels.movements(np.ones(1), [0]).shape == (0, 8)


def test_movement_state():
    rng = np.random.default_rng(1)
    s = kernels.MovementState(16)
    rows = [s.step(rng.normal(size=25)) for _ in range(20)]
    assert all(len(r) == 16 and np.isfinite(r).all() for r in rows)
    assert kernels.MovementState(2, ("vertical", "trend")).step(np.arange(9.0))[0] != 0
    for bad in (dict(n=5), dict(n=8, features=("no",)), dict(n=8, alpha=2)):
        with pytest.raises(DataError):
            kernels.MovementState(**bad)


def test_student():
    # values of the usual tables
    assert student.quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert student.quantile(0.975, 1) == pytest.approx(12.706205, abs=1e-4)
    assert student.two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert student.two_sided(0, 5) == pytest.approx(1)
    low, high = student.interval(1.0, 0.5, 11)
    assert (low, high) == (pytest.approx(1 - 0.5 * 2.228139, abs=1e-5), pytest.approx(1 + 0.5 * 2.228139, abs=1e-5))
    assert student.interval(1.0, 0.5, 1) is None


def test_frequencies():
    assert [seconds(x) for x in ("1min", "5min", "1h", "1D", "2day", "s", 7)] == [60, 300, 3600, 86400, 172800, 1, 7]
    with pytest.raises(DataError):
        seconds("fortnight")
