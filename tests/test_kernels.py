"""Kernels against plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glasspane.functions import kernels as k

RASTERS = st.tuples(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1)).map(lambda x: np.random.default_rng(x[2]).random((x[0], x[1])) < 0.5)


def flood(mask, connectivity):
    out, n = np.zeros(mask.shape, int), 0
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (connectivity == 8 or a * b == 0)]
    for r, c in zip(*np.nonzero(mask)):
        if out[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        out[r, c] = n
        while todo:
            i, j = todo.pop()
            for a, b in near:
                x, y = i + a, j + b
                if 0 <= x < mask.shape[0] and 0 <= y < mask.shape[1] and mask[x, y] and not out[x, y]:
                    out[x, y] = n
                    todo.append((x, y))
    return out


@given(RASTERS, st.sampled_from([4, 8]))
@settings(max_examples=150, deadline=None)
def test_labels_are_components(mask, connectivity):
    got, want = k.label(mask, connectivity), flood(mask, connectivity)
    assert ((got > 0) == mask).all()
    pairs = set(zip(got[mask].tolist(), want[mask].tolist()))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@given(RASTERS, st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_sizes(mask, least):
    kept = k.without_small(mask, least)
    assert not (kept & ~mask).any()
    sizes = np.bincount(flood(mask, 4).ravel())
    assert (kept == (mask & (sizes >= least)[flood(mask, 4)])).all()
    assert (k.filled(mask, least) == ~k.without_small(~mask, least)).all()
    assert (k.without_large(mask, least) == (mask & (sizes <= least)[flood(mask, 4)])).all()


@given(RASTERS, st.integers(0, 2))
@settings(max_examples=60, deadline=None)
def test_morphology(mask, radius):
    h, w = mask.shape
    near = lambda r, c: [mask[r + a, c + b] for a, b in k.disk(radius) if 0 <= r + a < h and 0 <= c + b < w]
    want = np.array([[all(near(r, c)) for c in range(w)] for r in range(h)])
    assert (k.eroded(mask, k.disk(radius)) == want).all()
    assert not (k.opened(mask, radius) & ~mask).any()


def test_gaussian_and_laplacian():
    a = np.random.default_rng(1).random((7, 9))
    w = k.gaussian_weights(1.0)
    want = sum(w[i + 4] * w[j + 4] * a[np.clip(np.arange(7) + i, 0, 6)][:, np.clip(np.arange(9) + j, 0, 8)] for i in range(-4, 5) for j in range(-4, 5))
    np.testing.assert_allclose(k.gaussian(a, 1.0), want)
    flat = np.full((4, 4), 3.0)
    assert not k.laplacian(flat).any()
    np.testing.assert_allclose(k.median(a, 1)[3, 4], np.median([a[3, 4], a[2, 4], a[4, 4], a[3, 3], a[3, 5]]))


def test_texture_filters_answer_to_structure():
    a = np.zeros((24, 24))
    a[:, 12] = -100.0
    assert k.ridges(-a.T).shape == (24, 24)
    assert k.ridges(a)[12, 12] > k.ridges(a)[12, 3]
    stripes = np.cos(2 * np.pi * 0.25 * np.arange(24))[None, :].repeat(24, 0)
    assert np.abs(k.gabor(stripes, 0.25, 0, 3)).mean() > 5 * np.abs(k.gabor(stripes, 0.25, np.pi / 2, 3)).mean()
    codes = k.binary_pattern(np.full((9, 9), 5.0))
    assert codes[4, 4] == 2**24 - 1


@pytest.mark.parametrize("seed", range(5))
def test_outlines_enclose_their_pixels(seed):
    mask = np.random.default_rng(seed).random((8, 8)) < 0.6
    area = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2
    got = sum(area(outer) - sum(map(area, holes)) for outer, holes in k.outline(mask))
    assert got == mask.sum()
    assert all(ring[0] == ring[-1] for outer, holes in k.outline(mask) for ring in (outer, *holes))


def test_local_otsu_splits_two_levels():
    a = np.full((9, 9), 40)
    a[:, 5:] = 200
    t = k.local_otsu(a, 3)
    assert 40 <= t[4, 4] < 200


def test_local_otsu_like_a_plain_loop():
    a = np.random.default_rng(3).integers(0, 40, (9, 13)) * 6
    a[:4, :4] = 17
    got = k.local_otsu(a, 2)
    for r in range(9):
        for c in range(13):
            own = [a[r + i, c + j] for i, j in k.disk(2) if 0 <= r + i < 9 and 0 <= c + j < 13]
            n = np.bincount(own, minlength=256).astype(float)
            w1, s1 = n.cumsum(), (n * np.arange(256)).cumsum()
            w2, s2 = w1[-1] - w1, s1[-1] - s1
            with np.errstate(invalid="ignore", divide="ignore"):
                between = np.where((w1 > 0) & (w2 > 0), w1 * w2 * (s1 / w1 - s2 / w2) ** 2, -1)
            assert got[r, c] == (between.argmax() if between.max() > 0 else own[0])


def test_median_in_parts():
    a = np.random.default_rng(4).random((21, 8))
    assert (k.median(a, 2, rows=5) == k.median(a, 2, rows=100)).all()
    assert k.median(a, 1)[3, 0] == np.median([a[3, 0], a[2, 0], a[4, 0], a[3, 1]])


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 9, 14, 40, 10_000])
def test_lowest_under_large_disks(radius):
    a = np.random.default_rng(radius).integers(0, 1000, (11, 17))
    assert (k.lowest_disk(a, radius) == k.lowest(a, k.disk(min(radius, 40)))).all()
