import math

import numpy as np
import pytest

from wayline.operators import deadreckon as D


def plain(rule, h, g, dt, fix):
    moved = h + g * dt
    if fix != fix:
        return moved % D.TWO_PI
    if rule is D.blended:
        return (0.9 * moved + 0.1 * fix) % D.TWO_PI
    return (moved + 0.1 * math.remainder(fix - moved, D.TWO_PI)) % D.TWO_PI


@pytest.mark.parametrize("rule", [D.blended, D.circular_blended])
def test_sessions_in_step_equal_a_row_by_row_fold(rule):
    rng = np.random.default_rng(2)
    lengths = np.array([1, 40, 7, 7, 123, 2])
    n = lengths.sum()
    first, gyro, dt = rng.uniform(0, 6, n), rng.normal(size=n), rng.uniform(0, 2, n)
    fixes = np.where(rng.random(n) < 0.5, np.nan, rng.uniform(0, 2 * np.pi, n))
    found, at = D.in_step(lengths, first, rule, gyro, dt, fixes), 0
    for size in lengths:
        h = first[at]
        assert found[at] == h
        for i in range(at + 1, at + size):
            h = plain(rule, h, gyro[i], dt[i], fixes[i])
            assert abs(found[i] - h) < 1e-9
        at += size


def test_a_linear_blend_is_not_circular():
    h = np.radians([359.0])
    assert abs(np.degrees(D.blended(h, 0.0, 0.0, np.radians([1.0])))[0] - 323.2) < 1e-9
    assert abs(np.degrees(D.circular_blended(h, 0.0, 0.0, np.radians([1.0])))[0] - 359.2) < 1e-9
    assert len(D.in_step(np.array([], int), np.array([]), D.blended, np.array([]), np.array([]), np.array([]))) == 0
