"""Sums of a block's resamples."""

import numpy as np
import pytest

from convgraph.operators import resample


@pytest.mark.parametrize("n,block", [(7, 0), (4096, 0), (4097, 1), (50_000, 3)])
@pytest.mark.parametrize("kind", ["one column", "columns", "some values missing", "one value a unit"])
def test_totals_are_weights_times_values(n, block, kind, monkeypatch):
    size, rng = min(n - block * 4096, 4096), np.random.default_rng(n)
    v = rng.normal(size=(size, 1 if kind == "one column" else 3))
    if kind == "some values missing":
        v[rng.random(v.shape) < 0.1] = np.nan
    if kind == "one value a unit":
        v[np.arange(3)[None, :] != rng.integers(0, 3, size)[:, None]] = np.nan
    keys, calls = resample._keys, []
    monkeypatch.setattr(resample, "_keys", lambda *a: calls.append(1) or keys(*a))
    b = np.arange(40, 90)
    sums, counts = resample.block_totals(v, b, n, 20, block)
    assert len(calls) == 1  # not once for every few resamples
    w = resample.block_weights(b, n, 20, block)
    assert np.allclose(sums, w @ np.nan_to_num(v), rtol=1e-12, atol=1e-9)
    assert (counts == w @ (~np.isnan(v)).astype(int)).all()


def test_a_place_at_the_modulus_is_the_first_one():
    """Keys for which the last sum is a multiple of 2^31 - 1: place 0, not the last one."""
    m = 2147483647
    first = np.array([0, m - 1], dtype=np.uint64)  # their squares are 0 and 1
    second = np.array([0, m - 1], dtype=np.uint64)
    for size in (4096, 4095, 3):
        assert resample._places(first, second, 1, size).ravel().tolist() == [0, 0]
