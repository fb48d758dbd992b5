"""Pages of one shape are turned together when all enhancements are asked for."""

import numpy as np

from inkledger.functions import raster


def test_turns_are_worked_out_once_a_shape(monkeypatch):
    plain, counted = raster._turned.__wrapped__, []

    def turned(h, w, angle):
        counted.append((h, w, angle))
        return plain(h, w, angle)

    turned.__wrapped__ = turned
    monkeypatch.setattr(raster, "_turned", turned)
    rng = np.random.default_rng(5)
    pages = [raster.page(bytes(rng.integers(0, 256, n, dtype=np.uint8)), 64) for n in [0] + [64 * 9] * 30 + [64 * 7] * 30]
    got = list(raster._all_changes(pages))
    angles = 2 * raster.ANGLES + 1
    assert len(counted) <= 2 * angles + len(pages)  # before: all angles for every page
    assert [(k, how) for k, how, _ in got] == [(k, how) for k in range(len(pages)) for how in sorted(raster.ENHANCED)]
    for k, how, pixels in got[::7]:
        assert pixels == (raster.ENHANCED[how](pages[k]).tobytes() if pages[k].size else b"")
