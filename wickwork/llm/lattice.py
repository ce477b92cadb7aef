"""The lattice E8: all vectors of eight whole numbers, or of eight halves of odd numbers, whose sum is even."""

from __future__ import annotations

import functools
import itertools

import numpy as np


def _even_sums(x: np.ndarray) -> np.ndarray:
    """The nearest points of whole numbers with an even sum: where the sum is odd, the worst rounding is undone."""
    near = np.rint(x)
    rows = np.flatnonzero(near.sum(1) % 2 != 0)
    error = x[rows] - near[rows]
    worst = np.abs(error).argmax(1)
    near[rows, worst] += np.where(error[np.arange(len(rows)), worst] >= 0, 1, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The lattice point next to each row of ``x`` (n, 8)."""
    whole, half = _even_sums(x), _even_sums(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest and the 2,160 next longer vectors: the lattice points whose cells touch the cell of 0."""
    out = []
    for size, values in ((2, (1, -1)), (4, (1, -1))):
        for places in itertools.combinations(range(8), size):
            for signs in itertools.product(values, repeat=size):
                v = np.zeros(8)
                v[list(places)] = signs
                out.append(v)
    for place, sign in itertools.product(range(8), (2, -2)):
        v = np.zeros(8)
        v[place] = sign
        out.append(v)
    for signs in itertools.product((0.5, -0.5), repeat=8):
        v = np.array(signs)
        if v.sum() % 2 == 0:
            out.append(v)
        for place in range(8):
            w = v.copy()
            w[place] *= 3
            if w.sum() % 2 == 0:
                out.append(w)
    return np.array(out)


def cells_within(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The own point of each row, and (row, point) for all other points whose cell may come within ``radius`` of the row.

    A cell that comes within the radius lies beyond no wall between it and the own cell by more than that. ``radius`` may
    be 0.7 at most: cells that don't touch are 1 / sqrt(2) apart.
    """
    if not 0 <= radius <= 0.7:
        raise ValueError("cells that do not touch the own one would be missed")
    own, around = nearest(x), neighbours()
    square = (around**2).sum(1)
    row, which = np.nonzero(square / 2 - (x - own) @ around.T <= radius * np.sqrt(square))
    return own, row, own[row] + around[which]
