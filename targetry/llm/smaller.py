"""All nearest smaller values by block minima, all elements at once."""

from __future__ import annotations

import numpy as np


def previous_smaller(values: np.ndarray, of: np.ndarray | None = None, strict: bool = True) -> np.ndarray:
    """For each element (or those numbered by of) the last one before it that is smaller, or not greater if not strict;
    -1 if there is none. Minima of blocks of 2, 4, 8 ... elements are passed upwards until a block holds such a value, then
    followed down to it; the elements take each step together."""
    of = np.arange(len(values)) if of is None else of
    if not len(of):
        return np.empty(0, np.int64)
    minima = [values]
    top = np.iinfo(values.dtype).max
    while len(minima[-1]) > 1:
        low = minima[-1]
        if len(low) % 2:
            low = np.append(low, top)
        minima.append(np.minimum(low[::2], low[1::2]))
    own = values[of]
    fits = (lambda a, b: a < b) if strict else (lambda a, b: a <= b)
    found, level = np.full(len(of), -1, np.int64), np.zeros(len(of), np.int64)
    todo, at = np.arange(len(of)), of.astype(np.int64)
    for k, low in enumerate(minima):
        odd = at % 2 == 1
        hit = np.zeros(len(todo), bool)
        hit[odd] = fits(low[at[odd] - 1], own[todo[odd]])
        found[todo[hit]], level[todo[hit]] = at[hit] - 1, k
        todo, at = todo[~hit], at[~hit] >> 1
        if not len(todo):
            break
    for k in range(int(level.max(initial=0)), 0, -1):
        on = np.flatnonzero(level == k)
        low, child = minima[k - 1], found[on] * 2 + 1
        inside = child < len(low)
        right = np.zeros(len(on), bool)
        right[inside] = fits(low[child[inside]], own[on[inside]])
        found[on], level[on] = np.where(right, child, child - 1), k - 1
    return found


def next_smaller(values: np.ndarray, of: np.ndarray | None = None, strict: bool = True) -> np.ndarray:
    """As previous_smaller, of what follows; the number of elements if there is none."""
    n = len(values)
    of = np.arange(n) if of is None else of
    return n - 1 - previous_smaller(values[::-1], n - 1 - of, strict)
