"""The cutting-stock linear program over a length histogram, by column generation.

A pattern says how many items of each length class one bin holds. The master program picks how often each pattern is
used so that every class is covered by the fewest bins; an unbounded knapsack over the duals prices new patterns. All
sizes here are bounded by the bin's capacity and the number of classes, whatever the corpus.
"""

from __future__ import annotations

import numpy as np

#: Length classes of the program; with fewer distinct lengths each is a class of its own.
CLASSES = 192
#: The program is solved when it is proven to use at most so many times more bins than the optimum.
GAP = 2e-4


def classes_of(counts: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """counts[l] items have length l. Returns the classes' upper ends, so chosen by merging neighbours that little is
    lost when every item is rounded up to its class's end."""
    ends = list(np.flatnonzero(counts))
    held = [int(counts[e]) for e in ends]
    while len(ends) > most:
        size = np.array(ends, float)
        cost = np.array(held[:-1], float) * np.diff(size)  # of raising class i to the end of class i + 1
        cut = np.partition(cost, len(ends) - most - 1)[len(ends) - most - 1]
        i, new_ends, new_held, spare = 0, [], [], len(ends) - most
        while i < len(ends):
            if spare and i + 1 < len(ends) and cost[i] <= cut:
                new_ends.append(ends[i + 1])
                new_held.append(held[i] + held[i + 1])
                spare -= 1
                i += 2
            else:
                new_ends.append(ends[i])
                new_held.append(held[i])
                i += 1
        ends, held = new_ends, new_held
    return np.array(ends, int)


def _price(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c], and the class taken last to reach it (-1: none), of the unbounded knapsack."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        n = fits[c]
        value = best[c - sizes[:n]] + duals[:n]
        i = int(value.argmax())
        if value[i] > best[c - 1] + 1e-12:
            best[c], last[c] = value[i], i
        else:
            best[c] = best[c - 1]
    return best, last


def _pattern(first: int, sizes: np.ndarray, last: np.ndarray, capacity: int) -> np.ndarray:
    out = np.zeros(len(sizes))
    out[first] = 1
    c = capacity - int(sizes[first])
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(sizes[last[c]])
    return out


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[float, np.ndarray]]:
    """(times used, pattern) of the basic solution; `sizes` ascending and at most `capacity`, `demand` positive."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    inverse, times = np.linalg.inv(basis), demand / np.diag(basis)
    pool = np.zeros((0, m))
    least = float(sizes @ demand) / capacity
    for k in range(rounds):
        duals = inverse.sum(axis=0)
        best, last = _price(sizes, np.maximum(duals, 0), capacity)
        top = best[capacity]
        # bins needed at least: for the material, and by the duals scaled until no pattern is worth more than a bin
        least = max(least, float(times.sum()) / top)
        if times.sum() <= (1 + GAP) * least:
            break
        value = np.maximum(duals, 0) + best[capacity - sizes]
        offered = [_pattern(int(i), sizes, last, capacity) for i in np.argsort(-value)[: max(8, m // 4)] if value[i] > 1 + 1e-9]
        pool = np.unique(np.vstack([pool[-4 * m :], *offered]), axis=0)
        for _ in range(2 * m):
            duals = inverse.sum(axis=0)
            worth = pool @ duals
            j = int(worth.argmax())
            if worth[j] <= 1 + 1e-7:
                break
            direction = inverse @ pool[j]
            ratio = np.full(m, np.inf)
            np.divide(times, direction, out=ratio, where=direction > 1e-9)
            r = int(ratio.argmin())
            if not np.isfinite(ratio[r]):
                break
            step = ratio[r]
            times = np.maximum(times - step * direction, 0)
            times[r] = step
            pivot = inverse[r] / direction[r]
            inverse -= np.outer(direction, pivot)
            inverse[r] = pivot
            basis[:, r] = pool[j]
        if k % 8 == 7:  # against rounding
            inverse = np.linalg.inv(basis)
            times = np.maximum(inverse @ demand, 0)
    return [(float(t), basis[:, k].astype(int)) for k, t in enumerate(times) if t > 1e-9]


def rounded(solution: list[tuple[float, np.ndarray]], sizes: np.ndarray, demand: np.ndarray, capacity: int, waste: int) -> list[tuple[int, np.ndarray]]:
    """(times used, pattern) in whole numbers: fullest patterns first, no more than the program's share rounded up nor
    than the items left; patterns that would leave more than `waste` empty are not used."""
    left, out = demand.astype(int).copy(), []
    for times, pattern in sorted(solution, key=lambda x: (-int(x[1] @ sizes), -x[0])):
        if int(pattern @ sizes) < capacity - waste:
            continue
        used = pattern > 0
        n = int(min(np.ceil(times - 1e-9), (left[used] // pattern[used]).min()))
        if n > 0:
            left -= n * pattern
            out.append((n, pattern))
    return out
