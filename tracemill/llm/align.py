"""Edit distance of word sequences inside a band around the diagonal, one machine word of any length a column."""

from __future__ import annotations

from collections import Counter

import numpy as np


def banded_distance(a: list, b: list, most: int) -> int:
    """The edit distance of a and b, or most + 1 if it is larger.

    Cells further than `most` from the diagonal cannot be on a cheap enough path. The vertical differences of the
    2 * most + 2 cells of a column that count are held as bits of Python integers, and a whole column is
    worked out by a few operations on them (after Hyyro, 2003).
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b:
        return len(a)
    common = sum((Counter(a) & Counter(b)).values())
    if len(a) - common > most:
        return most + 1
    most_here = min(most, len(a))
    width = 2 * most_here + 2
    full, low = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    up, down = (full << (width - most_here - 1)) & full, 0  # vertical differences +1 and -1
    distance, first, column = most_here, most_here + 1 - width, 0
    limit = most + len(b) - (len(a) - most_here)  # what later columns can still take back
    while column < len(b) and column < len(a) - most_here:  # the band's lowest cell moves along the diagonal
        match = where.get(b[column], 0)
        match = (match << -first if first < 0 else match >> first) & full
        d0 = ((((match & up) + up) ^ up) | match | down) & full
        right, left = (down | ~(d0 | up)) & full, d0 & up
        distance += not d0 & low
        if distance > limit:
            return most + 1
        up, down = (left | ~(d0 >> 1 | right)) & full, d0 >> 1 & right
        first += 1
        column += 1
    mark = low >> 1
    while column < len(b):  # the last row of a is reached: now along it
        match = where.get(b[column], 0)
        match = (match << -first if first < 0 else match >> first) & full
        d0 = ((((match & up) + up) ^ up) | match | down) & full
        right, left = (down | ~(d0 | up)) & full, d0 & up
        distance += bool(right & mark) - bool(left & mark)
        mark >>= 1
        up, down = (left | ~(d0 >> 1 | right)) & full, d0 >> 1 & right
        first += 1
        column += 1
    return min(distance, most + 1)


def plain_distance(a: list, b: list) -> int:
    """Textbook edit distance, for tests."""
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + np.array([x != y for y in b], int)]))
        row = np.minimum.accumulate(new - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def _resync(a: list, b: list, i: int, j: int, reach: int = 8, words: int = 3) -> tuple[int, int] | None:
    """The nearest (x, y) after a mismatch from where a and b agree for some words again."""
    for s in range(1, reach + 1):
        for x, y in ((s, s), *((s, t) for t in range(s - 1, -1, -1)), *((t, s) for t in range(s - 1, -1, -1))):
            if a[i + x : i + x + words] == b[j + y : j + y + words] and i + x <= len(a) and j + y <= len(b):
                return x, y
    return None


def aligned_within(a: list, b: list, most: int) -> bool:
    """Whether some alignment of a and b costs at most `most` edits.

    Copies with few edits are settled by one greedy pass, whose cost is that of a real alignment;
    all others by the banded distance.
    """
    if abs(len(a) - len(b)) > most:
        return False
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif (step := _resync(a, b, i, j)) is None:
            break
        else:
            cost, i, j = cost + max(step), i + step[0], j + step[1]
    if cost + max(len(a) - i, len(b) - j) <= most:
        return True
    return banded_distance(a, b, most) <= most
