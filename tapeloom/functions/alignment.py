"""Edit distance of two sequences of numbers, a bit a cell."""

from __future__ import annotations

from collections.abc import Sequence

#: Rows of one strip: so many bits of a number are stepped at once.
STRIP = 1 << 14


def _strip(a: Sequence[int], b: Sequence[int], top: list[int]) -> list[int]:
    """Costs along the bottom of a strip of rows ``a`` under columns ``b``.

    ``top`` has the costs along its upper edge, from the column before ``b`` on; down the
    left edge costs grow by one a row.  Along a column neighbours differ by one at most, so
    a column is two numbers: where cost grows downward and where it falls.
    """
    full, last = (1 << len(a)) - 1, len(a) - 1
    same: dict[int, int] = {}
    for i, x in enumerate(a):
        same[x] = same.get(x, 0) | (1 << i)
    up, down, cost = full, 0, top[0] + len(a)
    out = [cost]
    for j, x in enumerate(b):
        step = top[j + 1] - top[j]
        eq = same.get(x, 0)
        vertical = eq | down
        if step < 0:
            eq |= 1
        horizontal = (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(horizontal | up)), up & horizontal
        cost += (right >> last & 1) - (left >> last & 1)
        right, left = (right << 1) & full, (left << 1) & full
        if step > 0:
            right |= 1
        elif step < 0:
            left |= 1
        up, down = left | (full & ~(vertical | right)), right & vertical
        out.append(cost)
    return out


def _banded(a: Sequence[int], b: Sequence[int], band: int) -> int:
    """A bound from above on the distance, exact if it is at most ``band``: cells further from the diagonal are taken as edges."""
    n, low, edge = len(b), 0, list(range(min(len(b), band) + 1))
    for at in range(0, len(a), STRIP):
        rows = a[at : at + STRIP]
        start, stop = max(0, at - band), min(n, at + len(rows) + band)
        if start > low:
            edge, low = edge[start - low :], start
        # Right of what the strip above has seen, costs grow by one a column.
        edge += range(edge[-1] + 1, edge[-1] + 1 + stop - low - len(edge) + 1)
        edge = _strip(rows, b[start:stop], edge)
    return edge[n - low] if n - low < len(edge) else edge[-1] + n - low - len(edge) + 1


def distance(a: Sequence[int], b: Sequence[int]) -> int:
    """Insertions, deletions and replacements that make ``b`` of ``a``, at least.

    What both begin and end with costs nothing.  The band around the diagonal doubles
    until the distance fits into it, so the work grows with length times distance.
    """
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    e = 0
    while e < min(len(a), len(b)) - k and a[len(a) - 1 - e] == b[len(b) - 1 - e]:
        e += 1
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    band = max(abs(len(a) - len(b)), STRIP // 4, 1)
    while True:
        found = _banded(a, b, band)
        if found <= band:
            return found
        band *= 2
