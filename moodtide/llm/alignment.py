"""Longest common subsequences of lines."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

#: Matrices of so many cells are kept as rows of bits; larger ones are cut in two first.
CELLS_AT_ONCE = 1 << 24


def bit_rows(a: Sequence[Hashable], b: Sequence[Hashable], keep: bool) -> list[int]:
    """A number per line of ``a`` (the last alone unless ``keep``): bit j is 0 where b[j] lengthens the subsequence."""
    full = (1 << len(b)) - 1
    at: dict[Hashable, int] = {}
    for j, line in enumerate(b):
        at[line] = at.get(line, 0) | 1 << j
    row, rows = full, []
    for line in a:
        hit = row & at.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def lengths_by_end(row: int, n: int) -> list[int]:
    """The length of the subsequence with b[:0], b[:1], ... b[:n]."""
    out = [0]
    for bit in reversed(format(row, f"0{n}b") if n else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def common_lines(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Pairs of places (i, j) of a longest common subsequence, in order.

    Rows of the matrix are numbers of len(b) bits; where all of them would be too many, ``a`` is cut
    in the middle and ``b`` where the two halves' lengths add up to most, so memory stays linear.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        # lines that the other side does not have cannot match
        ours, theirs = set(a[a0:a1]), set(b[b0:b1])
        left = [i for i in range(a0, a1) if a[i] in theirs]
        right = [j for j in range(b0, b1) if b[j] in ours]
        if not left or not right:
            continue
        x, y = [a[i] for i in left], [b[j] for j in right]
        if len(x) * len(y) <= CELLS_AT_ONCE or len(x) == 1:
            rows, i, j = bit_rows(x, y, True), len(x) - 1, len(y) - 1
            while i >= 0 and j >= 0:
                if x[i] == y[j]:
                    found.append((left[i], right[j]))
                    i, j = i - 1, j - 1
                elif rows[i] >> j & 1:
                    j -= 1
                else:
                    i -= 1
            continue
        half = len(x) // 2
        front = lengths_by_end(bit_rows(x[:half], y, False)[0], len(y))
        back = lengths_by_end(bit_rows(x[half:][::-1], y[::-1], False)[0], len(y))
        cut = max(range(len(y) + 1), key=lambda j: front[j] + back[len(y) - j])
        middle = right[cut] if cut < len(right) else b1
        todo += [(a0, left[half], b0, middle), (left[half], a1, middle, b1)]
    return sorted(found)
