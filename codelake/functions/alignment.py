"""Longest common subsequences of lines, bit by bit."""

from __future__ import annotations

from collections.abc import Sequence

#: Lines of one segment; a segment's masks take at most this many bits for each of its lines.
SEGMENT = 8192


def common_lines(a: Sequence[int], b: Sequence[int], segment: int = SEGMENT) -> int:
    """Length of the longest common subsequence of two lists of line hashes; exact, at any length.

    Equal ends are counted at once and lines of one side alone are left out.
    The rest is the bit-parallel recurrence over rows of ``b``: a set bit of
    ``row`` is a place of ``a`` where the length does not grow, and one addition
    moves all of them. ``a`` is cut into segments whose carries meet the next
    segment, so memory stays within a segment's masks and one bit per row.
    """
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < high - low and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    left, right = a[low : len(a) - tail], b[low : len(b) - tail]
    shared = set(left) & set(right)
    left, right = [x for x in left if x in shared], [x for x in right if x in shared]
    total = low + tail
    carries = bytearray(len(right))
    for start in range(0, len(left), segment):
        piece = left[start : start + segment]
        masks: dict[int, int] = {}
        for i, x in enumerate(piece):
            masks[x] = masks.get(x, 0) | 1 << i
        width = len(piece)
        ones = (1 << width) - 1
        row = ones
        for j, x in enumerate(right):
            mask = masks.get(x, 0)
            if mask or carries[j]:
                grown = row + (row & mask) + carries[j]
                carries[j] = grown >> width
                row = (grown | (row & ~mask)) & ones
        total += width - row.bit_count()
    return total
