"""Matching of two word sequences by suffix automata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """All runs of a sequence, built an item at a time; each state knows where it first ends.

    An item of None parts runs: it is in none of them.
    """

    def __init__(self, items: Sequence[Hashable]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]
        last = 0
        for end, item in enumerate(items):
            last = 0 if item is None else self._extend(last, item, end)

    def _state(self, length: int, link: int, first_end: int, following: dict) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.first_end.append(first_end)
        return len(self.length) - 1

    def _extend(self, last: int, item: Hashable, end: int) -> int:
        known = self.next[last].get(item)
        if known is not None:  # after a None the same run may begin again
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, item)
        new = self._state(self.length[last] + 1, 0, end, {})
        p = last
        while p >= 0 and item not in self.next[p]:
            self.next[p][item] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][item]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, item)
        return new

    def _split(self, p: int, q: int, item: Hashable) -> int:
        """A state of its own for the runs of ``q`` that are short enough to follow ``p``."""
        clone = self._state(self.length[p] + 1, self.link[q], self.first_end[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(item) == q:
            self.next[p][item] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def longest(self, other: Sequence[Hashable]) -> tuple[int, int, int]:
        """(start in ``other``, start here, length) of the longest common run: the first in ``other``, then the first here."""
        best, state, n = (0, 0, 0), 0, 0
        for at, item in enumerate(other):
            while state and item not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if item is not None and item in self.next[state]:
                state, n = self.next[state][item], n + 1
            if n > best[2]:
                best = (at - n + 1, self.first_end[state] - n + 1, n)
        return best


def common_items(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Items in the longest common run of ``a`` and ``b`` and, again, in what lies to its left and to its right.

    Of equal runs the first in ``a`` counts, then the first in ``b``.  Items that make up over 1 %
    of 200 or more in ``b`` begin no run; they lengthen the runs that they touch.
    """
    often = {x for x, n in Counter(b).items() if len(b) >= 200 and n > len(b) // 100 + 1}
    told = [None if x in often else x for x in b]
    total, open_ranges = 0, [(0, len(a), 0, len(b))]
    while open_ranges:
        a0, a1, b0, b1 = open_ranges.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, n = SuffixAutomaton(told[b0:b1]).longest(a[a0:a1])
        i, j = i + a0, j + b0
        while n and i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
            n += 1
        if n:
            total += n
            open_ranges += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return total
