"""A suffix automaton of a shard of word sequences, for matching statistics.

The automaton of a shard accepts every run of symbols of its reference
sequences. Each state keeps where its runs ended first, so a stream of symbols
learns at each position the longest run that the reference has, and where that
run stood first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """Built online, a sequence after the other, in the order of their positions.

    next, link, length: each state's edges, suffix link and longest run; first: the
    number of the symbol with which its runs ended first.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]

    def _state(self, length: int, first: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.first[q], self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, symbol: int, place: int) -> int:
        """Add a symbol after state ``last``; place is remembered if its runs are new."""
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
        new = self._state(self.length[last] + 1, place, 0, {})
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return new

    def add(self, symbols: Sequence[int], place: int) -> None:
        """Add a reference sequence whose first symbol has the number ``place``."""
        last = 0
        for i, symbol in enumerate(symbols):
            last = self.extend(last, symbol, place + i)

    def matches(self, symbols: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
        """For each symbol: length of the longest run ending there that the reference has (at most ``limit``), and where that run ended first."""
        state = matched = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            if matched > limit:
                matched = limit
            while state and self.length[self.link[state]] >= matched:
                state = self.link[state]
            yield matched, self.first[state]
