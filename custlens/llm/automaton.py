"""Suffix automata: of several sequences of numbers, and of one text."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Accepts every run of consecutive symbols of the sequences added so far; none crosses two sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def add(self, symbols: Sequence[int]) -> None:
        last = 0
        for symbol in symbols:
            last = self._extend(last, symbol)

    def _split(self, state: int, symbol: int, target: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:  # another sequence has been here
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, symbol, known)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            if self.length[target] == self.length[state] + 1:
                self.link[new] = target
            else:
                self.link[new] = self._split(state, symbol, target)
        return new

    def step(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest suffix, after one more symbol, that some sequence holds."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        following = self.next[state].get(symbol)
        return (0, 0) if following is None else (following, matched + 1)
