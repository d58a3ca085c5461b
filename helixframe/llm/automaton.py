"""A generalised suffix automaton over hashable tokens."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Recognises every run of tokens of the sequences added so far; no run crosses from one sequence to another."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, tokens: Iterable[Hashable]) -> list[int]:
        """Adds a sequence; the state of each of its prefixes."""
        last, states = 0, []
        for t in tokens:
            last = self._extend(last, t)
            states.append(last)
        return states

    def _state(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, t: Hashable, q: int) -> int:
        """The part of state q that ends p's strings and t, as a state of its own."""
        clone = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, t: Hashable) -> int:
        q = self.next[last].get(t)
        if q is not None:  # the prefix occurs already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, t, q)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return new

    def step(self, state: int, matched: int, t: Hashable) -> tuple[int, int]:
        """After one more token: the state and the length of the longest suffix that is recognised."""
        follow = self.next
        while state and t not in follow[state]:
            state = self.link[state]
            matched = self.length[state]
        to = follow[state].get(t)
        return (0, 0) if to is None else (to, matched + 1)

    def statistics(self, tokens: Sequence[Hashable]) -> list[int]:
        """For each place the length of the longest recognised run that ends there."""
        state = matched = 0
        out = []
        for t in tokens:
            state, matched = self.step(state, matched, t)
            out.append(matched)
        return out
