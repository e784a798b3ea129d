"""Suffix automata over sequences of integers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """Accepts every piece of every added sequence; one state per set of end positions.

    `step` follows a stream and keeps the longest suffix read so far that is a piece of an added sequence.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def __len__(self) -> int:
        return len(self.next)

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """The state of the pieces of `target` that are at most one longer than `state`."""
        short = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = short
        while state != -1 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = short
            state = self.link[state]
        return short

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for symbol in sequence:
            last = self._append(last, symbol)

    def _append(self, last: int, symbol: int) -> int:
        target = self.next[last].get(symbol)
        if target is not None:  # an earlier sequence has this piece already
            return target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
        new = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state != -1 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state != -1:
            target = self.next[state][symbol]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self._split(state, symbol, target)
        return new

    def stream(self, symbols: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, longest matching length) after each symbol."""
        moves, link, length = self.next, self.link, self.length
        state = matched = 0
        for symbol in symbols:
            while state and symbol not in moves[state]:
                state = link[state]
                matched = length[state]
            target = moves[state].get(symbol)
            if target is not None:
                state, matched = target, matched + 1
            yield state, matched

    def at_length(self, wanted: int) -> list[int]:
        """For each state, the state of its pieces' suffixes of the wanted length (itself if it is shorter)."""
        found = [0] * len(self)
        for state in sorted(range(1, len(self)), key=self.length.__getitem__):
            above = self.link[state]
            found[state] = found[above] if self.length[above] >= wanted else state
        return found
