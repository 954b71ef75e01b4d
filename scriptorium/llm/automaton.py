"""Suffix automaton over several texts whose states know which owners they occur in."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Generalised automaton; ``low`` and ``high`` are the least and greatest owner of a state's strings."""

    def __init__(self, texts: Sequence[str], low: Sequence[int], high: Sequence[int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.low, self.high = [1 << 60], [-1]
        for text, a, b in zip(texts, low, high):
            self._add(text, a, b)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if self.low[state] < self.low[up]:
                self.low[up] = self.low[state]
            if self.high[state] > self.high[up]:
                self.high[up] = self.high[state]

    def _split(self, source: int, char: str, target: int) -> int:
        """The state for the strings of ``target`` that end no longer than ``source`` and ``char``."""
        table, link, length = self.next, self.link, self.length
        clone = len(length)
        table.append(table[target].copy())
        link.append(link[target])
        length.append(length[source] + 1)
        self.low.append(1 << 60)
        self.high.append(-1)
        link[target] = clone
        while source >= 0 and table[source].get(char) == target:
            table[source][char] = clone
            source = link[source]
        return clone

    def _add(self, text: str, a: int, b: int) -> None:
        table, link, length, low, high = self.next, self.link, self.length, self.low, self.high
        last = 0
        for char in text:
            here = table[last].get(char)
            if here is not None:
                if length[here] != length[last] + 1:
                    here = self._split(last, char, here)
                last = here
                if a < low[last]:
                    low[last] = a
                if b > high[last]:
                    high[last] = b
                continue
            new = len(length)
            table.append({})
            length.append(length[last] + 1)
            low.append(a)
            high.append(b)
            state = last
            while state >= 0:
                row = table[state]
                if char in row:
                    break
                row[char] = new
                state = link[state]
            if state < 0:
                link.append(0)
            else:
                target = table[state][char]
                link.append(0)
                if length[target] != length[state] + 1:
                    target = self._split(state, char, target)
                link[new] = target
            last = new

    def foreign_spans(self, text: str, owner: int, least: int) -> list[tuple[int, int]]:
        """Disjoint spans of ``text`` made of stretches of ``least`` or more characters that another owner has.

        The text is streamed once: at each character the longest suffix found with another owner is kept
        (its matching statistics), by transitions and, where there is none, suffix links.
        """
        table, link, length, low, high = self.next, self.link, self.length, self.low, self.high
        spans: list[tuple[int, int]] = []
        state = matched = 0
        start = end = -1
        for at, char in enumerate(text, 1):
            while True:
                to = table[state].get(char)
                if to is not None and (low[to] != owner or high[to] != owner):
                    state = to
                    matched += 1
                    break
                if not state:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            if matched >= least:
                if at - matched > end:
                    if end >= 0:
                        spans.append((start, end))
                    start = at - matched
                elif at - matched < start:
                    start = at - matched
                end = at
        if end >= 0:
            spans.append((start, end))
        return spans
