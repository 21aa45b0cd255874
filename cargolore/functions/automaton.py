"""A word automaton: finds all terms of a list in one pass over a text's words."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

WORD = re.compile(r"[^\W_]+")


def split_words(text: str | None) -> list[tuple[str, int, int]]:
    """Lower-cased words with where they start and end, in characters of the text."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text or "")]


class Automaton:
    """Aho-Corasick over words.  ``terms`` are lists of words; a term's number is its place.
    A list of words may be several terms."""

    def __init__(self, terms: list[list[str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.own: list[list[int]] = [[]]  # the terms that end at a state
        self.size = [len(t) for t in terms]
        for number, term in enumerate(terms):
            at = 0
            for word in term:
                if word not in self.next[at]:
                    self.next[at][word] = len(self.next)
                    self.next.append({})
                    self.own.append([])
                at = self.next[at][word]
            if term:
                self.own[at].append(number)
        self.fail = [0] * len(self.next)
        self.shorter = [-1] * len(self.next)  # the next state by failure links at which a term ends
        todo = deque(self.next[0].values())
        while todo:
            at = todo.popleft()
            back = self.fail[at]
            self.shorter[at] = back if self.own[back] else self.shorter[back]
            for word, to in self.next[at].items():
                self.fail[to] = self._step(back, word)
                todo.append(to)

    @classmethod
    def restored(cls, state: dict) -> Automaton:
        """The automaton whose ``vars`` are given: a broadcast of these needs no class to be read."""
        out = cls.__new__(cls)
        vars(out).update(state)
        return out

    def _step(self, at: int, word: str) -> int:
        while at and word not in self.next[at]:
            at = self.fail[at]
        return self.next[at].get(word, 0)

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """Number of the term, first and last word of each occurrence."""
        at = 0
        for i, word in enumerate(words):
            at = self._step(at, word)
            found = at
            while found > 0:
                for number in self.own[found]:
                    yield number, i - self.size[number] + 1, i
                found = self.shorter[found]


def leftmost_longest(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans (first and last word, and anything) those that a reader from left to
    right takes, each time the longest that starts first."""
    kept, end = [], -1
    for span in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if span[0] > end:
            kept.append(span)
            end = span[1]
    return kept
