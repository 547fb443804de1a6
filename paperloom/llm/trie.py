"""A vocabulary trie intersected with Levenshtein automata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Trie:
    """Words with counts; ``within`` walks trie and automaton together.

    The state of the automaton after a prefix is the row of edit distances between the prefix
    and all prefixes of the query; a branch is left when no entry of the row is in reach, so
    exactly the words within the distance are visited: retrieval is complete.
    """

    def __init__(self, words: Iterable[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = (word, n)

    def within(self, query: str, distance: int) -> Iterator[tuple[str, int]]:
        start = tuple(min(i, distance + 1) for i in range(len(query) + 1))
        stack = [(self.root, start)]
        steps: dict = {}
        while stack:
            node, row = stack.pop()
            if "" in node and row[-1] <= distance:
                yield node[""]
            for c, child in node.items():
                if c == "":
                    continue
                nxt = steps.get((row, c))
                if nxt is None:
                    nxt = steps[row, c] = self._step(row, c, query, distance)
                if min(nxt) <= distance:
                    stack.append((child, nxt))

    @staticmethod
    def _step(row: tuple, c: str, query: str, distance: int) -> tuple:
        out = [min(row[0] + 1, distance + 1)]
        for i, q in enumerate(query):
            out.append(min(row[i] + (q != c), row[i + 1] + 1, out[-1] + 1, distance + 1))
        return tuple(out)
