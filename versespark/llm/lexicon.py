"""Words within a few edits of a lexicon: Levenshtein automata run together along the lexicon's trie.

A state of the automaton is a set of trie nodes, each with the edits that it took to reach it; a letter moves every one of
them (as it stands, replaced, inserted, or first of two that are swapped), and letters that a word leaves out are steps
down the trie without reading. Nodes below which no entry allows so many edits are left out, so most words leave the
automaton after two or three letters. Sets are made into states of a deterministic automaton when a word first reaches
them, and remembered.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Letters from which on an entry allows one edit and two.
ONE_EDIT, TWO_EDITS = 5, 8
#: States that are remembered; beyond that the memory starts anew.
STATES = 50_000


@dataclass(frozen=True)
class Entry:
    """A term; an open one also stands for all words that begin with it."""

    term: str
    open: bool

    @property
    def edits(self) -> int:
        return (len(self.term) >= ONE_EDIT) + (len(self.term) >= TWO_EDITS)


class LexiconAutomaton:
    def __init__(self, entries: list[Entry]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.most: list[int] = [-1]  # the edits that some entry below a node allows
        self.ends: list[list[int]] = [[]]
        for number, entry in enumerate(entries):
            node = 0
            self.most[0] = max(self.most[0], entry.edits)
            for letter in entry.term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.most.append(-1)
                    self.ends.append([])
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], entry.edits)
            self.ends[node].append(number)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._number({(0, ""): 0})

    def _number(self, reached: dict[tuple[int, str], int]) -> int:
        """The state of a set of (node, letter that is still to be swapped in) with their edits. Entries that are open and
        complete stay complete: they are negative nodes."""
        todo = list(reached.items())
        while todo:
            (node, swap), edits = todo.pop()
            if node < 0 or swap or reached[node, swap] < edits:
                continue
            for number in self.ends[node]:
                if self.entries[number].open and edits <= self.entries[number].edits:
                    key = (-1 - number, "")
                    reached[key] = min(edits, reached.get(key, edits))
            for child in self.children[node].values():  # the word leaves a letter out
                if edits < self.most[child] and reached.get((child, ""), edits + 2) > edits + 1:
                    reached[child, ""] = edits + 1
                    todo.append(((child, ""), edits + 1))
        key = frozenset(reached.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.found.append(self._best(reached))
        return self.numbers[key]

    def _best(self, reached: dict[tuple[int, str], int]) -> tuple[int, int] | None:
        """The entry that a word which ends here stands for and its edits: the fewest, then the longest term."""
        hits = [(edits, -1 - node) for (node, _), edits in reached.items() if node < 0]
        hits += [(edits, number) for (node, swap), edits in reached.items() if node >= 0 and not swap for number in self.ends[node] if edits <= self.entries[number].edits]
        if not hits:
            return None
        edits, number = min(hits, key=lambda h: (h[0], -len(self.entries[h[1]].term), h[1]))
        return number, edits

    def _step(self, state: int, letter: str) -> int:
        reached: dict[tuple[int, str], int] = {}

        def put(node: int, edits: int, swap: str = "") -> None:
            if node < 0 or edits <= self.most[node]:
                reached[node, swap] = min(edits, reached.get((node, swap), edits))

        for (node, swap), edits in self.sets[state]:
            if node < 0:
                put(node, edits)
            elif swap:
                if swap == letter:
                    put(node, edits)
            else:
                put(node, edits + 1)
                for own, child in self.children[node].items():
                    put(child, edits + (own != letter))
                    if own != letter and letter in self.children[child]:
                        put(self.children[child][letter], edits + 1, own)
        return self._number(reached)

    def match(self, word: str) -> tuple[int, int] | None:
        """The number of the entry that `word` stands for and the edits between them, or None."""
        if len(self.sets) > STATES:
            self._forget()
        state = self.start
        for letter in word:
            at = self.steps[state].get(letter)
            if at is None:
                at = self.steps[state][letter] = self._step(state, letter)
            state = at
            if not self.sets[state]:
                return None
        return self.found[state]
