"""Many terms looked for in texts at once."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of one automaton; larger dictionaries are looked for in several passes.
TERMS = 50_000


class TermAutomaton:
    """Aho-Corasick: a trie of terms with links from each node to the longest proper ending that is a node too."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for number, term in enumerate(terms):
            node = 0
            for letter in term:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                node = self.next[node][letter]
            self.ends[node] += (number,)
        self.link = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            node = todo.popleft()
            for letter, child in self.next[node].items():
                todo.append(child)
                back = self.link[node]
                while back and letter not in self.next[back]:
                    back = self.link[back]
                self.link[child] = self.next[back].get(letter, 0)
                self.ends[child] += self.ends[self.link[child]]

    def found(self, text: str) -> set[int]:
        """The numbers of the terms that stand somewhere in a text."""
        node, out = 0, set()
        follow, link, ends = self.next, self.link, self.ends
        for letter in text:
            while node and letter not in follow[node]:
                node = link[node]
            node = follow[node].get(letter, 0)
            if ends[node]:
                out.update(ends[node])
        return out


def finder(terms: list[str]):
    """A function of a text column: the terms that stand in it."""
    automaton = TermAutomaton(terms)

    @F.pandas_udf("array<string>")
    def found(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: [automaton.terms[n] for n in automaton.found(t)])

    return found


def terms_found(texts: DataFrame, text: str, terms: DataFrame, term: str, at_once: int = TERMS) -> DataFrame:
    """The distinct terms that some text contains; an empty term is in every text, a null one in none. Each pass holds a
    bounded part of the dictionary, built once and sent to each task; texts aren't shuffled."""
    asked = terms.select(F.col(term).alias("term")).filter("term is not null").distinct()
    parts = -(-asked.count() // at_once)
    out = asked.filter("false")
    for k in range(parts):
        mine = sorted(r[0] for r in asked.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect())
        there = texts.filter(F.col(text).isNotNull())
        hits = there.select(F.explode(finder([t for t in mine if t])(F.col(text))).alias("term"))
        if "" in mine:
            hits = hits.unionByName(there.limit(1).select(F.lit("").alias("term")))
        out = out.unionByName(hits.distinct())
    return out
