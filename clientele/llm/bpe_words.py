"""The dynamic programme of ``bpe`` for many words at once, in arrays.

All words stand in a row, each with its end mark. From every place the tokens that begin there are
found in a tree of the vocabulary; they are then taken by their distance from the word's start. A
token whose left neighbour is the last token of the prefix before it, and compatible with it, is the
last token of its own prefix. Back-pointers from the words' ends give the tokens. The compatibility
of pairs met before stands in a table of fixed size, where a pair takes the place of an older one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: The end mark's number; the others are bytes.
MARK = 256
#: Places for pairs of tokens; 9 MB.
PAIRS = 1 << 20


class Pieces:
    """Tokens of words, from the ids, the merges and the usable tokens of a ``bpe.Vocabulary``."""

    def __init__(self, vocabulary, letters: dict[int, str], end: str) -> None:
        ids = vocabulary.ids
        size = max(ids.values()) + 1
        byte = {x: b for b, x in letters.items()} | {end: MARK}
        edges: dict[int, int] = {}
        token_of, self.length = [-1], np.zeros(size, np.int64)
        for token, number in ids.items():
            if not vocabulary._reachable(token):
                continue
            node, self.length[number] = 0, len(token)
            for x in token:
                key = node << 9 | byte[x]
                node = edges.get(key)
                if node is None:
                    node = edges[key] = len(token_of)
                    token_of.append(-1)
            token_of[node] = number
        # a node's number is its edge's place among the edges, and 1
        self.token_of, self.edges = np.array(token_of, np.int32), pd.Index(np.fromiter(edges, np.int64))
        self.roots = self._child(np.arange(MARK + 1))
        self.seconds = self._child(self.roots[:, None] << 9 | np.arange(512)).astype(np.int32) * (self.roots[:, None] > 0)
        self.rank, self.sides = np.full(size, -1, np.int64), np.full((2, size), -1, np.int64)
        for token, (rank, *sides) in vocabulary.made_of.items():
            if token in ids:
                self.rank[ids[token]], self.sides[:, ids[token]] = rank, [ids[x] for x in sides]
        self.merges = pd.Index(np.array([ids[a] << 16 | ids[b] for a, b in vocabulary.ranks], np.int64))
        self.ranks = np.fromiter(vocabulary.ranks.values(), np.int64)
        self.pairs, self.fit = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def _child(self, key: np.ndarray) -> np.ndarray:
        """The nodes behind edges; 0 if there is none."""
        return (self.edges.get_indexer(key.ravel()) + 1).reshape(key.shape)

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary._fits`` for pairs: no merge joins symbols across the border while both live."""
        fits, never = np.ones(len(left), bool), len(self.ranks) + 1
        outer, a, a_ends = np.arange(len(left)), left, np.full(len(left), never)
        while len(outer):
            inner, b, b_ends = np.arange(len(outer)), right[outer], np.full(len(outer), never)
            while len(inner):
                at = self.merges.get_indexer(a[inner] << 16 | b)
                rank = np.where(at < 0, never, self.ranks[at])
                fits[outer[inner[(rank < a_ends[inner]) & (rank <= b_ends) & (at >= 0)]]] = False
                inner, b, b_ends = (x[self.rank[b] >= 0] for x in (inner, self.sides[0, b], self.rank[b]))
            outer, a, a_ends = (x[self.rank[a] >= 0] for x in (outer, self.sides[1, a], self.rank[a]))
        return fits

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 16 | right.astype(np.int64)
        place = (pair * 0x9E3779B1 >> 20) & (PAIRS - 1)
        fit, new = self.fit[place], np.flatnonzero(self.pairs[place] != pair)
        if len(new):
            pair, back = np.unique(pair[new], return_inverse=True)
            found = self._compatible(pair >> 16, pair & 0xFFFF)
            fit[new] = found[back]
            place = (pair * 0x9E3779B1 >> 20) & (PAIRS - 1)
            # of pairs with one place the last one stays, in both arrays
            place, last = np.unique(place[::-1], return_index=True)
            self.pairs[place], self.fit[place] = pair[::-1][last], found[::-1][last]
        return fit

    def _tokens(self, marks: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, end and token of all tokens in the words, by their distance from the word's start."""
        at, found = np.arange(len(marks) - 1, dtype=np.int32), []
        node = self.roots[marks[:-1]]
        for depth in range(1, int(self.length.max()) + 1):
            if depth == 2:
                node = self.seconds[marks[at], marks[at + 1]]
            elif depth > 2:
                node = self._child(node.astype(np.int64) << 9 | marks[at + depth - 1])
            at, node = at[node > 0], node[node > 0]
            token = self.token_of[node]
            # what ends before the end mark leaves the mark over
            hit = (token >= 0) & (marks[at + depth] != MARK)
            found.append((at[hit], at[hit] + depth, token[hit]))
        at, end, token = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(inside[at], kind="stable")
        return at[order], end[order], token[order]

    def ids(self, letters: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and how many each word has; ``letters`` are the words' bytes, ``borders`` where they start, and their end."""
        count = len(borders) - 1
        begins = borders[:-1] + np.arange(count)
        ends = borders[1:] + np.arange(1, count + 1)
        marks = np.insert(letters.astype(np.int64), borders[1:], MARK)
        inside = (np.arange(len(marks)) - np.repeat(begins, ends - begins)).astype(np.uint16)
        at, end, token = self._tokens(np.append(marks, 0), inside)
        last = np.full(len(marks) + 1, -1, np.int64)
        steps = np.searchsorted(inside[at], np.arange(int(inside.max(initial=0)) + 2).astype(np.uint16))
        last[end[: steps[1]]] = token[: steps[1]]
        for a, z in zip(steps[1:-1], steps[2:]):
            before = last[at[a:z]]
            known = np.flatnonzero(before >= 0) + a
            known = known[self.fits(before[known - a], token[known])]
            last[end[known]] = token[known]
        chosen = np.full(len(marks), -1, np.int64)
        back, begin = ends, begins
        while len(back):
            token = last[back]
            if (token < 0).any():
                raise ValueError("the vocabulary cannot write every word")
            back = back - self.length[token]
            chosen[back] = token
            back, begin = back[back > begin], begin[back > begin]
        sums = np.concatenate([[0], np.cumsum(chosen >= 0)])
        return chosen[chosen >= 0].astype("<u2"), sums[ends] - sums[begins]
