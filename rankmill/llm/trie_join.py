"""Similarity join of one group of sets by a prefix tree."""

from __future__ import annotations

import numpy as np

CELLS = 16 << 20  # bytes of the membership table at a time


class Trie:
    """Sets as sequences of token numbers, stored in a tree with runs for edges.

    Built from the sets in lexicographic order: a node is a common prefix of
    neighbours. Per node: the run of tokens that leads to it, the sets that end
    in it, the most tokens that follow below, and the least size of a set below.
    """

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">i8").tobytes())
        self.run: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        self.ends: list[list[int]] = [[]]
        self.children: list[list[int]] = [[]]
        self.depth = [0]
        path = [0]
        before = np.zeros(0, dtype=np.int64)
        for i in order:
            sequence = sequences[i]
            n = min(len(before), len(sequence))
            differs = np.flatnonzero(before[:n] != sequence[:n])
            shared = int(differs[0]) if len(differs) else n
            last = None
            while self.depth[path[-1]] > shared:
                last = path.pop()
            top = path[-1]
            if self.depth[top] < shared:  # part the run that leads to `last`
                cut = shared - self.depth[top]
                middle = self._new(self.run[last][:cut], shared)
                self.children[top][self.children[top].index(last)] = middle
                self.children[middle].append(last)
                self.run[last] = self.run[last][cut:]
                path.append(middle)
                top = middle
            if len(sequence) > shared:
                leaf = self._new(sequence[shared:], len(sequence))
                self.children[top].append(leaf)
                path.append(leaf)
            self.ends[path[-1]].append(i)
            before = sequence
        self.follow = [0] * len(self.run)
        self.least = [np.iinfo(np.int64).max] * len(self.run)
        for node in self._bottom_up():
            for i in self.ends[node]:
                self.least[node] = min(self.least[node], int(sizes[i]))
            for child in self.children[node]:
                self.follow[node] = max(self.follow[node], len(self.run[child]) + self.follow[child])
                self.least[node] = min(self.least[node], self.least[child])

    def _new(self, run: np.ndarray, depth: int) -> int:
        self.run.append(run)
        self.ends.append([])
        self.children.append([])
        self.depth.append(depth)
        return len(self.run) - 1

    def _bottom_up(self) -> list[int]:
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            out.append(node)
            todo.extend(self.children[node])
        return out[::-1]


def numbered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Sets as ascending token numbers in one order for all: the most frequent first, tokens of one set left out."""
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(tokens), dtype=np.int64)
    number[order] = np.arange(len(tokens))
    n_shared = int((counts > 1).sum())
    number = number[inverse]
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for a, b in zip(cuts, cuts[1:]):
        mine = number[a:b]
        out.append(np.sort(mine[mine < n_shared]))
    return out, n_shared


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Fewest common tokens of sets of these sizes whose Jaccard similarity is `percent` or more."""
    return -(-(percent * (a + b)) // (100 + percent))


def linked_pairs(sets: list[np.ndarray], kinds: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (i, j), i < j, with 100 * intersection >= percent * union, of which not both are of kind 1 or both of kind 2.

    kinds: 0 pairs with everything. All queries walk the tree together: the
    common part of two paths is counted once, and below a node only queries go
    on that can still reach the least overlap with the smallest set there.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    sequences, n_tokens = numbered(sets)
    trie = Trie(sequences, sizes)
    width = max(16, CELLS // max(n_tokens, 1))
    found = []
    for first in range(0, len(sets), width):
        queries = np.arange(first, min(first + width, len(sets)))
        member = np.zeros((n_tokens, len(queries)), dtype=np.uint8)
        for column, q in enumerate(queries):
            member[sequences[q], column] = 1
        left = np.array([len(sequences[q]) for q in queries], dtype=np.int64)
        todo = [(0, np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64))]
        while todo:
            node, columns, overlap = todo.pop()
            for i in trie.ends[node]:
                hit = columns[100 * overlap >= percent * (sizes[queries[columns]] + sizes[i] - overlap)]
                q = queries[hit]
                q = q[(q < i) & ((kinds[q] == 0) | (kinds[q] != kinds[i]))]
                if len(q):
                    found.append(np.stack([q, np.full(len(q), i)], 1))
            for child in trie.children[node]:
                run = trie.run[child]
                gained = overlap + member[run][:, columns].sum(0, dtype=np.int64)
                reach = np.minimum(gained + trie.follow[child], left[columns])
                alive = reach >= least_overlap(sizes[queries[columns]], trie.least[child], percent)
                if alive.any():
                    todo.append((child, columns[alive], gained[alive]))
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
