"""Byte-pair merge rules as arrays: exact merging of one sequence, compatibility of many adjacent token pairs at once.

Two adjacent tokens are compatible when merging the symbols of both together ends in these two tokens. A sequence of
tokens is the result of merging if and only if all its adjacent pairs are compatible; this is what lets a guess be
verified pair by pair, and lets the last token of a prefix be found from the tokens of shorter prefixes.
"""

from __future__ import annotations

import heapq

import numpy as np

_NONE = 1 << 40
_LATE = np.int64(_NONE)


class Rules:
    """rank: order of creation of each token, -1 for base symbols; left, right: what its last merge joined, -1 for base."""

    def __init__(self, rank: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: dict[tuple[int, int], int]):
        self.rank, self.left, self.right, self.pairs = rank, left, right, pairs
        self.token_of = {int(rank[t]): t for t in pairs.values()}
        self.rank_of = {pair: int(rank[t]) for pair, t in pairs.items()}
        self.by_rank = np.full(max(self.token_of, default=0) + 1, -1, np.int64)
        self.by_rank[list(self.token_of)] = list(self.token_of.values())
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(pairs.values()), np.int64)[order]

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b merge into; late where there is none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[self.made[at]], _LATE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, undoes the merges on both sides of the seam from the latest to the earliest; a merge across the
        seam that would have come first refutes the pair."""
        unique, back = np.unique((a.astype(np.int64) << 32) | b.astype(np.int64), return_inverse=True)
        one, two = unique >> 32, unique & 0xFFFFFFFF
        good = np.ones(len(unique), bool)
        live, limit = np.arange(len(unique)), np.full(len(unique), _LATE)
        while len(live):
            refuted = self.joined(one, two) < limit
            good[live[refuted]] = False
            stay = ~refuted
            live, one, two, limit = live[stay], one[stay], two[stay], limit[stay]
            base1, base2 = self.left[one] < 0, self.left[two] < 0
            first = ~base1 & (base2 | (self.rank[one] > self.rank[two]))
            second = ~first & ~base2
            limit = np.where(first, self.rank[one], np.where(second, self.rank[two] + 1, limit))
            one, two = np.where(first, self.right[one], one), np.where(second, self.left[two], two)
            stay = first | second
            live, one, two, limit = live[stay], one[stay], two[stay], limit[stay]
        return good[back]

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: the earliest rule first, its leftmost place first."""
        if len(symbols) > 64:
            return self._merge_long(symbols)
        get, token = self.rank_of.get, list(symbols)
        ranks = [get(pair, _NONE) for pair in zip(token, token[1:])]
        while ranks:
            first = min(ranks)
            if first == _NONE:
                break
            i = ranks.index(first)
            token[i : i + 2] = [self.token_of[first]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((token[i - 1], token[i]), _NONE)
            if i < len(ranks):
                ranks[i] = get((token[i], token[i + 1]), _NONE)
        return token

    def merge_all(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Exact merging of many short sequences, each step of all of them at once."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(starts)
        size = ends - starts
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 24), (24, 64)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if not len(rows):
                continue
            place = np.arange(high)[None] < size[rows][:, None]
            token = np.full((len(rows), high), -1, np.int64)
            token[place] = symbols[(starts[rows][:, None] + np.arange(high)[None])[place]]
            rank = self._ranks(token[:, :-1], token[:, 1:])
            while len(rows):
                at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
                first = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), _LATE)
                done = first == _LATE
                for i in np.flatnonzero(done).tolist():
                    out[rows[i]] = token[i][token[i] >= 0]
                on = ~done
                rows, token, rank, at, first = rows[on], token[on], rank[on], at[on], first[on]
                if not len(rows):
                    break
                each = np.arange(len(rows))
                token[each, at] = self.by_rank[first]
                column = np.arange(token.shape[1] - 1)[None]
                token = np.take_along_axis(token, column + (column > at[:, None]), axis=1)
                column = column[:, :-1]
                rank = np.take_along_axis(rank, column + (column >= at[:, None]), axis=1)
                for shift in (-1, 0):
                    i = at + shift
                    ok = (i >= 0) & (i < rank.shape[1])
                    rank[each[ok], i[ok]] = self._ranks(token[each[ok], i[ok]], token[each[ok], i[ok] + 1])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, late where a side is missing."""
        return np.where((a < 0) | (b < 0), _LATE, self.joined(np.maximum(a, 0), np.maximum(b, 0)))

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of places, for sequences of any length."""
        n, token = len(symbols), list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                rank = self.rank_of.get((token[i], token[after[i]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, token[i], token[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = self.token_of[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [t for t in token if t >= 0]


class Trie:
    """Symbol sequences of tokens; steps many lanes at once through a sorted table of edges."""

    def __init__(self, sequences: list[tuple[list[int], int]], symbols: int):
        self.symbols = symbols
        edges: dict[int, int] = {}
        token = [-1]
        for sequence, t in sequences:
            node = 0
            for s in sequence:
                key = node * symbols + s
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(token)
                    token.append(-1)
                node = nxt
            token[node] = t
        self.edges, self.token = edges, np.array(token, np.int64)
        self.keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(self.keys)
        self.keys, self.nodes = self.keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The nodes reached, -1 where there is no edge."""
        key = nodes * self.symbols + symbols
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1)
