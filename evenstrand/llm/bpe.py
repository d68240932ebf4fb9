"""Vectorised merge rounds of byte-pair encoding, over the symbols of many words laid end to end.

Each round finds the least pair rank of every word by a segmented minimum, merges the
leftmost pair of that rank in all words at once and compacts, until no pair remains.
Further pairs of the same rank are merged in the same round where the vocabulary shows
that this changes nothing: no pair that the new symbol can form ranks before it.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)


class Merges:
    """The pair table: pairs maps (left, right) to the merged symbol; ranks holds each symbol's rank, NONE if nothing merges to it."""

    def __init__(self, pairs: dict[tuple[int, int], int], ranks: np.ndarray):
        self.n = len(ranks)
        self.rank = np.append(ranks.astype(np.int32), NONE)
        by_key = sorted((left * self.n + right, to) for (left, right), to in pairs.items())
        self.keys, self.merged = np.array([k for k, _ in by_key], np.int64), np.array([m for _, m in by_key], np.int32)
        left, right = self.keys // self.n, self.keys % self.n
        self.safe = np.ones(self.n, bool)
        for part in (left, right):
            self.safe[part[self.rank[self.merged] <= self.rank[part]]] = False

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each two neighbours merge to, or n; symbols under 0 merge with none."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.merged[at], self.n).astype(np.int32)

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left, and the word of each, in order; word: ascending numbers."""
        pair = np.full(len(sym), self.n, np.int32)
        if len(sym) > 1:
            pair[:-1] = np.where(word[1:] == word[:-1], self.pairs(sym[:-1], sym[1:]), self.n)
        done_sym, done_word = [], []
        while len(sym):
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(head, len(sym)))
            rank = self.rank[pair]
            best = np.repeat(np.minimum.reduceat(rank, head), size)
            over = best == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, pair, rank, best = sym[~over], word[~over], pair[~over], rank[~over], best[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            lead = np.append(True, word[hit[1:]] != word[hit[:-1]])
            piece = pair[hit]
            first = piece[np.flatnonzero(lead)][np.cumsum(lead) - 1]
            hit = hit[lead | (self.safe[first] & (piece == first))]
            # of overlapping pairs (runs of one symbol) every other one from the left
            run = np.append(True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]]))
            begin = hit[np.flatnonzero(run)][np.cumsum(run) - 1]
            hit = hit[(hit - begin) % 2 == 0]
            sym[hit] = pair[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))  # where merged symbols stand after compaction
            sym, word, pair = sym[keep], word[keep], pair[keep]
            for at in (now, now[now > 0] - 1):
                nxt = np.minimum(at + 1, len(sym) - 1)
                pair[at] = np.where((at + 1 < len(sym)) & (word[nxt] == word[at]), self.pairs(sym[at], sym[nxt]), self.n)
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]
