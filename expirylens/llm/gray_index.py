"""A hierarchical index over fingerprints in Gray order, for searches within a few differing bits.

Fingerprints are sorted by their rank in Gray order, where neighbours differ in few bits. Every eight
neighbours share an upper node, eight of those the next one, up to one node for each group. A node keeps
the bits that all fingerprints below it share, less those that the nodes above have already. A search
walks down from the top and adds up, node by node, the shared bits in which the query differs. Where the
sum is over the limit, everything below is left out.
"""

from __future__ import annotations

import numpy as np

FAN = 8
# Node visits held at once; searches run in blocks of queries so that the walk stays below it.
VISITS = 1 << 21


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Ranks, in Gray order, of fingerprints given as rows of 64-bit words, the first word highest."""
    rank = words.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    # an odd number of ones in the words before turns a word's rank over
    odd = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64) & 1
    rank[:, 1:] ^= np.where(odd[:, :-1] == 1, ~np.uint64(0), np.uint64(0))
    return rank


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from start[i] on, size[i] of them, one range after the other."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    ends = np.cumsum(size)
    out[0] = start[0]
    out[ends[:-1]] = start[1:] - (start[:-1] + size[:-1]) + 1
    return np.cumsum(out)


class GrayIndex:
    """words: rows of 64-bit words; group: a number for each row. Searches stay inside a group."""

    def __init__(self, words: np.ndarray, group: np.ndarray):
        rank = gray_rank(words)
        self.order = np.lexsort(tuple(rank[:, k] for k in range(rank.shape[1] - 1, -1, -1)) + (group,))
        self.words, group = words[self.order], group[self.order]
        self.size = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)))
        ones, either = self.words, self.words
        first = np.arange(len(group))
        last, self.levels = first, []
        while not self.levels or len(first) > len(self.size):
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            place = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
            start = np.flatnonzero(place % FAN == 0)
            count = np.diff(np.append(start, len(group)))
            last = last[start + count - 1]
            ones, either = np.bitwise_and.reduceat(ones, start), np.bitwise_or.reduceat(either, start)
            self.levels.append({"start": start, "count": count, "last": last, "ones": ones, "shared": ~(ones ^ either)})
            group, first = group[start], first[start]
        for low, high in zip(self.levels, self.levels[1:], strict=False):
            parent = np.repeat(np.arange(len(high["start"])), high["count"])
            low["own"] = low["shared"] & ~high["shared"][parent]
        self.levels[-1]["own"] = self.levels[-1]["shared"]

    def pairs(self, limit: int):
        """Blocks of (i, j): rows of one group, in the given order, that differ in ``limit`` bits or fewer; each pair once."""
        top = np.repeat(np.arange(len(self.size)), self.size)
        room = np.repeat(self.size, self.size)
        ends = np.cumsum(room)
        at = 0
        while at < len(top):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + VISITS, "right")))
            q = np.arange(at, to)
            node, acc = top[at:to], np.zeros(to - at, np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                acc = acc + np.bitwise_count((self.words[q] ^ level["ones"][node]) & level["own"][node]).sum(1, dtype=np.int64)
                keep = (acc <= limit) & (level["last"][node] > q)
                q, node, acc = q[keep], node[keep], acc[keep]
                if not len(q):
                    break
                size = level["count"][node]
                rest = ~level["shared"][node] if depth == 0 else None
                q, acc = np.repeat(q, size), np.repeat(acc, size)
                if rest is not None:
                    rest = np.repeat(rest, size, axis=0)
                node = _ranges(level["start"][node], size)
            if len(q):
                keep = node > q
                q, node, acc, rest = q[keep], node[keep], acc[keep], rest[keep]
                near = acc + np.bitwise_count((self.words[q] ^ self.words[node]) & rest).sum(1, dtype=np.int64) <= limit
                if near.any():
                    yield self.order[q[near]], self.order[node[near]]
            at = to


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each a and b in a forest whose roots are the least numbers; flat before and after."""
    while True:
        a, b = parent[a], parent[b]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
