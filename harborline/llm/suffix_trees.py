"""Suffix trees of number sequences and longest common extensions from them in constant time."""

from __future__ import annotations

import numpy as np

# Entries of the tour that share one cell of the minimum table.
BLOCK = 16


class RangeMinimum:
    """Minima of any stretch of ``values`` in constant time and memory of a few times their size."""

    def __init__(self, values: np.ndarray):
        rows = -(-len(values) // BLOCK)
        padded = np.full(rows * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        padded[: len(values)] = values
        blocks = padded.reshape(rows, BLOCK)
        self.values = padded
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        # levels[k][b]: least value of the blocks b to b + 2**k - 1.
        self.levels = [blocks.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= rows:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def query(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first] to values[last] for each pair, first <= last."""
        left, right = first // BLOCK, last // BLOCK
        found = np.minimum(self.onward[first], self.upto[last])
        inside = left == right
        if inside.any():
            places = left[inside, None] * BLOCK + np.arange(BLOCK)
            kept = (places >= first[inside, None]) & (places <= last[inside, None])
            found[inside] = np.where(kept, self.values[places], np.iinfo(self.values.dtype).max).min(axis=1)
        between = np.flatnonzero(right - left > 1)
        level = np.frexp(right[between] - left[between] - 1)[1] - 1
        for k in np.unique(level):
            some = between[level == k]
            table = self.levels[k]
            found[some] = np.minimum(found[some], np.minimum(table[left[some] + 1], table[right[some] - (1 << k)]))
        return found


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols``, whose last one must occur nowhere else, with its Euler tour.

    ``rank`` orders the suffixes; ``common`` gives the length of the longest common start of two of them, which is the
    string depth of the leaves' lowest common ancestor: the least depth on the tour between them.
    """

    def __init__(self, symbols: list[int]):
        starts, ends, kids = self.build(symbols)
        self.tour(symbols, starts, ends, kids)

    @staticmethod
    def build(symbols: list[int]) -> tuple[list[int], list[int], list[dict[int, int] | None]]:
        """Edge starts and ends and the children of each node; node 0 is the root, leaves have no children."""
        n = len(symbols)
        starts, ends, links, kids = [0], [0], [0], [{}]
        node = edge = length = waiting = 0
        for at, symbol in enumerate(symbols):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = at
                child = kids[node].get(symbols[edge])
                if child is None:
                    kids[node][symbols[edge]] = len(starts)
                    starts.append(at), ends.append(n), links.append(0), kids.append(None)
                    if unlinked:
                        links[unlinked] = node
                        unlinked = 0
                else:
                    span = min(ends[child], at + 1) - starts[child]
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    middle = starts[child] + length
                    if symbols[middle] == symbol:
                        length += 1
                        if unlinked:
                            links[unlinked] = node
                        break
                    split = len(starts)
                    kids[node][symbols[edge]] = split
                    starts += starts[child], at
                    ends += middle, n
                    links += 0, 0
                    kids += {symbol: split + 1, symbols[middle]: child}, None
                    starts[child] = middle
                    if unlinked:
                        links[unlinked] = split
                    unlinked = split
                waiting -= 1
                if node:
                    node = links[node]
                elif length:
                    length -= 1
                    edge = at - waiting + 1
        return starts, ends, kids

    def tour(self, symbols: list[int], starts: list[int], ends: list[int], kids: list[dict[int, int] | None]) -> None:
        n = len(symbols)
        depths, leaves, places = [0], [], []
        above = []
        depth, children = 0, iter([kids[0][c] for c in sorted(kids[0])])
        while True:
            for child in children:
                deeper = depth + ends[child] - starts[child]
                depths.append(deeper)
                if kids[child] is None:
                    leaves.append(n - deeper)
                    places.append(len(depths) - 1)
                    depths.append(depth)
                else:
                    above.append((depth, children))
                    depth, children = deeper, iter([kids[child][c] for c in sorted(kids[child])])
                    break
            else:
                if not above:
                    break
                depth, children = above.pop()
                depths.append(depth)
        order = np.array(leaves)
        self.rank = np.empty(n, "i8")
        self.rank[order] = np.arange(n)
        self.place = np.empty(n, "i8")
        self.place[order] = places
        self.minimum = RangeMinimum(np.array(depths, "i4"))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common starts of the suffixes at ``a`` and ``b``, a != b."""
        a, b = self.place[a], self.place[b]
        return self.minimum.query(np.minimum(a, b), np.maximum(a, b)).astype("i8")
