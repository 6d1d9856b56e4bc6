"""Exact nearest rows over few columns: a search tree for every set of shared columns.

Rows that lack the same columns have the same columns in common with donors that lack the same ones, so for such a pair of patterns the distance is one
in a space of those columns alone. A task holds a shard of the donors, cuts those of each pattern by a tree in that space, and looks up the
distinct places of its rows in it: boxes that are beyond the nearest found so far are not read. Donors in one place count by the lower id.
"""

import numpy as np

ROUNDING = 9
LEAF = 16
AT_A_TIME = 4096  # places that are looked up together


class Space:
    """Distinct places of donors, with the first ``most`` of their rows each, below a full binary tree of boxes."""

    def __init__(self, x: np.ndarray, most: int):
        order = np.lexsort(x.T[::-1])  # stable: rows of one place stay in order
        own = x[order]
        starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(1)])
        counts = np.diff(np.r_[starts, len(own)])
        points, n = own[starts], len(starts)
        self.height = max(0, (n // LEAF).bit_length() - 1)
        place = np.arange(n)
        self.low, self.high = [], []
        for level in range(self.height + 1):
            edges = (np.arange(1 << level) * n) >> level
            low, high = (f.reduceat(points[place], edges) for f in (np.minimum, np.maximum))
            self.low.append(low)
            self.high.append(high)
            if level < self.height:
                node = np.repeat(np.arange(1 << level), np.diff(np.r_[edges, n]))
                column = (high - low).argmax(1)
                place = place[np.lexsort((points[place, column[node]], node))]
        self.edges = np.r_[edges, n]
        self.points = points[place]
        self.first, self.count = starts[place], np.minimum(counts[place], most)
        self.rows = order

    def least(self, x: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low[level][node] - x, x - self.high[level][node]), 0.0)
        return (gap * gap).sum(1) / x.shape[1]

    def distances(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = 0.0
        for c in range(x.shape[1]):
            total = total + (x[:, c] - self.points[at, c]) ** 2
        return (total / x.shape[1]).round(ROUNDING)

    def members(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``leaf``, point) of all points of some leaves."""
        start, size = self.edges[leaf], self.edges[leaf + 1] - self.edges[leaf]
        of = np.repeat(np.arange(len(leaf)), size)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of]

    def nearest(self, x: np.ndarray, limit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, distance, donor row) of the ``most`` nearest up to each row's limit, in order; of equal distances the first donors."""
        parts = [self._nearest(x[i:i + AT_A_TIME], limit[i:i + AT_A_TIME], most, i) for i in range(0, len(x), AT_A_TIME)]
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _nearest(self, x, limit, most, offset):
        who, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(1, self.height + 1):  # the likeliest leaf, for a first bound
            a, b = (self.least(x, level, 2 * node + i) for i in (0, 1))
            node = 2 * node + (b < a)
        if len(self.points) >= most:
            of, at = self.members(node)
            distance = self.distances(x[of], at)
            order = np.lexsort((distance, of))
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            limit = np.minimum(limit, distance[order][rank == most - 1])
        slack = limit + 10.0 ** -ROUNDING + 1e-12 * limit
        node = np.zeros(len(x), np.int64)
        for level in range(self.height + 1):
            if level:
                who, node = np.repeat(who, 2), (2 * node[:, None] + [0, 1]).ravel()
            near = self.least(x[who], level, node) <= slack[who]
            who, node = who[near], node[near]
        of, at = self.members(node)
        who = who[of]
        distance = self.distances(x[who], at)
        near = distance <= limit[who]
        who, at, distance = who[near], at[near], distance[near]
        # the nearest places hold enough rows; those as far as the last of them count too
        order = np.lexsort((distance, who))
        who, at, distance = who[order], at[order], distance[order]
        first = np.searchsorted(who, who)
        last = np.minimum(first + most - 1, np.searchsorted(who, who, side="right") - 1)
        near = distance <= distance[last]
        who, at, distance = who[near], at[near], distance[near]
        size = self.count[at]
        of = np.repeat(np.arange(len(at)), size)
        row = self.rows[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + self.first[at][of]]
        who, distance = who[of], distance[of]
        order = np.lexsort((row, distance, who))
        who, distance, row = who[order], distance[order], row[order]
        near = np.arange(len(who)) - np.searchsorted(who, who) < most
        return who[near] + offset, distance[near], row[near]


def by_pattern(x: np.ndarray) -> dict[int, np.ndarray]:
    """{columns that are there, as bits: row numbers}"""
    pattern = (~np.isnan(x)) @ (1 << np.arange(x.shape[1]))
    order = np.argsort(pattern, kind="stable")
    values, starts = np.unique(pattern[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order, starts[1:])))


class Shard:
    """Donors by the columns they have; rows in order of their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.parts = sorted(by_pattern(self.x).items(), key=lambda p: -len(p[1]))
        self.same = int(np.unique(ids, return_counts=True)[1].max(initial=1))  # rows of one id, none of which is a donor of its own

    def found(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple:
        """(id, feature, distance, donor, value) of the k nearest donors of every missing cell, as columns."""
        out = [[] for _ in range(5)]
        for pattern, rows in by_pattern(x).items():
            lacks = [c for c in range(x.shape[1]) if not pattern >> c & 1]
            best = {c: (np.full((len(rows), k), np.inf), np.full((len(rows), k), len(self.ids))) for c in lacks}  # distances, donor rows
            for has, donors in self.parts:
                columns, gained = [c for c in range(x.shape[1]) if pattern & has & 1 << c], [c for c in lacks if has >> c & 1]
                if columns and gained:
                    self._joined(best, gained, ids[rows], x[np.ix_(rows, columns)], donors, columns, k)
            for c, (distance, donor) in best.items():
                i, j = np.nonzero(np.isfinite(distance))
                d = donor[i, j]
                for column, cells in zip(out, (ids[rows[i]], np.full(len(i), c, np.int32), distance[i, j], self.ids[d], self.x[d, c])):
                    column.append(cells)
        return tuple(np.concatenate(c) if c else np.array([]) for c in out)

    def _joined(self, best, gained, ids, x, donors, columns, k):
        """Takes the donors of one pattern into the best so far of the missing columns that they have."""
        order = np.lexsort(x.T[::-1])
        new = np.r_[True, (x[order][1:] != x[order][:-1]).any(1)]
        places, of = x[order][new], np.empty(len(x), np.int64)
        of[order] = np.cumsum(new) - 1
        limit = np.full(len(places), -1.0)
        np.maximum.at(limit, of, np.max([best[c][0][:, -1] for c in gained], 0))
        most = k + self.same
        who, distance, row = Space(self.x[np.ix_(donors, columns)], most).nearest(places, limit, most)
        near, at = np.full((len(places), most), np.inf), np.full((len(places), most), len(self.ids))
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        near[who, rank], at[who, rank] = distance, donors[row]
        names = np.r_[self.ids, 0]
        least = near[of, 0]
        for c in gained:
            was, donor = best[c]
            i = np.flatnonzero(np.isfinite(least) & (least <= was[:, -1]))
            d, r = near[of[i]], at[of[i]]
            d = np.where(names[r] == ids[i, None], np.inf, d)
            d, r = np.concatenate([was[i], d], 1), np.concatenate([donor[i], r], 1)
            order = np.lexsort((r, d), axis=1)[:, :k]  # donor rows are in order of their ids
            was[i], donor[i] = np.take_along_axis(d, order, 1), np.take_along_axis(r, order, 1)
