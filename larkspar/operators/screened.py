"""What tasks of the hierarchy do with blocks of unit vectors that meet: tile by tile, in memory that grows as the blocks do.

A tile's cosines are computed in single precision, and only what may matter, by a bound that includes what this takes from a
cosine, is computed in doubles.  So the neighbours and trees are those of all pairs.
"""

from __future__ import annotations

import numpy as np

from larkspar.operators.components import forest

#: Vectors of a tile's side, of a part of it with one bound, and at most of those that a first tree leads to.
TILE, PART, SEEDS = 2_048, 256, 1_024
#: Pairs whose cosines are computed one by one, at once; of more than this share of a tile they are read off its product.
AT_ONCE, SHARE = 65_536, 1 / 16
#: Edges of each vector that are kept beside the tree before they are merged into it.
BESIDE = 4


def to_distances(cosines: np.ndarray) -> np.ndarray:
    """In place."""
    np.round(cosines, 12, out=cosines)
    cosines *= -2
    cosines += 2
    return np.sqrt(np.maximum(cosines, 0.0, out=cosines), out=cosines)


def slack(x: np.ndarray) -> float:
    """More than single precision takes from the cosine of two unit vectors, and from a bound."""
    return (x.shape[1] + 8) * 2.0**-23


def cosines(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), AT_ONCE):
        to = at + AT_ONCE
        out[at:to] = np.einsum("ij,ij->i", x[i[at:to]], y[j[at:to]])
    return out


def prim(weights: np.ndarray) -> np.ndarray:
    """Edges (i, j) of the minimum spanning tree of a full graph, of equal weights those of smaller (least, greatest) numbers."""
    n = len(weights)
    best, code = np.full(n, np.inf), np.zeros(n, np.int64)
    open_, number, edges, j = np.ones(n, bool), np.arange(n), [], 0
    for _ in range(n - 1):
        open_[j] = False
        pair = np.minimum(number, j) * n + np.maximum(number, j)
        better = open_ & ((weights[j] < best) | ((weights[j] == best) & (pair < code)))
        best[better], code[better] = weights[j][better], pair[better]
        best[j] = np.inf
        tied = np.flatnonzero(open_ & (best == best[open_].min()))
        j = int(tied[code[tied].argmin()])
        edges.append(code[j])
    found = np.array(edges, np.int64)
    return np.column_stack((found // n, found % n))


class Closest:
    """Of each of x the k largest cosines with others that it met, in best; the least of them first."""

    def __init__(self, x: np.ndarray, place: np.ndarray, k: int):
        self.x, self.single, self.place, self.met = x, x.astype(np.float32), place, 0
        self.best = np.full((len(x), k), -np.inf)

    def meet(self, y: np.ndarray, place: np.ndarray) -> None:
        self.met += len(y)
        for at in range(0, len(y), TILE):
            tile, places = y[at : at + TILE], place[at : at + TILE]
            single = tile.astype(np.float32)
            for row in range(0, len(self.x), TILE):
                self.tile(slice(row, row + TILE), tile, single, places)

    def tile(self, rows: slice, y: np.ndarray, single: np.ndarray, places: np.ndarray) -> None:
        best, k = self.best[rows], self.best.shape[1]
        near = np.flatnonzero(self.single[rows] @ single.T >= (best[:, 0] - slack(y)).astype(np.float32)[:, None])
        if not len(near):
            return
        if len(near) > SHARE * len(best) * len(y):
            c = self.x[rows] @ y.T
            c[self.place[rows][:, None] == places[None, :]] = -np.inf
            best[:] = largest(np.concatenate([best, c], axis=1), k)
            return
        i, j = near // len(y), near % len(y)
        c = cosines(self.x[rows], i, y, j)
        kept = (c > best[i, 0]) & (self.place[rows][i] != places[j])
        if kept.any():
            row, at, count = np.unique(i[kept], return_index=True, return_counts=True)
            wide = np.full((len(row), k + count.max()), -np.inf)
            wide[:, :k] = best[row]
            wide[np.repeat(np.arange(len(row)), count), k + np.arange(count.sum()) - np.repeat(at, count)] = c[kept]
            best[row] = largest(wide, k)

    def distances(self, ranks: list[int]) -> np.ndarray:
        """To the rank-th closest of each, or to the farthest of fewer."""
        n = min(self.best.shape[1], self.met - 1)
        if n < 1:
            return np.zeros((len(self.x), len(ranks)))
        return to_distances(np.sort(self.best, axis=1)[:, [-min(r, n) for r in ranks]])


def largest(rows: np.ndarray, k: int) -> np.ndarray:
    return np.partition(rows, rows.shape[1] - k, axis=1)[:, rows.shape[1] - k :]


def lightest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which edges are the minimum spanning forest of n points, in the order of (w, a, b), by Boruvka rounds."""
    order = np.lexsort((b, a, w))
    u, v, rank, keep = a[order], b[order], np.arange(len(order)), np.zeros(len(order), bool)
    while len(u):
        best = np.full(n, len(order))
        np.minimum.at(best, u, rank)
        np.minimum.at(best, v, rank)
        taken = np.unique(best[best < len(order)])
        keep[taken] = True
        at = np.searchsorted(rank, taken)
        label = forest(n, u[at], v[at])
        u, v = label[u], label[v]
        open_ = u != v
        u, v, rank = u[open_], v[open_], rank[open_]
    return order[keep]


class Tree:
    """A spanning tree, edges a < b with weights w in the order of (w, a, b), that tells the heaviest edge between two points.

    Single linkage puts the points in a row where the edge that merges two runs stands between them: the heaviest edge on
    the tree's way between two points is the heaviest one that stands between them.
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        self.n, self.a, self.b, self.w, self.code = n, a, b, w, a * n + b
        up, size, head, tail, after, before = list(range(n)), [1] * n, list(range(n)), list(range(n)), [-1] * n, [-1] * n
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            while up[i] != i:
                up[i] = i = up[up[i]]
            while up[j] != j:
                up[j] = j = up[up[j]]
            if size[i] < size[j]:
                i, j = j, i
            after[tail[i]], before[head[j]] = head[j], k
            up[j], tail[i] = i, tail[j]
            size[i] += size[j]
        row, point = [], head[i] if len(a) else 0
        while point != -1:
            row.append(point)
            point = after[point]
        self.at = np.empty(n, np.int64)
        self.at[row] = np.arange(n)
        # heaviest[l, p]: of the 2^l edges that stand before places p, p + 1, ...
        levels = [np.array(before, np.int32)[row]]
        while 2 ** len(levels) < n:
            half, longer = 2 ** (len(levels) - 1), levels[-1].copy()
            longer[:-half] = np.maximum(longer[:-half], levels[-1][half:])
            levels.append(longer)
        self.heaviest = np.stack(levels)

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The heaviest edge's number, for points i and j that are different."""
        p, q = self.at[i], self.at[j]
        p, q = np.minimum(p, q) + 1, np.maximum(p, q)
        level = np.frexp((q - p + 1).astype(float))[1] - 1
        return np.maximum(self.heaviest[level, p], self.heaviest[level, q + 1 - (1 << level.astype(np.int64))])

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The heaviest edge's weight; 0 for a point and itself."""
        out, other = np.zeros(len(i)), i != j
        out[other] = self.w[self.between(i[other], j[other])]
        return out


class Forests:
    """For each column of core the minimum spanning tree of mutual reachability of those pairs that were met.

    A pair is an edge only if it is lighter than the heaviest one on the tree's way between its ends: else it is the heaviest of
    a cycle.  The first tree leads all vectors to some, and is replaced as lighter edges are found.
    """

    def __init__(self, x: np.ndarray, core: np.ndarray):
        self.x, self.single, self.core, self.n = x, x.astype(np.float32), core, len(x)
        self.trees = [Tree(self.n, *self.ordered(*e)) for e in self.first_edges()]
        self.beside = [[] for _ in self.trees]

    def ordered(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = lightest(self.n, a, b, w)
        return a[kept], b[kept], w[kept]

    def reach(self, d: np.ndarray, a: np.ndarray, b: np.ndarray, s: int) -> np.ndarray:
        return np.maximum(d, np.maximum(self.core[a, s], self.core[b, s]))

    def first_edges(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The tree of some vectors, and of each other one the edge to one of these that is about the lightest."""
        m = max(1, min(SEEDS, self.n // 32))
        some = np.arange(m) * self.n // m
        dense, d = (1 - self.core[some] ** 2 / 2).astype(np.float32), to_distances(self.x[some] @ self.x[some].T)
        to = np.empty((self.core.shape[1], self.n), np.int64)
        for at in range(0, self.n, TILE):
            c = self.single[at : at + TILE] @ self.single[some].T
            for s in range(len(to)):
                to[s, at : at + TILE] = some[np.minimum(c, dense[:, s]).argmax(1)]
        others, out = np.setdiff1d(np.arange(self.n), some), []
        for s in range(len(to)):
            i, j = prim(np.maximum(d, np.maximum(self.core[some, s][:, None], self.core[some, s][None, :]))).T
            i, j = np.r_[some[i], others], np.r_[some[j], to[s, others]]
            a, b = np.minimum(i, j), np.maximum(i, j)
            out.append((a, b, self.reach(to_distances(cosines(self.x, a, self.x, b)), a, b, s)))
        return out

    def merge(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [self.ordered(*(np.concatenate(c) for c in zip((t.a, t.b, t.w), *more, strict=True))) for t, more in zip(self.trees, self.beside, strict=True)]

    def replace(self) -> None:
        self.trees = [Tree(self.n, *e) for e in self.merge()]
        self.beside = [[] for _ in self.trees]

    def bounds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The least cosine that may matter for two points, at any size."""
        longest = np.max([t.bound(i, j) for t in self.trees], axis=0)
        return 1 - longest**2 / 2 - slack(self.x)

    def meet(self, i: np.ndarray, j: np.ndarray | None = None) -> None:
        """All pairs of points of i with points of j, which are others; or with each other, without j."""
        at = self.trees[-1].at
        i, j = (p[np.argsort(at[p])] if p is not None else None for p in (i, j))
        alone, j = j is None, i if j is None else j
        if not len(i) or not len(j):
            return
        middle = lambda p: p[np.minimum(np.arange(0, len(p), PART) + PART // 2, len(p) - 1)]
        left, right = middle(i), middle(j)

        def screens() -> tuple[np.ndarray, np.ndarray]:
            """The least cosine for rows of i and parts of j, and for points of j: by way of the middles of the parts."""
            ways = self.bounds(np.repeat(left, len(right)), np.tile(right, len(left))).reshape(len(left), -1)
            rows = np.minimum(np.repeat(ways, PART, axis=0)[: len(i)], self.bounds(i, np.repeat(left, PART)[: len(i)])[:, None])
            return rows.astype(np.float32), self.bounds(j, np.repeat(right, PART)[: len(j)]).astype(np.float32)

        of_row, of_column = screens()
        for row in range(0, len(i), TILE):
            for column in range(row if alone else 0, len(j), TILE):
                p, q = i[row : row + TILE], j[column : column + TILE]
                c = self.single[p] @ self.single[q].T
                near = c >= of_column[column : column + TILE]
                for part in range(0, len(q), PART):
                    near[:, part : part + PART] |= c[:, part : part + PART] >= of_row[row : row + TILE, (column + part) // PART][:, None]
                if alone and row == column:
                    near = np.triu(near, 1)
                near = np.flatnonzero(near)
                whole = self.x[p] @ self.x[q].T if len(near) > SHARE * c.size else None
                for at_ in range(0, len(near), AT_ONCE):
                    self.add(p, q, near[at_ : at_ + AT_ONCE], whole)
                if max(sum(len(w) for *_, w in more) for more in self.beside) > BESIDE * self.n:
                    self.replace()
                    of_row, of_column = screens()

    def add(self, p: np.ndarray, q: np.ndarray, near: np.ndarray, whole: np.ndarray | None) -> None:
        u, v = p[near // len(q)], q[near % len(q)]
        d = to_distances(cosines(self.x, u, self.x, v) if whole is None else whole.ravel()[near])
        a, b = np.minimum(u, v), np.maximum(u, v)
        for s, (tree, more) in enumerate(zip(self.trees, self.beside, strict=True)):
            w, e = self.reach(d, a, b, s), tree.between(a, b)
            less = np.flatnonzero((w < tree.w[e]) | ((w == tree.w[e]) & (a * self.n + b < tree.code[e])))
            if len(less):
                more.append((a[less], b[less], w[less]))
