"""Numerical kernels in numpy: the parts that no relational operator expresses."""

from __future__ import annotations

import warnings

import numpy as np

# ---------------------------------------------------------------- factorisation


INITS = ("random", "nndsvd", "nndsvda", "nndsvdar")
LOSSES = ("frobenius", "kullback-leibler", "itakura-saito")


def hashed_normals(seed: int, ids: np.ndarray, k: int) -> np.ndarray:
    """Standard normal values by (seed, id, column): the same wherever a row lies."""
    x = ids.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(2 * k, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed & 0xFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
    return np.sqrt(-2 * np.log(u[:, :k])) * np.cos(2 * np.pi * u[:, k:])


def singular_parts(v: np.ndarray, s: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the non-negative start: which sign of each singular pair is taken, the factor of its left
    part, and h. positive, negative: squared sizes of the left vectors' parts; v: right vectors as rows."""
    k = len(s)
    sign, factor, h = np.ones(k), np.zeros(k), np.zeros_like(v)
    for j in range(k):
        if j == 0:  # all of one sign but for rounding
            sign[0], factor[0], h[0] = 0, np.sqrt(s[0]), np.sqrt(s[0]) * np.abs(v[0])
            continue
        parts = [(np.sqrt(size), np.maximum(g * v[j], 0), g) for g, size in ((1, positive[j]), (-1, negative[j]))]
        a, b, g = max(parts, key=lambda p: p[0] * np.linalg.norm(p[1]))
        n = np.linalg.norm(b)
        if a > 0 and n > 0:
            scale = np.sqrt(s[j] * a * n)
            sign[j], factor[j], h[j] = g, scale / a, scale * b / n
    return sign, factor, h


def left_start(u: np.ndarray, sign: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The rows of w that belong to rows of the left vectors `u`."""
    return np.where(sign == 0, np.abs(u), np.maximum(u * sign, 0)) * factor


def fill_zeros(m: np.ndarray, mean: float, fill: str, seed: int, ids: np.ndarray) -> np.ndarray:
    """Zeros stay ("zero"), become the mean ("mean") or small random values ("random")."""
    m = np.where(m < 1e-6, 0, m)
    if fill == "zero":
        return m
    return np.where(m == 0, mean if fill == "mean" else np.abs(mean * hashed_normals(seed, ids, m.shape[1])) / 100, m)


FILLS = {"nndsvd": "zero", "nndsvda": "mean", "nndsvdar": "random"}


def nmf_start(x: np.ndarray, k: int, init: str, seed: int, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start of w and h; ids: what names the rows to random numbers."""
    ids = np.arange(len(x)) if ids is None else ids
    genes = np.arange(x.shape[1])
    if init == "random":
        scale = np.sqrt(x.mean() / k)
        return np.abs(scale * hashed_normals(seed, ids, k)), np.abs(scale * hashed_normals(seed + 1, genes, k)).T
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    u, s, vt = u[:, :k], s[:k], vt[:k]
    sign, factor, h = singular_parts(vt, s, (np.maximum(u, 0) ** 2).sum(0), (np.maximum(-u, 0) ** 2).sum(0))
    return fill_zeros(left_start(u, sign, factor), x.mean(), FILLS[init], seed, ids), fill_zeros(h.T, x.mean(), FILLS[init], seed + 1, genes).T


def _sweep(a: np.ndarray, gram: np.ndarray, cross: np.ndarray, l1: float, l2: float) -> float:
    """One pass of coordinate descent over the columns of a >= 0; returns the projected gradient's size."""
    moved = 0.0
    for j in range(a.shape[1]):
        grad = a @ gram[:, j] - cross[:, j] + l1 + l2 * a[:, j]
        moved += np.abs(np.where(a[:, j] == 0, np.minimum(0, grad), grad)).sum()
        curve = gram[j, j] + l2
        if curve > 0:
            a[:, j] = np.maximum(a[:, j] - grad / curve, 0)
    return moved


_TINY = 1e-12


def nmf_rows(x: np.ndarray, w: np.ndarray, h: np.ndarray, solver: str, loss: str, l1: float, l2: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """New w of a block of rows, and what the block adds to the sums that nmf_columns() needs."""
    w = w.copy()
    if solver == "cd":
        moved = _sweep(w, h @ h.T, x @ h.T, l1, l2)
        return w, [w.T @ w, w.T @ x, np.array([moved])]
    if loss == "frobenius":
        w *= (x @ h.T) / (w @ (h @ h.T) + l1 + l2 * w + _TINY)
        return w, [w.T @ w, w.T @ x]
    if loss == "kullback-leibler":
        w *= ((x / (w @ h + _TINY)) @ h.T) / (h.sum(1) + l1 + l2 * w + _TINY)
        return w, [w.sum(0), w.T @ (x / (w @ h + _TINY))]
    y = w @ h + _TINY  # itakura-saito
    w *= np.sqrt(((x / y**2) @ h.T) / ((1 / y) @ h.T + l1 + l2 * w + _TINY))
    y = w @ h + _TINY
    return w, [w.T @ (1 / y), w.T @ (x / y**2)]


def nmf_columns(h: np.ndarray, sums: list[np.ndarray], solver: str, loss: str, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """New h from the sums over all rows, and how far both steps moved (cd)."""
    if solver == "cd":
        ht = np.ascontiguousarray(h.T)
        moved = _sweep(ht, sums[0], np.ascontiguousarray(sums[1].T), l1, l2)
        return ht.T, float(sums[2][0]) + moved
    if loss == "frobenius":
        return h * (sums[1] / (sums[0] @ h + l1 + l2 * h + _TINY)), 0.0
    if loss == "kullback-leibler":
        return h * (sums[1] / (sums[0][:, None] + l1 + l2 * h + _TINY)), 0.0
    return h * np.sqrt(sums[1] / (sums[0] + l1 + l2 * h + _TINY)), 0.0


def nmf_error(x: np.ndarray, w: np.ndarray, h: np.ndarray) -> float:
    """Squared distance of a block."""
    return float(((x - w @ h) ** 2).sum())


class Convergence:
    """When to stop: by the step relative to the first (cd), or by the error's gain every tenth round (mu)."""

    def __init__(self, solver: str, tol: float, max_iter: int):
        self.solver, self.tol, self.max_iter, self.round, self.done = solver, tol, max_iter, 0, max_iter < 1
        self.first: float | None = None
        self.last: float | None = None

    def stepped(self, moved: float) -> None:
        self.round += 1
        if self.solver == "cd":
            self.first = moved if self.first is None else self.first
            self.done = self.first == 0 or moved / self.first <= self.tol
        self.done = self.done or self.round >= self.max_iter

    def wants_error(self) -> bool:
        return self.solver == "mu" and self.round % 10 == 0 and self.round > 0

    def told(self, squares: float) -> None:
        e = float(np.sqrt(squares))
        self.first = e if self.first is None else self.first
        if self.last is not None and (self.last - e) / max(self.first, _TINY) < self.tol:
            self.done = True
        self.last = e


def penalties(alpha: float, l1_ratio: float, size: int) -> tuple[float, float]:
    return alpha * l1_ratio * size, alpha * (1 - l1_ratio) * size


def check_nmf(n: int, m: int, k: int, solver: str, loss: str, init: str) -> None:
    if init not in INITS:
        raise ValueError(f"init must be one of {INITS}")
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    if solver not in ("cd", "mu"):
        raise ValueError("solver must be 'cd' or 'mu'")
    if init.startswith("nndsvd") and k > min(n, m):
        raise ValueError(f"k={k} exceeds the least side of a {n} x {m} block")


def nmf(x: np.ndarray, k: int, solver: str = "cd", loss: str = "frobenius", init: str = "nndsvda", alpha: float = 0.0, l1_ratio: float = 0.0, tol: float = 1e-5, max_iter: int = 10000, seed: int = 123, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x ~ w @ h, all >= 0, of one block of rows."""
    n, m = x.shape
    check_nmf(n, m, k, solver, loss, init)
    if not x.any():
        return np.zeros((n, k)), np.zeros((k, m))
    w, h = nmf_start(x, k, init, seed, ids)
    until = Convergence(solver, tol, max_iter)
    while not until.done:
        w, sums = nmf_rows(x, w, h, solver, loss, *penalties(alpha, l1_ratio, m))
        h, moved = nmf_columns(h, sums, solver, loss, *penalties(alpha, l1_ratio, n))
        until.stepped(moved)
        if until.wants_error():
            until.told(nmf_error(x, w, h))
    return w, h


# ---------------------------------------------------------------- assignment


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one pairs of greatest total gain (shortest augmenting paths with potentials)."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for r in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, j, base = r, -1, 0.0
        while True:
            slack = base + cost[i] - row_price[i] - col_price
            better = ~done & (slack < dist)
            dist[better], back[better] = slack[better], j
            j = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[j] = dist[j], True
            if owner[j] < 0:
                break
            i = owner[j]
        row_price[r] += base
        for c in np.flatnonzero(done & (np.arange(m) != j)):
            row_price[owner[c]] += base - dist[c]
            col_price[c] -= base - dist[c]
        while j >= 0:
            p = back[j]
            owner[j] = owner[p] if p >= 0 else r
            j = p
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


# ---------------------------------------------------------------- trees and display order


def linkage_tree(distance: np.ndarray, method: str = "average"):
    """Nested pairs of leaf numbers, by repeatedly joining the two nearest clusters."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    tree: dict[int, object] = dict(enumerate(range(n)))
    size = np.ones(n)
    alive = np.ones(n, bool)
    for _ in range(n - 1):
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        i, j = min(i, j), max(i, j)
        tree[i] = (tree[i], tree.pop(j))
        a, b = d[i], d[j]
        if method == "single":
            new = np.minimum(a, b)
        elif method == "complete":
            new = np.maximum(a, b)
        elif method == "ward":
            t = size[i] + size[j] + size
            new = np.sqrt(np.maximum(0, ((size[i] + size) * a**2 + (size[j] + size) * b**2 - size * d[i, j] ** 2) / t))
        else:
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        alive[j] = False
        new = np.where(alive, new, np.inf)
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return tree[0] if n else ()


def optimal_leaf_order(tree, distance: np.ndarray) -> list[int]:
    """The order of the tree's leaves, by flips alone, of least total distance between neighbours.

    Per node the least cost of every pair of outer leaves, by two min-plus products: cubic in the leaves."""
    if tree == ():
        return []
    nodes: dict[int, tuple] = {}  # by id of the subtree: leaves of the left and right part, costs of outer pairs
    todo = [(tree, False)]
    while todo:
        node, ready = todo.pop()
        if not isinstance(node, tuple):
            nodes[id(node), node] = (np.array([node]), None, np.zeros((1, 1)))
            continue
        if not ready:
            todo += [(node, True), (node[0], False), (node[1], False)]
            continue
        (la, _, lc), (ra, _, rc) = (nodes[_key(n)] for n in node)
        inner = _min_plus(_min_plus(lc, distance[np.ix_(la, ra)]), rc)
        cost = np.full((len(la) + len(ra),) * 2, np.inf)
        cost[: len(la), len(la) :] = inner
        cost[len(la) :, : len(la)] = inner.T
        nodes[_key(node)] = (np.concatenate([la, ra]), (len(la),), cost)

    leaf, _, cost = nodes[_key(tree)]
    if len(leaf) == 1:
        return [int(leaf[0])]
    first, last = np.unravel_index(int(np.argmin(cost)), cost.shape)
    out: list[int] = []
    todo = [(tree, int(leaf[first]), int(leaf[last]))]
    while todo:
        node, i, j = todo.pop()
        if not isinstance(node, tuple):
            out.append(node)
            continue
        left, right = node
        if i not in nodes[_key(left)][0]:
            left, right = right, left
        (la, _, lc), (ra, _, rc) = nodes[_key(left)], nodes[_key(right)]
        total = lc[np.flatnonzero(la == i)[0]][:, None] + distance[np.ix_(la, ra)] + rc[:, np.flatnonzero(ra == j)[0]][None]
        a, b = np.unravel_index(int(np.argmin(total)), total.shape)
        todo += [(right, int(ra[b]), j), (left, i, int(la[a]))]
    return out


def _key(node):
    return (id(node), node if not isinstance(node, tuple) else None)


def _min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), b.shape[1]))
    for i in range(len(a)):
        out[i] = (a[i][:, None] + b).min(0)
    return out


# ---------------------------------------------------------------- clustering


class Merges:
    """Average-linkage merges of `s`, best pair first; the sequence is found once for all thresholds.

    Each row keeps its best partner, so a merge looks at one row and at rows whose partner went.
    The cap of 10,000 merges is that of the method as published by its users."""

    def __init__(self, s: np.ndarray, samples: np.ndarray, inter_only: bool = False, most: int = 10_000):
        n = len(s)
        pairs = (samples[:, None] != samples[None, :]).astype(float) if inter_only else np.ones((n, n))
        total = s * pairs
        self.steps: list[tuple[int, int, float]] = []
        mean = self._mean(total, pairs)
        np.fill_diagonal(mean, -np.inf)
        best = mean.argmax(1) if n else np.empty(0, np.int64)
        high = mean[np.arange(n), best]
        for _ in range(min(most, max(0, n - 1))):
            i = int(np.argmax(high))
            if high[i] == -np.inf:
                break
            j = int(best[i])
            self.steps.append((min(i, j), max(i, j), float(high[i])))
            i, j = min(i, j), max(i, j)
            for a in (total, pairs):
                a[i] += a[j]
                a[:, i] += a[:, j]
            row = self._mean(total[i], pairs[i])
            dead = mean[i] == -np.inf
            row[dead], row[j], row[i] = -np.inf, -np.inf, -np.inf
            mean[i] = mean[:, i] = row
            mean[j] = mean[:, j] = -np.inf
            stale = np.flatnonzero((best == i) | (best == j))
            for k in np.union1d(stale, [i, j]):
                best[k] = mean[k].argmax()
                high[k] = mean[k, best[k]]
            better = (row > high) | ((row == high) & (i < best))
            best[better], high[better] = i, row[better]

    @staticmethod
    def _mean(total: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        return np.divide(total, pairs, out=np.zeros_like(total), where=pairs > 0)

    def labels(self, n: int, threshold: float) -> np.ndarray:
        """Label per row after the merges before the first at or below `threshold`."""
        out = np.arange(n)
        for i, j, mean in self.steps:
            if mean <= threshold:
                break
            out[out == j] = i
        return out


def centroid_clusters(s: np.ndarray, samples: np.ndarray, threshold: float, min_cluster: int, inter_only: bool = False, known: dict | None = None) -> np.ndarray:
    """Labels, -1 for dropped rows: clusters of fewer than min_cluster samples go and merging restarts.
    known: merges by the rows they are of, shared between thresholds."""
    known = {} if known is None else known
    keep = np.arange(len(s))
    while len(keep):
        if keep.tobytes() not in known:
            known[keep.tobytes()] = Merges(s[np.ix_(keep, keep)], samples[keep], inter_only)
        labels = known[keep.tobytes()].labels(len(keep), threshold)
        few = np.array([len(set(samples[keep][labels == c])) < min_cluster for c in labels])
        if not few.any():
            out = np.full(len(s), -1)
            out[keep] = labels
            return out
        keep = keep[~few]
    return np.full(len(s), -1)


def progressive_clusters(top: list[np.ndarray], loads: list[np.ndarray], samples: np.ndarray, k: int, min_overlap: int, min_founder: int, min_cluster: int, partners: np.ndarray | None = None) -> np.ndarray:
    """Labels, -1 for unassigned, of factors given by their top genes and those genes' loadings.

    Postings (gene -> factors) give the factors that an added or dropped gene of the program touches, and
    the partners that an assigned factor had. A founder whose cluster has too few samples is set aside,
    so the loop ends. partners: of each factor, how many share min_overlap genes with it, if known."""
    n = len(top)
    flat, size = (np.concatenate(top) if n else np.empty(0, np.int64)), np.array([len(t) for t in top], np.int64)
    order = np.argsort(flat, kind="stable")
    genes, start = np.unique(flat[order], return_index=True)
    holders = np.split(np.repeat(np.arange(n), size)[order], start[1:]) if n else []
    top = [np.searchsorted(genes, t) for t in top]

    def sharing(i: int) -> np.ndarray:
        """Factors that share min_overlap genes with factor i, itself left out."""
        met, times = np.unique(np.concatenate([holders[g] for g in top[i]]), return_counts=True)
        return met[(times >= min_overlap) & (met != i)]

    count = np.array([len(sharing(i)) for i in range(n)], np.int64) if partners is None else partners.astype(np.int64).copy()
    labels, free, barred, label = np.full(n, -1), np.ones(n, bool), np.zeros(n, bool), 0
    while True:
        able = np.where(free & ~barred, count, -1)
        if not n or able.max() < 0:
            return labels
        founder = int(np.argmax(able))
        if able[founder] <= min_founder:
            return labels
        members, freq, best = [], np.zeros(len(genes), np.int64), np.zeros(len(genes))
        match, inside = np.zeros(n, np.int64), np.zeros(len(genes), bool)
        waiting = free.copy()
        joined, program = founder, top[founder]
        while True:
            members.append(joined)
            waiting[joined] = False
            freq[top[joined]] += 1
            best[top[joined]] = np.maximum(best[top[joined]], loads[joined])
            if len(members) > 1:
                held = np.flatnonzero(freq)
                program = held[np.lexsort((held, -best[held], -freq[held]))][:k]
            now = np.zeros(len(genes), bool)
            now[program] = True
            for g in np.flatnonzero(now & ~inside):
                match[holders[g]] += 1
            for g in np.flatnonzero(inside & ~now):
                match[holders[g]] -= 1
            inside = now
            able = np.where(waiting, match, -1)
            joined = int(np.argmax(able))
            if able[joined] < min_overlap:
                break
        if len(set(samples[members])) < min_cluster:
            barred[founder] = True
            continue
        labels[members] = label
        free[members] = False
        for i in members:
            count[sharing(i)] -= 1
        label += 1


def part_scores(s: np.ndarray, labels: np.ndarray) -> tuple[int, int, int, float, float, float, float]:
    """Of one connected part: factors, clusters, sum of squared cluster sizes, sums of similarities
    inside and outside clusters, and the sums of silhouettes if all clusters are here, and if others
    are elsewhere (at distance 1)."""
    same = labels[:, None] == labels[None, :]
    names, own, size = np.unique(labels, return_inverse=True, return_counts=True)
    d = 1 - s
    np.fill_diagonal(d, 0)
    sums = np.stack([d[:, labels == c].sum(1) for c in names], 1)
    at = np.arange(len(labels))
    a = sums[at, own] / np.maximum(size[own] - 1, 1)
    other = sums / size
    other[at, own] = np.inf
    near = other.min(1)
    values = []
    for b in (near, np.minimum(near, 1.0)):
        with np.errstate(invalid="ignore"):
            score = np.where((size[own] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        values.append(float(score.sum()))
    return len(labels), len(names), int((size**2).sum()), float(s[same].sum()), float(s[~same].sum()), *values


# ---------------------------------------------------------------- models


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
            c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def ols_from_sums(n: int, xtx: np.ndarray, xty: np.ndarray, yty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, standard errors and two-sided t p-values from cross products."""
    inverse = np.linalg.pinv(xtx, rcond=1e-12, hermitian=True)
    beta = inverse @ xty
    df = n - np.linalg.matrix_rank(xtx, tol=1e-10 * max(np.abs(xtx).max(initial=0), 1e-300), hermitian=True)
    if df <= 0:
        return beta, np.full(len(beta), np.nan), np.full(len(beta), np.nan)
    rest = max(0.0, yty - 2 * beta @ xty + beta @ xtx @ beta)
    se = np.sqrt(np.maximum(0, np.diag(inverse) * rest / df))
    return beta, se, np.array([t_two_sided(b / e, df) if e > 0 else np.nan for b, e in zip(beta, se, strict=True)])


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ols_from_sums(len(y), x.T @ x, x.T @ y, float(y @ y))


def intercept_from_sums(n: int, xtx: np.ndarray, xty: np.ndarray, yty: float, groups: list[tuple], reml: bool = True, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linear mixed model with one random intercept, profiled over the variance ratio; Wald z p-values.

    groups: for each size of groups, their number and the cross products of their sums of x and y. A
    ratio shrinks all groups of one size alike, so these are all that the likelihood needs."""
    from math import erfc, sqrt

    p = len(xty)
    if np.linalg.matrix_rank(xtx, tol=1e-10 * max(np.abs(xtx).max(initial=0), 1e-300), hermitian=True) < p:
        raise np.linalg.LinAlgError("Singular matrix")

    def fit(r: float):
        a, b, c, logs = xtx.copy(), xty.copy(), yty, 0.0
        for size, count, gxx, gxy, gyy in groups:
            shrink = r / (1 + r * size)
            a, b, c, logs = a - shrink * gxx, b - shrink * gxy, c - shrink * gyy, logs + count * np.log1p(r * size)
        beta = np.linalg.solve(a, b)
        q = c - 2 * beta @ b + beta @ a @ beta
        df = n - p if reml else n
        value = df * np.log(max(q, 1e-300) / df) + logs
        if reml:
            value += np.linalg.slogdet(a)[1]
        return value, beta, a, q / df

    if ratio is None:
        grid = np.concatenate([[0.0], np.logspace(-6, 6, 121)])
        values = [fit(r)[0] for r in grid]
        k = int(np.argmin(values))
        a, b = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
        phi = (sqrt(5) - 1) / 2
        c, d = b - phi * (b - a), a + phi * (b - a)
        for _ in range(100):
            if fit(c)[0] < fit(d)[0]:
                b, d = d, c
                c = b - phi * (b - a)
            else:
                a, c = c, d
                d = a + phi * (b - a)
        ratio = min(((a + b) / 2, grid[k]), key=lambda r: fit(r)[0])
    _, beta, xtx, scale = fit(ratio)
    se = np.sqrt(np.maximum(0, np.diag(np.linalg.inv(xtx)) * scale))
    z = np.where(se > 0, beta / np.where(se > 0, se, 1), np.nan)
    return beta, se, np.array([erfc(abs(v) / sqrt(2)) if v == v else np.nan for v in z])


def random_intercept(x: np.ndarray, y: np.ndarray, groups: np.ndarray, reml: bool = True, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of rows."""
    codes = np.unique(groups, return_inverse=True)[1]
    size = np.bincount(codes)
    sx, sy = np.stack([np.bincount(codes, c) for c in x.T], 1), np.bincount(codes, y)
    sums = [(int(n), int((size == n).sum()), sx[size == n].T @ sx[size == n], sx[size == n].T @ sy[size == n], float(sy[size == n] @ sy[size == n])) for n in np.unique(size)]
    return intercept_from_sums(len(y), x.T @ x, x.T @ y, float(y @ y), sums, reml, ratio)


def two_normals(x: np.ndarray, rounds: int = 300, starts: int = 5, seed: int = 0, count: np.ndarray | None = None, spread: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of two normals, means ascending, by EM from several starts.

    count, spread: how many values each x stands for as their mean, and the variance among these."""
    rng = np.random.default_rng(seed)
    count = np.ones(len(x)) if count is None else count.astype(float)
    spread = np.zeros(len(x)) if spread is None else spread
    share, order = count / count.sum(), np.argsort(x, kind="stable")
    upto = np.cumsum(share[order])
    middle = (share * x).sum()
    whole = np.sqrt((share * ((x - middle) ** 2 + spread)).sum())
    best = (-np.inf, None)
    for s in range(starts):
        mean = x[order][np.minimum(np.searchsorted(upto, [0.25, 0.75]), len(x) - 1)] if s == 0 else np.sort(rng.choice(x, 2, True, share))
        dev, weight = np.full(2, whole + 1e-6), np.full(2, 0.5)
        for _ in range(rounds):
            dense = weight * np.exp(-0.5 * ((x[:, None] - mean) / dev) ** 2) / (dev * np.sqrt(2 * np.pi)) + 1e-300
            resp = count[:, None] * dense / dense.sum(1, keepdims=True)
            n = resp.sum(0) + 1e-12
            weight, mean = n / n.sum(), (resp * x[:, None]).sum(0) / n
            dev = np.sqrt((resp * ((x[:, None] - mean) ** 2 + spread[:, None])).sum(0) / n + 1e-6)
        like = (count * np.log(dense.sum(1))).sum()
        if like > best[0]:
            best = (like, (weight, mean, dev))
    weight, mean, dev = best[1]
    order = np.argsort(mean)
    return weight[order], mean[order], dev[order]


def crossover(x: np.ndarray, count: np.ndarray | None = None, spread: np.ndarray | None = None) -> float | None:
    """First of 500 points on [0, 1] where the higher normal is at least as likely as the lower; null below 4 values."""
    x = np.asarray(x, float)
    if (len(x) if count is None else count.sum()) < 4:
        return None
    weight, mean, dev = two_normals(x, count=count, spread=spread)
    if mean[1] - mean[0] < 0.05:
        warnings.warn("the two components have close means; the threshold may be unreliable", UserWarning, stacklevel=2)
    grid = np.linspace(0, 1, 500)
    with np.errstate(divide="ignore"):
        log = np.log(weight) - np.log(dev) - 0.5 * ((grid[:, None] - mean) / dev) ** 2
    return float(grid[int(np.argmax(log[:, 1] >= log[:, 0]))])
