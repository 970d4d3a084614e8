"""Exact nearest-code search that skips codes by the triangle inequality.

Codes are gathered in about sqrt(k) groups around pivots with a radius (the
largest distance of a member from its pivot).  A feature's distance from a
pivot less the radius bounds its distance from every member, so groups whose
bound exceeds the best distance found so far are skipped.  What remains is
screened with matrix products and re-measured with left-to-right sums, so
codes and distances equal the plain search bit for bit.
"""

from __future__ import annotations

import numpy as np

SMALLEST = 128             # fewer codes are searched plainly
ROUNDS = 4                 # refinements of the pivots
AT_ONCE = 1 << 16          # numbers up to which pairs are measured in one array
GIVE_UP = 0.6              # share of products left after the bounds beyond which one product is cheaper


def margins(ff: np.ndarray, cc: np.ndarray) -> np.ndarray:
    """Bound of the rounding error of a screened squared distance."""
    return 1e-9 * (ff + (cc.max() if len(cc) else 0.0)) + 1e-12


def _squares(a: np.ndarray, aa: np.ndarray, b: np.ndarray, bb: np.ndarray) -> np.ndarray:
    return aa[:, None] - 2.0 * a @ b.T + bb[None, :]


class CodeIndex:
    """Groups of the rows of ``centers``; ``evaluated`` counts distances computed, pivots included."""

    def __init__(self, centers: np.ndarray, codes: np.ndarray):
        self.centers, self.codes = centers, codes
        self.cc = (centers * centers).sum(axis=1)
        self.evaluated = self.possible = 0
        self.groups: list[np.ndarray] = []
        k = len(centers)
        if k < SMALLEST:
            return
        pivot = centers[np.linspace(0, k - 1, int(np.ceil(np.sqrt(k)))).astype(np.int64)]
        for _ in range(ROUNDS):
            own = _squares(centers, self.cc, pivot, (pivot * pivot).sum(axis=1)).argmin(axis=1)
            used = np.unique(own)
            pivot = np.stack([centers[own == g].mean(axis=0) for g in used])
        own = _squares(centers, self.cc, pivot, (pivot * pivot).sum(axis=1)).argmin(axis=1)
        used = np.unique(own)
        self.pivot = pivot[used]
        self.pp = (self.pivot * self.pivot).sum(axis=1)
        self.groups = [np.flatnonzero(own == g) for g in used]
        self.radius = np.array([np.sqrt(((centers[g] - p) ** 2).sum(axis=1)).max() for g, p in zip(self.groups, self.pivot, strict=True)])

    def _pairs(self, feats: np.ndarray, ff: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, columns) that hold every row's nearest code."""
        m, k = len(feats), len(self.centers)
        self.possible += m * k
        if not self.groups:
            return self._plain(feats, ff, margin)
        self.evaluated += m * len(self.groups)
        slack = 2 * np.sqrt(margin)
        to_pivot = np.sqrt(np.maximum(_squares(feats, ff, self.pivot, self.pp), 0.0))
        below = np.maximum(to_pivot - self.radius[None, :] - slack[:, None], 0.0) ** 2
        first = to_pivot.argmin(axis=1)
        best = np.full(m, np.inf)
        found = []

        def look(g: int, rows: np.ndarray) -> None:
            cols = self.groups[g]
            near = _squares(feats[rows], ff[rows], self.centers[cols], self.cc[cols])
            self.evaluated += near.size
            best[rows] = np.minimum(best[rows], near.min(axis=1))
            r, c = np.nonzero(near <= (best[rows] + 2 * margin[rows])[:, None])
            found.append((rows[r], cols[c], near[r, c]))

        for g in np.unique(first).tolist():
            look(g, np.flatnonzero(first == g))
        open_ = below <= (best + 2 * margin)[:, None]
        open_[np.arange(m), first] = False
        sizes = np.array([len(g) for g in self.groups])
        if (open_.sum(axis=0) * sizes).sum() > GIVE_UP * m * k:
            return self._plain(feats, ff, margin)
        for g in np.argsort(below.mean(axis=0), kind="stable").tolist():
            rows = np.flatnonzero(open_[:, g])
            rows = rows[below[rows, g] <= best[rows] + 2 * margin[rows]]
            if len(rows):
                look(g, rows)
        rows, cols, near = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = near <= best[rows] + 2 * margin[rows]
        return rows[keep], cols[keep]

    def _plain(self, feats, ff, margin):
        near = _squares(feats, ff, self.centers, self.cc)
        self.evaluated += near.size
        return np.nonzero(near <= (near.min(axis=1) + margin)[:, None])

    def _distances(self, feats, rows, cols):
        """Squared distances of the pairs, added left to right."""
        if 0 < len(rows) * feats.shape[1] <= AT_ONCE:             # accumulate adds in the same order
            diff = feats[rows] - self.centers[cols]
            return np.add.accumulate(diff * diff, axis=1)[:, -1]
        d = np.zeros(len(rows))
        for p in range(feats.shape[1]):
            diff = feats[rows, p] - self.centers[cols, p]
            d = d + diff * diff
        return d

    def nearest(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the nearest centre, squared distance); equal distances go to the lowest code."""
        m = len(feats)
        out_c, out_d = np.full(m, -1), np.full(m, np.nan)
        if m == 0 or len(self.centers) == 0:
            return out_c, out_d
        ff = (feats * feats).sum(axis=1)
        rows, cols = self._pairs(feats, ff, margins(ff, self.cc))
        d = self._distances(feats, rows, cols)
        if len(rows) == m and (rows == np.arange(m)).all():       # one candidate a feature
            return cols, d
        order = np.lexsort((self.codes[cols], d, rows))
        first = np.ones(len(order), dtype=bool)
        first[1:] = rows[order][1:] != rows[order][:-1]
        sel = order[first]
        out_c[rows[sel]], out_d[rows[sel]] = cols[sel], d[sel]
        return out_c, out_d


class IndexCache:
    """The indexes last used by a task: neighbouring blocks mostly belong to one source."""

    def __init__(self, size: int = 8):
        self.size, self.held = size, {}

    def of(self, key, centers: np.ndarray, codes: np.ndarray) -> CodeIndex:
        if key not in self.held:
            if len(self.held) >= self.size:
                self.held.pop(next(iter(self.held)))
            self.held[key] = CodeIndex(centers, codes)
        return self.held[key]
