"""Gradient-boosted trees for small feature matrices, with monotonic constraints.

A model is a few flat arrays (feature, threshold, left, right, value), so that
scoring a batch is ``depth`` rounds of fancy indexing for each tree, or one
Column expression of nested ``when``.  Fitting takes a bounded matrix in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    """Node arrays of all trees; ``root`` has the first node of each, leaves point to themselves."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int
    names: list[str] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of x."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for r in self.root:
            at = np.full(len(x), r)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))

    def column(self, features: dict[str, Column]) -> Column:
        """The log odds as a Column expression."""

        def node(i: int) -> Column:
            if self.left[i] == i:
                return F.lit(float(self.value[i]))
            x = features[self.names[self.feature[i]]]
            return F.when(x <= F.lit(float(self.threshold[i])), node(self.left[i])).otherwise(node(self.right[i]))

        out = F.lit(float(self.base))
        for r in self.root:
            out = out + node(int(r))
        return out


def fit(
    x: np.ndarray,
    y: np.ndarray,
    names: list[str],
    monotone: dict[str, int] | None = None,
    *,
    trees: int = 40,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    ridge: float = 1.0,
    least: float = 1.0,
) -> Trees:
    """Logistic loss, histogram splits, level by level.

    monotone gives -1 or 1 for a feature in which the score may only fall or
    rise.  A split that breaks this is not taken, and both sides inherit the
    middle of their values as a bound, so later splits keep to it as well.
    Without rows, or with one class alone, the model is a constant.
    """
    x = np.asarray(x, dtype=np.float64).reshape(-1, len(names))
    y = np.asarray(y, dtype=np.float64)
    sign = np.array([(monotone or {}).get(n, 0) for n in names])
    p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else np.zeros(0) for f in range(len(names))]
    code = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(len(names))], axis=1) if len(x) else np.zeros((0, len(names)), int)
    out: dict[str, list] = {k: [] for k in ("root", "feature", "threshold", "left", "right", "value")}

    def new() -> int:
        i = len(out["feature"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", i), ("right", i), ("value", 0.0)):
            out[k].append(v)
        return i

    score = np.full(len(x), base)
    for _ in range(trees if len(np.unique(y)) > 1 else 0):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)
        root = new()
        out["root"].append(root)
        open_ = [(root, np.arange(len(x)), -np.inf, np.inf)]
        for level in range(depth + 1):
            after = []
            for node, rows, lo, hi in open_:
                gs, hs = g[rows].sum(), h[rows].sum()
                out["value"][node] = v = float(np.clip(-gs / (hs + ridge), lo, hi))
                best = (1e-6, -1, -1)
                if level < depth:
                    for f in range(len(names)):
                        m = len(edges[f])
                        if not m:
                            continue
                        gl = np.cumsum(np.bincount(code[rows, f], g[rows], m + 1))[:-1]
                        hl = np.cumsum(np.bincount(code[rows, f], h[rows], m + 1))[:-1]
                        gr, hr = gs - gl, hs - hl
                        wl, wr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
                        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
                        gain[(hl < least) | (hr < least) | (sign[f] * (wr - wl) < 0)] = -1
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                if best[1] < 0:
                    score[rows] += rate * v
                    continue
                _, f, k = best
                to_left = code[rows, f] <= k
                sides = []
                for part in (rows[to_left], rows[~to_left]):
                    w = float(np.clip(-g[part].sum() / (h[part].sum() + ridge), lo, hi))
                    sides.append([new(), part, lo, hi, w])
                if sign[f]:
                    middle = (sides[0][4] + sides[1][4]) / 2
                    low, high = (0, 1) if sign[f] > 0 else (1, 0)
                    sides[low][3], sides[high][2] = middle, middle
                out["feature"][node], out["threshold"][node] = f, float(edges[f][k])
                out["left"][node], out["right"][node] = sides[0][0], sides[1][0]
                after += [tuple(s[:4]) for s in sides]
            open_ = after
    a = {k: np.array(v, dtype=np.float64 if k in ("threshold", "value") else np.int64) for k, v in out.items()}
    return Trees(a["root"], a["feature"], a["threshold"], a["left"], a["right"], a["value"] * rate, base, depth, list(names))
