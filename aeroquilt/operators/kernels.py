"""Array kernels that relational operators cannot express, one Arrow group at a time: robust affine fits, semi-global matching, correlation.

A group is a pair of photos or a padded tile, so its size is set by the caller and not by the survey.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_MASK = (1 << 64) - 1


def xorshift(state: int) -> int:
    """Next state of a 64-bit xorshift generator (shifts 13, 7, 17)."""
    state ^= state << 13 & _MASK
    state ^= state >> 7
    return state ^ (state << 17 & _MASK)


def ransac_affine(src: np.ndarray, dst: np.ndarray, rounds: int = 2000, threshold: float = 3.0, seed: int = 0x9E3779B97F4A7C15, confidence: float = 0.999) -> tuple[np.ndarray | None, np.ndarray]:
    """(2 x 3 matrix, inlier mask): exact models of three points, an adaptive number of rounds of at least 50, then two least-squares refits."""
    n, X = len(src), np.column_stack([src, np.ones(len(src))])
    mask = np.zeros(n, bool)
    if n < 3:
        return None, mask
    best, count, needed, done = None, -1, rounds, 0
    while done < needed:
        done += 1
        pick = []
        for _ in range(3):
            seed = xorshift(seed)
            pick.append(seed % n)
        if len(set(pick)) < 3 or abs(np.linalg.det(X[pick])) < 1e-9:
            continue
        model = np.linalg.solve(X[pick], dst[pick]).T
        inside = ((X @ model.T - dst) ** 2).sum(1) < threshold**2
        if inside.sum() > count:
            best, count = model, int(inside.sum())
            odds = math.log(1 - (count / n) ** 3 + 1e-12)
            if odds < 0:
                needed = min(needed, max(50, int(math.log(1 - confidence) / odds) + 1))
    if count < 3:
        return None, mask
    for last in (False, False, True):
        mask = ((X @ best.T - dst) ** 2).sum(1) < threshold**2
        if last or mask.sum() < 3:
            break
        best = np.linalg.lstsq(X[mask], dst[mask], rcond=None)[0].T
    return best, mask


def verify_pairs(matches: DataFrame, least: int = 25, threshold: float = 3.0) -> DataFrame:
    """(i, j, k, a .. f) of the inliers of each pair of photos (i, j, k, xi, yi, xj, yj) whose affine is plausible.

    Plausible: singular values within 1.5 of each other and a scale between 0.33 and 3.
    """

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("k")
        src, dst = (np.column_stack([g.column(c).to_numpy() for c in cs]) for cs in (("xi", "yi"), ("xj", "yj")))
        A, mask = ransac_affine(src, dst, threshold=threshold)
        if A is not None:
            s = np.linalg.svd(A[:, :2], compute_uv=False)
            if mask.sum() < least or s[1] < 1e-6 or s[0] / s[1] > 1.5 or not 0.33 < math.sqrt(s[0] * s[1]) < 3:
                A = None
        kept = g.filter(pa.array(mask if A is not None else np.zeros(g.num_rows, bool))).select(["i", "j", "k"])
        for name, v in zip("abcdef", A.ravel() if A is not None else [0.0] * 6, strict=True):
            kept = kept.append_column(name, pa.array([float(v)] * kept.num_rows, pa.float64()))
        return kept

    kinds = {f.name: f.dataType.simpleString() for f in matches.schema}
    return matches.groupBy("i", "j").applyInArrow(run, f"i {kinds['i']}, j {kinds['j']}, k {kinds['k']}, " + ", ".join(f"{c} double" for c in "abcdef"))


def semi_global(cost: np.ndarray, p1: float, p2: float) -> np.ndarray:
    """Sum over eight directions of path costs of a (depth, rows, columns) volume."""
    d, h, w = cost.shape
    total = np.zeros_like(cost, dtype=np.float64)

    def step(before: np.ndarray, here: np.ndarray) -> np.ndarray:
        """One step of all lanes: (depth, lanes)."""
        low = before.min(0)
        best = np.minimum(before, low + p2)
        best[1:] = np.minimum(best[1:], before[:-1] + p1)
        best[:-1] = np.minimum(best[:-1], before[1:] + p1)
        return here + best - low

    for volume, back in ((cost, lambda a: a), (cost.transpose(0, 2, 1), lambda a: a.transpose(0, 2, 1))):
        rows = volume.shape[1]
        for flip in (False, True):
            v = volume[:, ::-1] if flip else volume
            path = np.empty(v.shape, np.float64)
            path[:, 0] = v[:, 0]
            for r in range(1, rows):
                path[:, r] = step(path[:, r - 1], v[:, r])
            total += back(path[:, ::-1] if flip else path)
    for flip in (False, True):
        for side in (-1, 1):
            v = cost[:, ::-1] if flip else cost
            path = np.empty(v.shape, np.float64)
            path[:, 0] = v[:, 0]
            for r in range(1, h):
                before = np.roll(path[:, r - 1], side, axis=1)
                path[:, r] = step(before, v[:, r])
                edge = 0 if side == 1 else w - 1
                path[:, r, edge] = v[:, r, edge]
            total += path[:, ::-1] if flip else path
    return total


def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Zero-mean normalised correlation of template ``a`` with every window of ``b`` by Fourier transforms."""
    h, w = a.shape
    shape = tuple(x + y - 1 for x, y in zip(a.shape, b.shape, strict=True))
    at = a - a.mean()
    product = np.fft.irfft2(np.fft.rfft2(b, shape) * np.fft.rfft2(at[::-1, ::-1], shape), shape)[h - 1 : b.shape[0], w - 1 : b.shape[1]]

    def windows(x: np.ndarray) -> np.ndarray:
        s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        s[1:, 1:] = x.cumsum(0).cumsum(1)
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    spread = windows(b * b) - windows(b) ** 2 / (h * w)
    return product / np.sqrt(np.maximum(spread, 1e-12) * max(float((at * at).sum()), 1e-12))


def peak(score: np.ndarray) -> tuple[float, float, float]:
    """(row, column, height) of the maximum, refined by parabolas where it is not on the border."""
    r, c = np.unravel_index(int(score.argmax()), score.shape)
    fine = lambda a, b, d: float(np.clip(0.5 * (a - d) / (a - 2 * b + d), -0.5, 0.5)) if a - 2 * b + d else 0.0
    dr = fine(score[r - 1, c], score[r, c], score[r + 1, c]) if 0 < r < score.shape[0] - 1 else 0.0
    dc = fine(score[r, c - 1], score[r, c], score[r, c + 1]) if 0 < c < score.shape[1] - 1 else 0.0
    return r + dr, c + dc, float(score[r, c])


def match_depth(costs: DataFrame, p1: float, p2: float) -> DataFrame:
    """(tile, row, col, k) of the least semi-global cost of each cell; costs: (tile, row, col, k, cost), whole per tile."""

    def run(g: pa.Table) -> pa.Table:
        r, c, k = (g.column(n).to_numpy() for n in ("row", "col", "k"))
        r0, c0 = r.min(), c.min()
        v = np.full((k.max() + 1, r.max() - r0 + 1, c.max() - c0 + 1), 1e3)
        v[k, r - r0, c - c0] = g.column("cost").to_numpy()
        best = semi_global(v, p1, p2).argmin(0)
        rr, cc = np.indices(best.shape)
        return pa.table({"tile": pa.array([g.column("tile")[0].as_py()] * best.size, pa.int32()), "row": pa.array((rr + r0).ravel().astype(np.int32)), "col": pa.array((cc + c0).ravel().astype(np.int32)), "k": pa.array(best.ravel().astype(np.int32))})

    return costs.groupBy("tile").applyInArrow(run, "tile int, row int, col int, k int")
