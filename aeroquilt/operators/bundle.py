"""Bundle adjustment: camera poses on the driver, points and observations in Spark.

Observations and points are dealt by point, so every point's 3 x 3 block is eliminated inside one task.  Tasks sum the reduced camera system
sparsely over the camera pairs that share their points; the driver adds priors, solves, and sends pose steps back for the points' own steps.
Levenberg-Marquardt: damping falls threefold on success and rises tenfold on failure.  The reduced system has six rows per camera.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


@dataclass
class Cameras:
    """Rotations (n, 3, 3), centres (n, 3) and intrinsics (n, 6: f, k1, k2, k3, ppx, ppy) of the cameras ``ids``."""

    ids: list[int]
    R: np.ndarray
    C: np.ndarray
    intrinsics: np.ndarray

    def moved(self, step: np.ndarray) -> Cameras:
        step = step.reshape(-1, 6)
        return Cameras(self.ids, np.stack([turn(w) @ R for w, R in zip(step[:, :3], self.R, strict=True)]), self.C + step[:, 3:], self.intrinsics)


def skew(w: np.ndarray) -> np.ndarray:
    out = np.zeros((*w.shape[:-1], 3, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -w[..., 2], w[..., 1], -w[..., 0]
    return out - np.swapaxes(out, -1, -2)


def turn(w: np.ndarray) -> np.ndarray:
    """Rotation by an axis-angle vector."""
    angle = float(np.linalg.norm(w))
    k = skew(w / angle) if angle > 1e-12 else np.zeros((3, 3))
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def project(cam: Cameras, at: np.ndarray, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels and camera coordinates of points X seen by cameras ``at`` (indices)."""
    y = np.einsum("nij,nj->ni", cam.R[at], X - cam.C[at])
    f, k1, k2, k3, px, py = cam.intrinsics[at].T
    n = y[:, :2] / y[:, 2:]
    r2 = (n * n).sum(1)
    return (f * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))))[:, None] * n + np.stack([px, py], 1), y


def linearise(cam: Cameras, at: np.ndarray, X: np.ndarray, uv: np.ndarray, huber: float):
    """Weighted residuals, their derivatives by pose (n, 2, 6) and point (n, 2, 3), and the cost."""
    seen, y = project(cam, at, X)
    r = seen - uv
    s2 = (r * r).sum(1)
    s = np.sqrt(s2)
    behind = y[:, 2] <= 1e-9
    cost = np.where(s <= huber, s2, 2 * huber * s - huber**2)
    w = np.where(behind, 0.0, np.sqrt(np.where(s <= huber, 1.0, huber / np.maximum(s, 1e-12))))
    f, k1, k2, k3 = cam.intrinsics[at, :4].T
    n, iz = y[:, :2] / y[:, 2:], 1 / y[:, 2]
    r2 = (n * n).sum(1)
    d, slope = 1 + r2 * (k1 + r2 * (k2 + r2 * k3)), k1 + r2 * (2 * k2 + 3 * k3 * r2)
    by_n = f[:, None, None] * (d[:, None, None] * np.eye(2) + 2 * slope[:, None, None] * n[:, :, None] * n[:, None, :])
    by_y = np.einsum("nij,njk->nik", by_n, np.stack([np.stack([iz, 0 * iz, -n[:, 0] * iz], 1), np.stack([0 * iz, iz, -n[:, 1] * iz], 1)], 1))
    by_X = np.einsum("nij,njk->nik", by_y, cam.R[at])
    by_pose = np.concatenate([np.einsum("nij,njk->nik", by_y, -skew(y)), -by_X], 2)
    return r * w[:, None], by_pose * w[:, None, None], by_X * w[:, None, None], np.inf if behind.any() else float(cost.sum())


def _arrays(group: pa.Table, ids: dict[int, int]):
    at = np.array([ids[c] for c in group.column("cam_id").to_pylist()], np.int64)
    pt, p = np.unique(group.column("pt_id").to_numpy(), return_inverse=True)
    xyz = np.stack([group.column(c).to_numpy() for c in "xyz"], 1)
    return at, pt, p, xyz, np.stack([group.column("u").to_numpy(), group.column("v").to_numpy()], 1)


def _eliminated(cam, at, p, n, X, uv, huber, damping):
    """Blocks of one group of points: pose gradient and blocks, point inverses, and cross terms by observation."""
    r, jc, jx, cost = linearise(cam, at, X, uv, huber)
    V, g = np.zeros((n, 3, 3)), np.zeros((n, 3))
    np.add.at(V, p, np.einsum("nki,nkj->nij", jx, jx))
    np.add.at(g, p, np.einsum("nki,nk->ni", jx, r))
    V += damping * V * np.eye(3) + 1e-12 * np.eye(3)
    return r, jc, np.linalg.inv(V), g, np.einsum("nki,nkj->nij", jc, jx), cost


def _reduce(cam: Cameras, huber: float, damping: float):
    ids = {c: k for k, c in enumerate(cam.ids)}

    def run(group: pa.Table) -> pa.Table:
        at, pt, p, X, uv = _arrays(group, ids)
        r, jc, inv, g, W, cost = _eliminated(cam, at, p, len(pt), X, uv, huber, damping)
        blocks: dict[tuple[int, int], np.ndarray] = {}
        rhs: dict[int, np.ndarray] = {}
        Y = np.einsum("nij,njk->nik", W, inv[p])
        own, grad = np.einsum("nki,nkj->nij", jc, jc), np.einsum("nki,nk->ni", jc, r) - np.einsum("nij,nj->ni", Y, g[p])
        for k, c in enumerate(at.tolist()):
            blocks[c, c] = blocks.get((c, c), 0) + own[k]
            rhs[c] = rhs.get(c, 0) + grad[k]
        order = np.argsort(p, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(p[order])) + 1):
            for a in part.tolist():
                for b in part.tolist():
                    key = int(at[a]), int(at[b])
                    blocks[key] = blocks.get(key, 0) - Y[a] @ W[b].T
        keys, values = [], []
        for (i, j), block in blocks.items():
            keys += [(6 * i + a) * 6 * len(ids) + 6 * j + b for a in range(6) for b in range(6)]
            values.append(block.ravel())
        for i, v in rhs.items():
            keys += [-(6 * i + a) - 2 for a in range(6)]
            values.append(v)
        return pa.table({"key": pa.array([*keys, -1], pa.int64()), "value": pa.array(np.append(np.concatenate(values), cost))})

    return run


def _step(cam: Cameras, moved: Cameras, step: np.ndarray, huber: float, damping: float):
    ids = {c: k for k, c in enumerate(cam.ids)}

    def run(group: pa.Table) -> pa.Table:
        at, pt, p, X, uv = _arrays(group, ids)
        _, _, inv, g, W, _ = _eliminated(cam, at, p, len(pt), X, uv, huber, damping)
        pull = np.zeros((len(pt), 3))
        np.add.at(pull, p, np.einsum("nij,ni->nj", W, step.reshape(-1, 6)[at]))
        new = X[np.unique(p, return_index=True)[1]] - np.einsum("nij,nj->ni", inv, g + pull)
        _, _, _, cost = linearise(moved, at, new[p], uv, huber)
        share = np.full(len(pt), cost / len(pt))
        return pa.table({"pt_id": pa.array(pt), **{c: pa.array(new[:, k]) for k, c in enumerate("xyz")}, "cost": pa.array(share)})

    return run


def adjust(observations: DataFrame, points: DataFrame, cameras: Cameras, centre_sigma: float | None = None, huber: float = 4.0, rounds: int = 30, tolerance: float = 1e-6, buckets: int = 64) -> tuple[Cameras, DataFrame, float]:
    """(cameras, points, cost) after Levenberg-Marquardt.  ``centre_sigma`` (pixels' worth of metres) ties centres to where they start."""
    obs = cut(observations.select("cam_id", F.col("pt_id").cast("long").alias("pt_id"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")))
    points = cut(points.select(F.col("pt_id").cast("long").alias("pt_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    start, n, damping = cameras.C.copy(), 6 * len(cameras.ids), 1e-3
    pull = 0.0 if centre_sigma is None else centre_sigma**-2
    prior = lambda cam: pull * float(((cam.C - start) ** 2).sum())
    best = None
    for _ in range(rounds):
        dealt = obs.join(points, "pt_id").withColumn("bucket", F.pmod(F.xxhash64("pt_id"), F.lit(buckets)))
        improved = False
        for _ in range(8):
            sums = dealt.groupBy("bucket").applyInArrow(_reduce(cameras, huber, damping), "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
            S, g = np.zeros(n * n), np.zeros(n)
            key, value = sums.column("key").to_numpy(), sums.column("value").to_numpy()
            S[key[key >= 0]] = value[key >= 0]
            g[-key[key < -1] - 2] = value[key < -1]
            S = S.reshape(n, n)
            cost = float(value[key == -1][0]) + prior(cameras)
            best = cost if best is None else best
            centres = np.arange(n).reshape(-1, 6)[:, 3:].ravel()
            S[centres, centres] += pull
            g[centres] += pull * (cameras.C - start).ravel()
            S[np.arange(n), np.arange(n)] *= 1 + damping
            S[np.arange(n), np.arange(n)] += 1e-9
            step = -np.linalg.solve(S, g)
            moved = cameras.moved(step)
            out = cut(dealt.groupBy("bucket").applyInArrow(_step(cameras, moved, step, huber, damping), "pt_id long, x double, y double, z double, cost double"))
            new = float(out.agg(F.sum("cost")).first()[0]) + prior(moved)
            if new < best:
                improved, gain, best = True, (best - new) / max(best, 1e-12), new
                cameras, points, damping = moved, out.drop("cost"), damping / 3
                break
            damping *= 10
        if not improved or gain < tolerance:
            break
    return cameras, points, best
