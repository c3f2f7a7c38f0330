"""From court points in an image to the plane of the court: robust fits, and one estimate a frame."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from hardwood.operators.state import run_per_video
from hardwood.operators.trackers import camera_moved, segment_start, valid_points

# Greatest error of an inlier (in feet), least inliers, greatest median error back in the image
# (pixels), least extent of the points on the court (feet), court points there are.
INLIER_FT, LEAST_INLIERS, MOST_RESIDUAL, LEAST_SPAN, COURT_POINTS = 5.0, 5, 15.0, (18.0, 12.0), 33
# Frames pooled at most and at least, weight of a new single fit, frames of holdover.
POOL, LEAST_POOL, WEIGHT, HOLDOVER = 25, 6, 0.35, 30
#: Samples of four points tried, drawn by a fixed seed.
TRIALS, SEED = 256, 7
#: Samples compared at once, so that what is compared stays in a core's cache.
SLICE = 64

ESTIMATES = "video_id string, frame_index long, h array<double>, confidence double, inliers int, residual double, cached boolean, reason string"


def _scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points around 0 at a mean distance of sqrt(2), and the matrix that does it."""
    mid = p.mean(0)
    k = np.sqrt(2) / max(np.linalg.norm(p - mid, axis=1).mean(), 1e-12)
    return (p - mid) * k, np.array([[k, 0, -k * mid[0]], [0, k, -k * mid[1]], [0, 0, 1]])


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrices (m, 3, 3) that take the points ``a`` (m, n, 2) to ``b``, by the least singular vector."""
    one, zero = np.ones(a.shape[:2]), np.zeros(a.shape[:2])
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    top = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], -1)
    low = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], -1)
    rows = np.concatenate([top, low], 1)
    return np.linalg.svd(rows, full_matrices=rows.shape[1] < 9)[2][:, -1].reshape(-1, 3, 3)


@lru_cache(maxsize=1024)
def draws_of_four(trials: int, n: int, seed: int) -> np.ndarray:
    """``trials`` samples (trials, 4) of the places 0 to n - 1; the same for equal arguments."""
    return np.random.default_rng(seed).random((trials, n)).argpartition(3, axis=1)[:, :4]


def through_four(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrices (..., 3, 3) that take four points ``a`` (..., 4, 2) to ``b``, in closed form and up to a factor. Of samples that
    tell none, such as three points on a line, all points may fall to scale 0."""

    def parts(p: np.ndarray) -> tuple[list, list, list]:
        """Points, the normals of the lines through two of the first three, and how far the fourth is off these."""
        x, y = p[..., 0], p[..., 1]
        sides = [(y[..., i] - y[..., j], x[..., j] - x[..., i], x[..., i] * y[..., j] - x[..., j] * y[..., i]) for i, j in ((1, 2), (2, 0), (0, 1))]
        return [(x[..., i], y[..., i], 1.0) for i in range(3)], sides, [s[0] * x[..., 3] + s[1] * y[..., 3] + s[2] for s in sides]

    (_, sides, off), (points, _, off_b) = parts(a), parts(b)
    size = [off_b[i] * off[j] * off[k] for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
    h = np.empty((*a.shape[:-2], 3, 3))
    for r in range(3):
        grown = [size[i] * points[i][r] for i in range(3)]
        for c in range(3):
            h[..., r, c] = grown[0] * sides[0][c] + grown[1] * sides[1][c] + grown[2] * sides[2][c]
    return h


def within(h: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | float) -> np.ndarray:
    """(..., trials, n): whether matrices (..., trials, 3, 3) take points ``a`` (..., n, 2) to within ``most`` of ``b``. The distance
    is compared before the division by the scale, so it is three products of matrices; points at scale 0 aren't."""
    x, y, one = a[..., 0], a[..., 1], np.ones(a.shape[:-1])
    at = np.stack([x, y, one], -2)
    scale = h[..., 2, :] @ at
    off = [np.concatenate([h[..., i, :], h[..., 2, :]], -1) @ np.concatenate([at, -b[..., None, :, i] * at], -2) for i in (0, 1)]
    with np.errstate(over="ignore", invalid="ignore"):
        for m in (*off, scale):
            np.multiply(m, m, out=m)
        off[0] += off[1]
        ok = off[0] <= scale * most**2
    ok &= scale > 0
    return ok


def projected(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points (n, 2) by matrices (..., 3, 3); not finite where the scale is 0."""
    q = np.concatenate([p, np.ones((len(p), 1))], 1) @ np.swapaxes(h, -1, -2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[..., :2] / q[..., 2:]


def residual(h: np.ndarray, image: np.ndarray, world: np.ndarray) -> float:
    """Median distance in pixels of image points from where the world points fall; infinite for a degenerate matrix."""
    if abs(np.linalg.det(h)) < 1e-15:
        return float("inf")
    error = float(np.median(np.linalg.norm(projected(np.linalg.inv(h), world) - image, axis=1)))
    return error if np.isfinite(error) else float("inf")


def robust_fit(image: np.ndarray, world: np.ndarray) -> tuple[np.ndarray | None, int, float, str | None]:
    """Matrix from image to world, inliers, residual and, if there is none, why.

    Of TRIALS samples of four points the matrix with the most inliers, then fitted to these until they
    settle. The seed is fixed: equal points give equal results.
    """
    n = len(image)
    if n < LEAST_INLIERS:
        return None, n, float("inf"), "few_points"
    if (np.ptp(world, axis=0) < LEAST_SPAN).any():
        return None, n, float("inf"), "low_span"
    (a, ta), (b, tb) = _scaled(image), _scaled(world)
    draws = draws_of_four(TRIALS, n, SEED)
    most = INLIER_FT * tb[0, 0]
    tried, count = through_four(a[draws], b[draws]), -1
    for at in range(0, TRIALS, SLICE):
        some = within(tried[at : at + SLICE], a, b, most)
        counts = np.count_nonzero(some, axis=1)
        first = counts.argmax()
        if counts[first] > count:
            mask, count = some[first], counts[first]
        if count == n:
            break
    for _ in range(5):
        if mask.sum() < LEAST_INLIERS:
            return None, int(mask.sum()), float("inf"), "few_inliers"
        h = _solve(a[None, mask], b[None, mask])[0]
        now = within(h[None], a, b, most)[0]
        if (now == mask).all():
            break
        mask = now
    if mask.sum() < LEAST_INLIERS:
        return None, int(mask.sum()), float("inf"), "few_inliers"
    full = np.linalg.inv(tb) @ h @ ta
    full = full / full[2, 2] if abs(full[2, 2]) > 1e-12 else full
    error = residual(full, image[mask], world[mask])
    if error > MOST_RESIDUAL:
        return None, int(mask.sum()), error, "residual"
    return full, int(mask.sum()), error, None


def plane_start() -> dict:
    return {"camera": segment_start(), "pool": [], "h": None, "held": 0, "confidence": 0.0, "inliers": 0, "residual": float("inf")}


def plane_step(s: dict, row: dict) -> list[dict]:
    """One frame of ``points`` (kp_idx, x, y, valid, wx, wy): a fit to the pool of the segment's last frames once
    there are enough, else to this frame, blended with the last matrix. Where only the single fit holds, the
    pool starts anew. Without a fit the last matrix stays for HOLDOVER frames, less and less trusted."""
    valid = valid_points(row)
    if camera_moved(s["camera"], valid):
        s["pool"], s["h"] = [], None
    world = {p["kp_idx"]: (p["wx"], p["wy"]) for p in row["points"]} if valid else {}
    here = (np.array(list(valid.values()), float).reshape(-1, 2), np.array([world[k] for k in valid], float).reshape(-1, 2))
    if valid:
        s["pool"] = [*s["pool"], here][-POOL:]
    pooled = len(s["pool"]) >= LEAST_POOL
    if pooled:
        h, inliers, error, why = robust_fit(*(np.concatenate([f[i] for f in s["pool"]]) for i in (0, 1)))
    if not pooled or h is None:
        h, inliers, error, why = robust_fit(*here)
        if pooled and h is not None:
            s["pool"], pooled = [here], False
    out = {"frame_index": row["frame_index"], "cached": False, "reason": why}
    if h is not None:
        if not pooled and s["h"] is not None:
            h = WEIGHT * h + (1 - WEIGHT) * s["h"]
            h = h / h[2, 2]
        sure = 0.6 * min(inliers / COURT_POINTS, 1.0) + 0.4 * max(0.0, 1.0 - error / MOST_RESIDUAL)
        s.update(h=h, held=0, confidence=sure, inliers=inliers, residual=error)
    elif s["h"] is not None and s["held"] < HOLDOVER:
        s["held"] += 1
        out["cached"], sure = True, s["confidence"] * (1 - s["held"] / HOLDOVER)
    else:
        s["h"], s["confidence"] = None, 0.0
        return [out | {"h": None, "confidence": 0.0, "inliers": len(valid), "residual": float("inf")}]
    return [out | {"h": s["h"].ravel().tolist(), "confidence": sure, "inliers": s["inliers"], "residual": s["residual"]}]


def court_planes(frames: DataFrame) -> DataFrame:
    """One estimate a frame of each video, from frames with ``points``; the state is a pool of at most POOL frames."""
    return run_per_video(frames, plane_start, plane_step, ESTIMATES, ["frame_index"])
