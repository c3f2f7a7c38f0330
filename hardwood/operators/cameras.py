"""From court points to cameras: one focal length a video, the pose of each frame, and a filter over the poses.

What a frame shows alone (its pose) is solved in batches over all frames of all videos; only the filter, which feeds
back, goes through a video in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.operators.homography import COURT_POINTS, MOST_RESIDUAL, draws_of_four, plane_start, plane_step, residual, through_four, within
from hardwood.operators.state import run_per_video
from hardwood.operators.trackers import camera_moved, segment_start, valid_points
from hardwood.shared import spread

# Frames that the focal length is the median of, least points of a pose and of a camera without outliers,
# greatest error of an inlier in pixels, frames that a pose is predicted for.
FOCAL_FRAMES, LEAST_POINTS, LEAST_PLAIN, INLIER_PX, HOLDOVER = 30, 6, 4, 5.0, 30
# Noise of motion and of sightings, of the three angles and the three lengths of a pose.
MOTION_NOISE, SIGHT_NOISE = (1e-4, 1e-2), (1e-3, 1e-1)
#: Samples of four points tried for a pose, drawn by a fixed seed; steps of its refinement.
TRIALS, SEED, STEPS = 96, 7, 12
#: Frames solved together, so that their matrices stay small.
TOGETHER = 256

POSES = "rotation array<double>, shift array<double>, inliers int, camera array<double>"
CAMERAS = "video_id string, frame_index long, h array<double>, camera array<double>, confidence double, inliers int, residual double, cached boolean, reason string"


# --- Focal length ---------------------------------------------------------------------------


def focal_candidates(h: Column, width: Column, height: Column) -> Column:
    """The squares of the focal length, at most two, that fit a matrix ``h`` (9 numbers, image to court): seen from the
    image's centre, the court's axes must be orthogonal, and equally long."""
    cx, cy = width / 2, height / 2
    # Columns of the inverse of h, up to one factor, moved to the centre.
    first = [h[4] * h[8] - h[5] * h[7], h[5] * h[6] - h[3] * h[8], h[3] * h[7] - h[4] * h[6]]
    second = [h[2] * h[7] - h[1] * h[8], h[0] * h[8] - h[2] * h[6], h[1] * h[6] - h[0] * h[7]]
    det = h[0] * first[0] + h[1] * first[1] + h[2] * first[2]
    a, b = ([(c[0] - cx * c[2]) / det, (c[1] - cy * c[2]) / det, c[2] / det] for c in (first, second))
    some = lambda d: F.when(F.abs(d) > 1e-9, d)
    crossed = -(a[0] * b[0] + a[1] * b[1]) / some(a[2] * b[2])
    equal = (b[0] * b[0] + b[1] * b[1] - a[0] * a[0] - a[1] * a[1]) / some(a[2] * a[2] - b[2] * b[2])
    return F.filter(F.array(crossed, equal), lambda f: (f > 0) & (f < float("inf")))


def _has_candidates(h: list[float], width: float, height: float) -> bool:
    """Whether ``focal_candidates`` finds any, for the pass that must know when to stop."""
    try:
        m = np.array([[1, 0, -width / 2], [0, 1, -height / 2], [0, 0, 1]]) @ np.linalg.inv(np.array(h).reshape(3, 3))
    except np.linalg.LinAlgError:
        return False
    (a, b), floor = (m[:, 0], m[:, 1]), 1e-9
    crossed, equal = a[2] * b[2], a[2] ** 2 - b[2] ** 2
    found = [-(a[0] * b[0] + a[1] * b[1]) / crossed] if abs(crossed) > floor else []
    found += [(b[0] ** 2 + b[1] ** 2 - a[0] ** 2 - a[1] ** 2) / equal] if abs(equal) > floor else []
    return any(np.isfinite(f) and f > 0 for f in found)


def _calibration_start() -> dict:
    return {"plane": plane_start(), "frames": 0}


def _calibration_step(s: dict, row: dict) -> list[dict]:
    if s["frames"] >= FOCAL_FRAMES:
        return []
    out = plane_step(s["plane"], row)[0]
    if out["h"] is None or out["cached"] or not out["residual"] <= MOST_RESIDUAL or not _has_candidates(out["h"], row["width"], row["height"]):
        return []
    s["frames"] += 1
    return [{"frame_index": out["frame_index"], "h": out["h"], "width": float(row["width"]), "height": float(row["height"])}]


def calibration_planes(frames: DataFrame) -> DataFrame:
    """The first FOCAL_FRAMES planes of each video (video_id, frame_index, h, width, height) that tell a focal length.

    ``frames``: as for ``court_planes``, with the image's width and height. Later frames are passed over.
    """
    return run_per_video(frames, _calibration_start, _calibration_step, "video_id string, frame_index long, h array<double>, width double, height double", ["frame_index"])


def focal_lengths(planes: DataFrame, frames: int = FOCAL_FRAMES) -> DataFrame:
    """video_id, focal and calibrated_at of each video whose ``planes`` (video_id, frame_index, h, width, height) give
    candidates in ``frames`` frames: the root of the median of the candidates of the first so many."""
    rows = planes.withColumn("f", focal_candidates(F.col("h"), F.col("width"), F.col("height"))).where(F.size("f") > 0)
    nth = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_index"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= frames)
    # A video's candidates are two a frame at most, so its median is over some dozens of numbers.
    out = rows.select("video_id", "frame_index", "nth", F.explode("f").alias("f")).groupBy("video_id").agg(F.sqrt(F.median("f")).alias("focal"), F.max("frame_index").alias("calibrated_at"), F.max("nth").alias("n"))
    return out.where(F.col("n") >= frames).drop("n")


# --- Pose of a frame ------------------------------------------------------------------------


def rotations(angles: np.ndarray) -> np.ndarray:
    """Matrices (m, 3, 3) of rotation vectors (m, 3)."""
    size = np.linalg.norm(angles, axis=1)
    axis = angles / np.maximum(size, 1e-300)[:, None]
    x, y, z = axis.T
    zero = np.zeros_like(x)
    k = np.stack([zero, -z, y, z, zero, -x, -y, x, zero], 1).reshape(-1, 3, 3)
    return np.eye(3) + np.sin(size)[:, None, None] * k + (1 - np.cos(size))[:, None, None] * (k @ k)


def rotation_vector(r: np.ndarray) -> np.ndarray:
    """Rotation vector of a matrix, of at most half a turn."""
    cos = np.clip((np.trace(r) - 1) / 2, -1.0, 1.0)
    way = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    sin = np.linalg.norm(way)
    if sin > 1e-7:
        return way / sin * np.arctan2(sin, cos)
    if cos > 0:
        return way
    axis = np.sqrt(np.maximum(np.diag(r) + 1, 0) / 2)
    lead = int(axis.argmax())
    signs = np.sign(r[lead] + (np.arange(3) == lead))
    return np.pi * axis * np.where(signs == 0, 1.0, signs)


def _homographies(world: np.ndarray, image: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Matrices (m, 3, 3) from court to image by weighted least squares in scaled coordinates; ``weight``: (m, n)."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = weight.sum(1)
        mid = (p * weight[..., None]).sum(1) / total[:, None]
        k = np.sqrt(2) / np.maximum((np.linalg.norm(p - mid[:, None], axis=2) * weight).sum(1) / total, 1e-12)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0], t[:, 1, 1], t[:, 2, 2], t[:, :2, 2] = k, k, 1.0, -k[:, None] * mid
        return (p - mid[:, None]) * k[:, None, None], t

    (a, ta), (b, tb) = scaled(world), scaled(image)
    one, zero = weight, np.zeros_like(weight)
    x, y, u, v = a[..., 0] * weight, a[..., 1] * weight, b[..., 0], b[..., 1]
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u * one], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v * one], -1)], 1)
    h = np.linalg.svd(rows, full_matrices=rows.shape[1] < 9)[2][..., 8, :].reshape(-1, 3, 3)
    return np.linalg.inv(tb) @ h @ ta


def plane_poses(world: np.ndarray, image: np.ndarray, weight: np.ndarray, focal: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (m, 3, 3) and shifts (m, 3) that take court points (m, n, 2) to image points by least squares, weighted.

    They start from the plane's matrix and are refined together by damped Gauss-Newton steps.
    """
    flat = (image - centre[:, None]) / focal[:, None, None]
    h = _homographies(world, flat, weight)
    h = h * (2 / (np.linalg.norm(h[..., 0], axis=1) + np.linalg.norm(h[..., 1], axis=1)))[:, None, None]
    h = h * np.where(h[:, 2, 2] < 0, -1.0, 1.0)[:, None, None]
    near = np.stack([h[..., 0], h[..., 1], np.cross(h[..., 0], h[..., 1])], -1)
    u, _, v = np.linalg.svd(near)
    r, t, damp = u @ v, h[..., 2].copy(), np.full(len(h), 1e-6)
    at = np.concatenate([world, np.zeros((*world.shape[:2], 1))], 2)

    def error(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turned = at @ np.swapaxes(r, 1, 2)
        p = turned + t[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            off = (p[..., :2] / p[..., 2:] - flat) * weight[..., None]
        return turned, p, np.where(weight[..., None] > 0, off, 0.0)

    turned, p, off = error(r, t)
    cost = (off**2).sum((1, 2))
    for _ in range(STEPS):
        z = np.where(weight > 0, p[..., 2], 1.0)
        dx = np.zeros((*z.shape, 2, 3))
        dx[..., 0, 0] = dx[..., 1, 1] = weight / z
        dx[..., 0, 2], dx[..., 1, 2] = -weight * p[..., 0] / z**2, -weight * p[..., 1] / z**2
        a, b, c = turned[..., 0], turned[..., 1], turned[..., 2]
        zero = np.zeros_like(a)
        cross = np.stack([zero, c, -b, -c, zero, a, b, -a, zero], -1).reshape(*a.shape, 3, 3)
        j = np.concatenate([dx @ cross, dx], -1).reshape(len(h), -1, 6)
        normal, slope = np.swapaxes(j, 1, 2) @ j, np.swapaxes(j, 1, 2) @ off.reshape(len(h), -1, 1)
        normal = normal + damp[:, None, None] * (np.eye(6) * np.einsum("mii->mi", normal)[:, None] + 1e-12 * np.eye(6))
        step = -np.linalg.solve(normal, slope)[..., 0]
        r2, t2 = rotations(step[:, :3]) @ r, t + step[:, 3:]
        turned2, p2, off2 = error(r2, t2)
        cost2 = (off2**2).sum((1, 2))
        better = cost2 < cost
        pick = lambda new, old: np.where(better.reshape(-1, *[1] * (old.ndim - 1)), new, old)  # noqa: B023, E731
        r, t, turned, p, off, cost = pick(r2, r), pick(t2, t), pick(turned2, turned), pick(p2, p), pick(off2, off), pick(cost2, cost)
        damp = np.where(better, np.maximum(damp / 10, 1e-12), np.minimum(damp * 10, 1e6))
    return r, t


def _consensus(world: np.ndarray, image: np.ndarray) -> np.ndarray:
    """(m, n): points (m, n, 2) of each frame that agree, within INLIER_PX, with the plane of the best of TRIALS samples of four
    of them. Frames are solved together."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = p - p.mean(1, keepdims=True)
        k = np.sqrt(2) / np.maximum(np.linalg.norm(p, axis=2).mean(1), 1e-12)
        return p * k[:, None, None], k

    (a, _), (b, k) = scaled(world), scaled(image)
    draws = draws_of_four(TRIALS, world.shape[1], SEED)
    best = within(through_four(a[:, draws], b[:, draws]), a, b, INLIER_PX * k[:, None, None])
    mask = best[np.arange(len(best)), np.count_nonzero(best, axis=2).argmax(1)]
    todo = np.arange(len(mask))
    for _ in range(5):
        few = mask[todo].sum(1) < 4
        mask[todo[few]] = False
        todo = todo[~few]
        if not len(todo):
            break
        h = _homographies(world[todo], image[todo], mask[todo].astype(float))
        now = within(h[:, None], world[todo], image[todo], INLIER_PX)[:, 0]
        changed = (now != mask[todo]).any(1)
        mask[todo] = now
        todo = todo[changed]
    return mask


def camera_matrix(focal: float, centre: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """3x4 matrix from places in space to the image."""
    k = np.array([[focal, 0, centre[0]], [0, focal, centre[1]], [0, 0, 1.0]])
    return k @ np.column_stack([r, t])


def solve_poses(frames: list[tuple[np.ndarray, np.ndarray, float, np.ndarray]]) -> list[tuple]:
    """rotation vector, shift, inliers and camera of each frame (court points, image points, focal length, centre).

    The pose is that of the points that agree, the camera that of all points; each null with too few. Points that lie
    on one line tell no pose. Frames with equally many points are solved together, TOGETHER at a time.
    """
    out = [[None, None, 0, None] for _ in frames]
    sizes = np.array([len(f[0]) for f in frames], int)
    for n in np.unique(sizes[sizes >= min(LEAST_POINTS, LEAST_PLAIN)]):
        same = np.flatnonzero(sizes == n)
        for at in range(0, len(same), TOGETHER):
            _solve_alike(frames, same[at : at + TOGETHER], out)
    return out


def _solve_alike(frames: list[tuple], which: np.ndarray, out: list[list]) -> None:
    """``solve_poses`` of frames with equally many points, into ``out``."""
    world, image = (np.stack([frames[i][j] for i in which]) for j in (0, 1))
    focal, centre = np.array([frames[i][2] for i in which], float), np.stack([frames[i][3] for i in which])
    n = world.shape[1]
    plain = _spread(world, np.ones(world.shape[:2], bool)) & (n >= LEAST_PLAIN)
    mask = np.zeros(world.shape[:2], bool)
    if n >= LEAST_POINTS and plain.any():
        mask[plain] = _consensus(world[plain], image[plain])
    agreed = (mask.sum(1) >= LEAST_POINTS) & _spread(world, mask)
    r, t = np.full((len(which), 3, 3), np.nan), np.full((len(which), 3), np.nan)
    if plain.any():
        r[plain], t[plain] = plane_poses(world[plain], image[plain], np.ones((int(plain.sum()), n)), focal[plain], centre[plain])
    # Where all points agree, the two poses are one.
    some = agreed & ~mask.all(1)
    r2, t2 = r.copy(), t.copy()
    if some.any():
        r2[some], t2[some] = plane_poses(world[some], image[some], mask[some].astype(float), focal[some], centre[some])
    for j, i in enumerate(which):
        if agreed[j] and np.isfinite(r2[j]).all() and np.isfinite(t2[j]).all():
            out[i][:3] = rotation_vector(r2[j]).tolist(), t2[j].tolist(), int(mask[j].sum())
        if plain[j] and np.isfinite(r[j]).all() and np.isfinite(t[j]).all():
            out[i][3] = camera_matrix(focal[j], centre[j], r[j], t[j]).ravel().tolist()


def _spread(points: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Whether the points (m, n, 2) of a frame that ``mask`` (m, n) names span an area."""
    count = mask.sum(1)
    mid = (points * mask[..., None]).sum(1) / np.maximum(count, 1)[:, None]
    return (count >= 3) & (np.linalg.svd((points - mid[:, None]) * mask[..., None], compute_uv=False)[:, 1] > 1e-6)


def frame_poses(frames: DataFrame, focals: DataFrame) -> DataFrame:
    """``frames`` with focal, calibrated_at and, from that frame on, the columns of POSES; the others null. In batches, no order,
    so the frames of a video are dealt over tasks."""
    rows = spread(frames.join(focals.select("video_id", "focal", "calibrated_at"), "video_id", "left"), "video_id", "frame_index")
    types = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [f is not None and i >= at for f, i, at in zip(*(b.column(c).to_pylist() for c in ("focal", "frame_index", "calibrated_at")), strict=True)]
            which = [i for i, k in enumerate(known) if k]
            points = b.column("points")
            owner, each = pc.list_parent_indices(points).to_numpy(), points.flatten()
            valid = each.field("valid").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            owner, values = owner[valid], np.stack([each.field(c).to_numpy(zero_copy_only=False)[valid] for c in ("wx", "wy", "x", "y")], 1).astype(float)
            first, last = np.searchsorted(owner, which), np.searchsorted(owner, which, "right")
            width, height, focal = (b.column(c).to_pylist() for c in ("width", "height", "focal"))
            todo = [(values[p:q, :2], values[p:q, 2:], focal[i], np.array([width[i], height[i]], float) / 2) for i, p, q in zip(which, first, last, strict=True)]
            solved = dict(zip(which, solve_poses(todo), strict=True)) if todo else {}
            cells = [solved.get(i, (None, None, None, None)) for i in range(b.num_rows)]
            added = [pa.array([c[j] for c in cells], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *(c.split()[0] for c in POSES.split(", "))])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), POSES])
    return rows.mapInArrow(run, ddl)


# --- Filter over a video --------------------------------------------------------------------


def _filter_start() -> dict:
    return {"at": None, "spread": None}


def _forward(s: dict) -> None:
    move = np.eye(12)
    move[:6, 6:] = np.eye(6)
    s["at"] = move @ s["at"]
    s["spread"] = move @ s["spread"] @ move.T + np.diag(np.tile(np.repeat(MOTION_NOISE, 3), 2))


def filter_pose(s: dict, pose: np.ndarray | None) -> np.ndarray:
    """Six numbers of a pose that moves evenly, corrected by ``pose``, or predicted without one."""
    if s["at"] is None:
        s["at"], s["spread"] = np.concatenate([pose, np.zeros(6)]), np.eye(12)
        return pose
    _forward(s)
    if pose is not None:
        gain = np.linalg.solve(s["spread"][:6, :6] + np.diag(np.repeat(SIGHT_NOISE, 3)), s["spread"][:6]).T
        s["at"] = s["at"] + gain @ (pose - s["at"][:6])
        s["spread"] = s["spread"] - gain @ s["spread"][:6]
    return s["at"][:6].copy()


def camera_start() -> dict:
    return {"camera": segment_start(), "plane": plane_start(), "filter": _filter_start(), "held": 0, "inliers": 0}


def camera_step(s: dict, row: dict) -> list[dict]:
    """One frame with its pose: filtered; without one predicted for HOLDOVER frames; else, and until the focal length is known,
    the plane of the court stands in, without a camera. A camera move starts the filter anew."""
    valid = valid_points(row)
    if camera_moved(s["camera"], valid):
        s["filter"], s["held"] = _filter_start(), 0

    def fallback() -> list[dict]:
        return [plane_step(s["plane"], row)[0] | {"camera": None}]

    if row["focal"] is None or row["frame_index"] <= row["calibrated_at"]:
        return fallback()
    seen = row["rotation"] is not None
    if seen:
        pose, s["held"], s["inliers"] = filter_pose(s["filter"], np.array([*row["rotation"], *row["shift"]], float)), 0, row["inliers"]
    elif s["filter"]["at"] is not None and s["held"] < HOLDOVER:
        s["held"] += 1
        pose = filter_pose(s["filter"], None)
    else:
        return fallback()
    p = camera_matrix(row["focal"], np.array([row["width"], row["height"]], float) / 2, rotations(pose[None, :3])[0], pose[3:])
    try:
        h = np.linalg.inv(p[:, [0, 1, 3]])
    except np.linalg.LinAlgError:
        return fallback()
    if abs(h[2, 2]) < 1e-9 or not np.isfinite(h).all():
        return fallback()
    h = h / h[2, 2]
    world = {q["kp_idx"]: (q["wx"], q["wy"]) for q in row["points"]} if valid else {}
    error = residual(h, np.array(list(valid.values()), float).reshape(-1, 2), np.array([world[k] for k in valid], float).reshape(-1, 2)) if valid else float("inf")
    sure = 0.6 * min(s["inliers"] / COURT_POINTS, 1.0) + 0.4 * max(0.0, 1.0 - error / MOST_RESIDUAL)
    return [{"frame_index": row["frame_index"], "h": h.ravel().tolist(), "camera": p.ravel().tolist(), "confidence": sure, "inliers": s["inliers"], "residual": error, "cached": not seen, "reason": None}]


def court_cameras(frames: DataFrame) -> DataFrame:
    """CAMERAS of each frame of ``frames`` (video_id, frame_index, width, height, points: kp_idx, x, y, valid, wx, wy).

    A video whose planes never tell a focal length gets planes only. Until it is known, planes; then the filtered pose.
    """
    poses = frame_poses(frames, focal_lengths(calibration_planes(frames)))
    return run_per_video(poses, camera_start, camera_step, CAMERAS, ["frame_index"])


def frame_cameras(frames: DataFrame) -> DataFrame:
    """video_id, frame_index and camera (3x4, row by row) of each frame from its own points alone, where the focal length is
    known and at least LEAST_PLAIN points are seen: what shots are fitted with."""
    poses = frame_poses(frames, focal_lengths(calibration_planes(frames)))
    return poses.where("camera is not null").select("video_id", "frame_index", "camera")
