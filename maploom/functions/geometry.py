"""Column functions on positions, transforms, boxes and camera models."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclid(p: list[Column], q: list[Column]) -> Column:
    """Distance of two points given by their coordinates (2-D or 3-D)."""
    total = F.lit(0.0)
    for a, b in zip(p, q):
        total = total + (a - b) * (a - b)
    return F.sqrt(total)


def apply_transform(m: Column, p: list[Column]) -> list[Column]:
    """Point under a row-major 4x4 matrix given as an array of 16."""
    return [m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(3)]


def compose(a: Column, b: Column) -> Column:
    """Matrix product of two row-major 4x4 arrays."""
    return F.array(*[sum((a[4 * r + k] * b[4 * k + c] for k in range(1, 4)), a[4 * r] * b[c]) for r in range(4) for c in range(4)])


def invert_rigid(m: Column) -> Column:
    """Inverse of a rigid transform: transposed rotation, and translation turned back."""
    rot = [[m[4 * r + c] for c in range(3)] for r in range(3)]
    move = [m[3], m[7], m[11]]
    out = []
    for r in range(3):
        out += [rot[0][r], rot[1][r], rot[2][r], -(rot[0][r] * move[0] + rot[1][r] * move[1] + rot[2][r] * move[2])]
    return F.array(*out, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def quat_to_matrix(q: list[Column], p: list[Column]) -> Column:
    """4x4 pose of a unit quaternion (x, y, z, w) and a position."""
    x, y, z, w = q
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), p[0],
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), p[1],
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y), p[2],
        F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0),
    )


def yaw_deg(q: list[Column]) -> Column:
    """Heading about z in degrees, of a quaternion (x, y, z, w)."""
    x, y, z, w = q
    return F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def rotation_angle_deg(a: Column, b: Column) -> Column:
    """Angle between the rotations of two 4x4 arrays."""
    trace = sum((a[4 * r + c] * b[4 * r + c] for r in range(3) for c in range(3) if (r, c) != (0, 0)), a[0] * b[0])
    return F.degrees(F.acos(F.least(F.greatest((trace - 1) / 2, F.lit(-1.0)), F.lit(1.0))))


def aabb_gap(c1: list[Column], d1: list[Column], c2: list[Column], d2: list[Column]) -> Column:
    """Free distance between two axis-aligned boxes given by centre and full size."""
    parts = [F.greatest(F.abs(a - b) - (p + q) / 2, F.lit(0.0)) for a, b, p, q in zip(c1, c2, d1, d2)]
    return F.sqrt(sum((x * x for x in parts[1:]), parts[0] * parts[0]))


def aabb_iou(c1: list[Column], d1: list[Column], c2: list[Column], d2: list[Column]) -> Column:
    """Shared over joint volume; 0 where the joint volume is 0."""
    shared, v1, v2 = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for a, p, b, q in zip(c1, d1, c2, d2):
        shared = shared * F.greatest(F.least(a + p / 2, b + q / 2) - F.greatest(a - p / 2, b - q / 2), F.lit(0.0))
        v1, v2 = v1 * p, v2 * q
    joint = v1 + v2 - shared
    return F.when(joint > 0, shared / joint).otherwise(0.0)


def proximity_score(distance: Column, midpoint: float = 2.0) -> Column:
    return 1 / (1 + F.exp(distance - midpoint))


def frame_reward(x1: Column, y1: Column, x2: Column, y2: Column, area: Column, height: float, width: float, least_area: float = 300.0) -> Column:
    """How good a view of an object a frame gives: half for how central its box is, half for its size.

    Central: entropy of the shares that the box centre cuts the image into, over ln 4.
    """
    u, v = (x1 + x2) / 2 / width, (y1 + y2) / 2 / height
    cells = [u * v, u * (1 - v), (1 - u) * v, (1 - u) * (1 - v)]
    spread = F.lit(0.0)
    for p in cells:
        spread = spread - p * F.ln(p + 1e-8)
    return 0.5 * spread / math.log(4) + 0.5 * F.tanh(area / (10 * least_area))


def backproject(u: Column, v: Column, z: Column, k: tuple[float, float, float, float]) -> list[Column]:
    """Camera point of a pixel and depth under a pinhole (fx, fy, cx, cy)."""
    fx, fy, cx, cy = k
    return [(u - cx) * z / fx, (v - cy) * z / fy, z]


def project(p: list[Column], k: tuple[float, float, float, float]) -> list[Column]:
    """Pixel coordinates of a camera point; null at or behind the camera."""
    fx, fy, cx, cy = k
    ahead = p[2] > 0
    return [F.when(ahead, fx * p[0] / p[2] + cx), F.when(ahead, fy * p[1] / p[2] + cy)]


def project_fisheye(p: list[Column], k: tuple[float, float, float, float], d: tuple[float, float, float, float]) -> list[Column]:
    """Pixel coordinates under the four-coefficient fisheye model."""
    fx, fy, cx, cy = k
    r = F.hypot(p[0], p[1])
    a = F.atan2(r, p[2])
    bent = a * (1 + d[0] * a * a + d[1] * F.pow(a, F.lit(4)) + d[2] * F.pow(a, F.lit(6)) + d[3] * F.pow(a, F.lit(8)))
    scale = F.when(r > 1e-12, bent / r).otherwise(F.lit(1.0))
    return [fx * scale * p[0] + cx, fy * scale * p[1] + cy]


def disparity_to_depth(disparity: Column, focal: float, baseline: float, most: float) -> Column:
    """Depth of a disparity; 0 where it isn't positive or the depth is over ``most``."""
    depth = focal * baseline / disparity
    return F.when((disparity > 0) & (depth <= most), depth).otherwise(0.0)
