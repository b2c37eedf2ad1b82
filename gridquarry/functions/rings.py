"""Rings of any shape in the plane, as convex parts: areas, clips and differences of them."""

from __future__ import annotations

import numpy as np

#: Parts smaller than this (square degrees) are rounding.
TINY = 1e-13


def _cross(o: np.ndarray, p: np.ndarray) -> np.ndarray:
    return o[..., 0] * p[..., 1] - o[..., 1] * p[..., 0]


def area(ring: np.ndarray) -> float:
    """Area of a convex ring, or of any that does not cross itself."""
    return float(abs(_cross(ring, np.roll(ring, -1, 0)).sum()) / 2) if len(ring) > 2 else 0.0


def unwrapped(ring: np.ndarray) -> np.ndarray:
    """The ring with longitudes that never jump by more than half a turn, begun within -180 to 180."""
    lon = np.concatenate([ring[:1, 0], ring[:1, 0] + np.cumsum((np.diff(ring[:, 0]) + 180) % 360 - 180)])
    return np.stack([lon - np.floor((lon.min(initial=np.inf) + 180) / 360) * 360 if len(lon) else lon, ring[:, 1]], 1)


def convex_parts(ring: np.ndarray, cuts: tuple[float, ...] = ()) -> list[np.ndarray]:
    """A ring (n, 2), closed or not, as convex parts that share edges only; none lies on both sides of a cut (an x).

    The plane is cut into strips at every corner, at every crossing of two edges and at cuts, so inside a strip edges keep
    their order. Between the first and second edge of a strip, the third and fourth and so on lies the ring's inside: holes
    and rings that cross themselves count by the even-odd rule. Corners that are null, NaN or infinite make no part."""
    ring = np.asarray(ring, float).reshape(-1, 2)
    if len(ring) < 3 or not np.isfinite(ring).all():
        return []
    p, q = ring, np.roll(ring, -1, 0)
    on = p[:, 0] != q[:, 0]
    p, q = p[on], q[on]
    if not len(p):
        return []
    # crossings of edges i and j: p_i + t (q_i - p_i) with t and the other's s in 0 to 1
    d = q - p
    i, j = np.triu_indices(len(p), 1)
    turn = _cross(d[i], d[j])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = _cross(p[j] - p[i], d[j]) / turn
        s = _cross(p[j] - p[i], d[i]) / turn
        met = (turn != 0) & (t > 0) & (t < 1) & (s > 0) & (s < 1)
        crossings = p[i, 0] + t * d[i, 0]
    xs = np.unique(np.concatenate([ring[:, 0], crossings[met], [c for c in cuts if ring[:, 0].min() < c < ring[:, 0].max()]]))
    low, high = np.minimum(p[:, 0], q[:, 0]), np.maximum(p[:, 0], q[:, 0])
    slope = d[:, 1] / d[:, 0]
    out = []
    for a, b in zip(xs[:-1], xs[1:], strict=True):
        over = np.flatnonzero((low <= a) & (high >= b))
        at = [p[over, 1] + (x - p[over, 0]) * slope[over] for x in (a, b)]
        order = np.argsort(at[0] + at[1], kind="stable")
        for k in range(0, len(order) - 1, 2):
            u, v = order[k], order[k + 1]
            part = np.array([(a, at[0][u]), (b, at[1][u]), (b, at[1][v]), (a, at[0][v])])
            if area(part) > TINY:
                out.append(part)
    return out


def turned_parts(ring: np.ndarray) -> list[np.ndarray]:
    """convex_parts of a ring of longitudes and latitudes, within -180 to 180: what crosses 180 degrees is cut there and turned back.
    Edges go the short way around; rings around a pole have none."""
    ring = np.asarray(ring, float).reshape(-1, 2)
    if len(ring) < 3 or not np.isfinite(ring).all():
        return []
    ring = unwrapped(ring)
    turns = [180.0 + 360.0 * k for k in range(int((ring[:, 0].max() + 180) // 360) + 1)]
    out = []
    for part in convex_parts(ring, tuple(turns)):
        shift = np.floor((part[:, 0].mean() + 180) / 360) * 360
        out.append(part - np.array([shift, 0.0]))
    return out


def _half(ring: np.ndarray, p: np.ndarray, q: np.ndarray, inside: bool) -> np.ndarray:
    """The part of a convex ring left of the line from p to q (inside), or right of it."""
    if not len(ring):
        return ring
    side = _cross(q - p, ring - p) * (1 if inside else -1)
    after, before = np.roll(ring, -1, 0), np.roll(side, -1)
    out = []
    for k in range(len(ring)):
        if side[k] >= 0:
            out.append(ring[k])
        if (side[k] > 0 > before[k]) or (side[k] < 0 < before[k]):
            out.append(ring[k] + (after[k] - ring[k]) * (side[k] / (side[k] - before[k])))
    return np.array(out).reshape(-1, 2)


def _left_turning(ring: np.ndarray) -> np.ndarray:
    return ring[::-1] if _cross(ring, np.roll(ring, -1, 0)).sum() < 0 else ring


def clip(part: np.ndarray, by: np.ndarray) -> np.ndarray:
    """What two convex rings share, a convex ring or an empty one."""
    by = _left_turning(by)
    for p, q in zip(by, np.roll(by, -1, 0), strict=True):
        part = _half(part, p, q, True)
    return part if area(part) > TINY else part[:0]


def subtract(parts: list[np.ndarray], by: np.ndarray) -> list[np.ndarray]:
    """Convex parts without what a convex ring covers, as convex parts: along each edge of the ring, what lies outside is cut off."""
    by, out = _left_turning(by), []
    low, high = by.min(0), by.max(0)
    for part in parts:
        if (part.max(0) <= low).any() or (part.min(0) >= high).any():
            out.append(part)
            continue
        rest = part
        for p, q in zip(by, np.roll(by, -1, 0), strict=True):
            if (p == q).all():
                continue
            off = _half(rest, p, q, False)
            if area(off) > TINY:
                out.append(off)
            rest = _half(rest, p, q, True)
            if area(rest) <= TINY:
                break
    return out
