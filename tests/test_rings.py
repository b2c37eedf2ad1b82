"""Rings of any shape against a grid integral, and covers against one-at-a-time greedy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.functions import rings
from gridquarry.operators import joins, shapes

SHAPES = {
    "arrow": [(0, 0), (4, 0), (4, 3), (2, 1), (0, 3)],
    "bow tie": [(0, 0), (3, 3), (3, 0), (0, 3)],
    "star": [(np.cos(4 * np.pi * k / 5) * 2, np.sin(4 * np.pi * k / 5) * 2) for k in range(5)],
    "comb": [(0, 0), (5, 0), (5, 2), (4, 2), (4, 0.5), (3, 0.5), (3, 2), (2, 2), (2, 0.5), (1, 0.5), (1, 2), (0, 2)],
    "closed": [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)],
}


def inside(ring, x, y):
    """Even-odd rule at points."""
    ring = np.asarray(ring, float)
    found = np.zeros(x.shape, bool)
    for (a, b), (c, d) in zip(ring, np.roll(ring, -1, 0), strict=True):
        if b != d:
            found ^= ((b > y) != (d > y)) & (x < a + (y - b) * (c - a) / (d - b))
    return found


def grid(low, high, n=2000):
    x, y = ((np.arange(n) + 0.5) / n * (b - a) + a for a, b in zip(low, high, strict=True))
    return *np.meshgrid(x, y), np.prod(np.subtract(high, low)) / n**2


@pytest.mark.parametrize("name", SHAPES)
def test_parts_of_a_ring(name):
    ring = np.array(SHAPES[name], float)
    parts = rings.convex_parts(ring)
    x, y, cell = grid(ring.min(0) - 0.1, ring.max(0) + 0.1)
    assert sum(map(rings.area, parts)) == pytest.approx(inside(ring, x, y).sum() * cell, abs=1e-3 * 12)
    assert sum(rings.area(rings.clip(a, b)) for k, a in enumerate(parts) for b in parts[:k]) == pytest.approx(0, abs=1e-9)
    for part in parts:  # convex: all turns to one side
        turns = rings._cross(np.roll(part, -1, 0) - part, np.roll(part, -2, 0) - np.roll(part, -1, 0))
        assert (turns >= -1e-9).all() or (turns <= 1e-9).all()


def test_difference_and_clip_add_up():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rings.convex_parts(rng.normal(size=(5, 2))), rings.convex_parts(rng.normal(size=(4, 2)))
        shared, left = 0.0, a
        for part in b:
            shared += sum(rings.area(rings.clip(x, part)) for x in a)
            left = rings.subtract(left, part)
        assert shared + sum(map(rings.area, left)) == pytest.approx(sum(map(rings.area, a)))


def ring_table(spark, named, key):
    rows = [(k, [(float(x), float(y)) for x, y in ring]) for k, ring in named]
    return spark.createDataFrame(rows, f"{key} string, ring array<struct<lon:double,lat:double>>")


def test_join_of_any_rings(spark):
    """Concave, crossing and holed rings, both sides, to a thousandth of a grid integral; date line between two of them."""
    left = [(k, np.add(v, (10, 5))) for k, v in SHAPES.items()]
    right = [("zig", np.add([(0, 0.2), (5, 0.2), (1, 1.5), (5, 2.5), (0, 2.8), (3, 1.5)], (9.5, 5))), ("eight", np.add([(0, 0), (4, 2), (4, 0), (0, 2)], (10.2, 4.6)))]
    x, y, cell = grid((7.0123, 2.0077), (16.0031, 9.0059), 3001)
    want = {(a, b): float((inside(p, x, y) & inside(q, x, y)).sum() * cell) for a, p in left for b, q in right}
    got = {(r["a"], r["b"]): r["area"] for r in joins.ring_join(ring_table(spark, left, "a"), ring_table(spark, right, "b"), "a", "b", 1.0).collect()}
    assert set(got) == {k for k, v in want.items() if v > 0}
    assert all(got[k] == pytest.approx(want[k], abs=4e-3) for k in got)
    west = [("w", [(179, 0), (-179, 0), (-179, 2), (179, 2)]), ("none", [(0, 0), (1, 1)]), ("nan", [(0, 0), (float("nan"), 1), (1, 0)])]
    east = [("e", [(-180, 1), (-170, 1), (-170, 9), (-180, 9)]), ("turned", [(180, 1), (190, 1), (190, 9), (180, 9)])]
    got = joins.ring_join(ring_table(spark, west, "a"), ring_table(spark, east, "b"), "a", "b", 1.0).collect()
    assert sorted((r["a"], r["b"], round(r["area"], 9)) for r in got) == [("w", "e", 1.0), ("w", "turned", 1.0)]


def test_rings_at_the_date_line(spark):
    got = shapes.split_dateline_rings(ring_table(spark, [("w", [(170, 0), (-150, 0), (-150, 2), (170, 2)]), ("in", SHAPES["comb"])], "a"), "a")
    rows = [(r["a"], np.array([(p["lon"], p["lat"]) for p in r["ring"]])) for r in got.collect()]
    assert all((np.abs(p[:, 0]) <= 180 + 1e-9).all() for _, p in rows)
    assert sum(rings.area(p) for a, p in rows if a == "w") == pytest.approx(80) and sum(rings.area(p) for a, p in rows if a == "w" and p[:, 0].min() > 0) == pytest.approx(20)
    assert sum(rings.area(p) for a, p in rows if a == "in") == pytest.approx(7.0)


def test_grid_tasks_of_rings(spark):
    ring = np.add(SHAPES["arrow"], (10.3, 5.1)) * 1.7
    got = joins.ring_grid_tasks(ring_table(spark, [("r", ring)], "roi_id"), 2.0).collect()
    low = ring.min(0)
    for r in got:
        x, y, cell = grid((r["x0"], r["y0"]), (r["x1"], r["y1"]), 700)
        assert r["area"] == pytest.approx(inside(ring, x, y).sum() * cell, abs=5e-3)
        assert r["area"] == pytest.approx(sum(rings.area(np.array([(p["lon"], p["lat"]) for p in piece])) for piece in r["pieces"]))
        assert (r["x0"] - low[0]) / 2 == pytest.approx(r["i"]) and r["x1"] <= ring[:, 0].max() + 1e-9
    assert sum(r["area"] for r in got) == pytest.approx(sum(map(rings.area, rings.convex_parts(ring))))


def brute_cover(boxes, roi, passes, share=0.01, least=1e-3):
    """One pick at a time, areas by a grid of all the boxes' edges. boxes: id, box, orbit, incidence."""
    xs = np.unique(np.clip([v for _, b, *_ in boxes for v in (b[0], b[2])] + [roi[0], roi[2]], roi[0], roi[2]))
    ys = np.unique(np.clip([v for _, b, *_ in boxes for v in (b[1], b[3])] + [roi[1], roi[3]], roi[1], roi[3]))
    cells = np.outer(np.diff(xs), np.diff(ys))
    of = {i: np.outer((xs[:-1] >= b[0]) & (xs[1:] <= b[2]), (ys[:-1] >= b[1]) & (ys[1:] <= b[3])) for i, b, *_ in boxes}
    left, total, picks = np.ones(cells.shape, bool), cells.sum(), []
    for number, (low, high) in enumerate(passes):
        if (cells * left).sum() / total < share:
            break
        gain = lambda i: (cells * (of[i] & left)).sum()  # noqa: E731, B023
        open_ = [(i, o) for i, _, o, inc in boxes if i not in {p for p, *_ in picks} and gain(i) > 0 and (inc is None or low <= inc <= high)]
        by_orbit = {}
        for i, o in open_:
            by_orbit.setdefault(o, []).append(gain(i))
        open_ = [i for i, o in open_ if len(by_orbit[o]) < 3 or gain(i) <= 6 * np.median(by_orbit[o])]
        while open_ and (cells * left).sum() / total >= share:
            best = min(open_, key=lambda i: (-round(gain(i), 9), i))
            if gain(best) < least:
                break
            picks.append((best, gain(best), number))
            left &= ~of[best]
            open_.remove(best)
    return picks


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cover_equals_greedy(spark, seed):
    from gridquarry.operators import coverage

    rng, boxes = np.random.default_rng(seed), []
    for k in range(120):
        x, y, w, h = rng.uniform(-1, 10), rng.uniform(-1, 6), rng.uniform(0.5, 3), rng.uniform(0.5, 2)
        boxes.append((f"p{k:03d}", (x, y, x + w * (4 if k % 29 == 0 else 1), y + h), int(k % 7), None if k % 13 == 0 else float(rng.uniform(20, 90))))
    roi = (0.0, 0.0, 10.0, 6.0)
    ring = lambda b: [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]
    df = spark.createDataFrame([(i, ring(b), o, inc, None) for i, b, o, inc in boxes], "product_id string, ring array<struct<lon:double,lat:double>>, orbit long, incidence double, resolution double")
    want = brute_cover(boxes, roi, [(30, 60), (30, 85), (30, 89.5), (0, 90)])
    got = [(r["product_id"], r["gain"], r["pass"]) for r in coverage.select_coverage(df, ring(roi), cell=1.0).orderBy("pick").collect()]
    assert [(i, n) for i, _, n in got] == [(i, n) for i, _, n in want]
    assert [g for _, g, _ in got] == pytest.approx([g for _, g, _ in want])
    assert len(want) > 15


def test_cover_of_any_shapes(spark):
    """Concave footprints and region: gains add up to what a grid says is covered; empty tables pick nothing."""
    from gridquarry.operators import coverage

    roi = np.array(SHAPES["arrow"]) * 2.0
    rng = np.random.default_rng(9)
    shapes_ = [np.array(SHAPES[n]) * rng.uniform(0.5, 1.5) + rng.uniform(-1, 5, 2) for n in list(SHAPES) * 6]
    df = ring_table(spark, [(f"p{k:02d}", s) for k, s in enumerate(shapes_)], "product_id").withColumns({"orbit": F.lit(None).cast("long"), "incidence": F.lit(45.0), "resolution": F.lit(1.0)})
    got = coverage.select_coverage(df, [tuple(map(float, p)) for p in roi], cell=1.0).collect()
    x, y, cell = grid(roi.min(0), roi.max(0))
    chosen = np.zeros(x.shape, bool)
    for r in got:
        chosen |= inside(shapes_[int(r["product_id"][1:])], x, y)
    assert sum(r["gain"] for r in got) == pytest.approx((chosen & inside(roi, x, y)).sum() * cell, abs=2e-2)
    assert coverage.select_coverage(df.limit(0), [tuple(map(float, p)) for p in roi]).count() == 0
