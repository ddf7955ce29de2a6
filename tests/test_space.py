"""Clipping, buffers, footprints, projection and regridding against brute force and worked examples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.projection import Albers, project, unproject
from gridloom.operators import clip, regrid
from gridloom.operators.composites import yearly_median


def _sides(spark, rings):
    """rings: {(fid, ring): [(x, y), ...]}"""
    rows = [
        (fid, ring, *points[i], *points[(i + 1) % len(points)])
        for (fid, ring), points in rings.items()
        for i in range(len(points))
    ]
    return spark.createDataFrame(rows, "fid BIGINT, ring INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"), rows


def _inside(rows, x, y, fid=None):
    crossings = sum(
        (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        for f, _, x1, y1, x2, y2 in rows
        if fid is None or f == fid
    )
    return crossings % 2 == 1


def _star(rng, cx, cy, corners, radius):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(cx + math.cos(a) * radius * rng.uniform(0.2, 1), cy + math.sin(a) * radius * rng.uniform(0.2, 1)) for a in angles]


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(3)
    rings = {(0, 0): _star(rng, 0, 0, 40, 5), (0, 1): _star(rng, 0, 0, 9, 1), (1, 0): _star(rng, 2, 1, 15, 3)}
    return _sides(spark, rings)


def _grid(spark, n=40, step=0.31):
    cells = spark.range(n * n).select((F.col("id") % n).alias("col"), F.floor(F.col("id") / n).alias("row"))
    return cells.withColumns({"lon": (F.col("col") - n / 2) * step + 0.013, "lat": (F.col("row") - n / 2) * step + 0.017})


def test_clip_is_even_odd_inside_any_feature(spark, shapes):
    sides, rows = shapes
    cells = _grid(spark)
    kept = {(r.row, r.col) for r in clip.clip(cells, sides).collect()}
    wanted = {
        (r.row, r.col) for r in cells.collect() if _inside(rows, r.lon, r.lat, 0) or _inside(rows, r.lon, r.lat, 1)
    }
    assert kept == wanted and kept


def test_clip_of_scattered_points(spark, shapes):
    sides, rows = shapes
    rng = random.Random(8)
    points = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(2000)]
    df = spark.createDataFrame(points, "id INT, lon DOUBLE, lat DOUBLE")
    found = {(r.id, r.fid) for r in clip.inside_features(df, sides).collect()}
    assert found == {(i, fid) for i, x, y in points for fid in (0, 1) if _inside(rows, x, y, fid)}


def test_clip_twice_changes_nothing_and_composite_stays_inside(spark, shapes):
    sides, _ = shapes
    px = _grid(spark).withColumns(
        {"dataset_id": F.lit("d"), "part": F.lit(0), "ts": F.lit("2001-02-03").cast("timestamp_ntz"), "v": F.col("row") * 1.0}
    )
    once = clip.clip(px, sides)
    assert clip.clip(once, sides).exceptAll(once).count() == 0
    assert clip.clip(once, sides).count() == once.count()
    composite = yearly_median(once, ["v"]).select("row", "col")
    assert composite.join(once, ["row", "col"], "left_anti").count() == 0


def test_clip_outside_everything_is_empty(spark, shapes):
    far = _grid(spark).withColumn("lat", F.col("lat") + 500)
    assert clip.clip(far, shapes[0]).count() == 0


def _distance(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = 0.0 if length2 == 0 else max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / length2))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def _flat(spark, lon_lat):
    """Projected coordinates of a list of points."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(lon_lat)], "i INT, lon DOUBLE, lat DOUBLE")
    x, y = project(F.col("lon"), F.col("lat"))
    return {r.i: (r.x, r.y) for r in df.select("i", x.alias("x"), y.alias("y")).collect()}


@pytest.mark.parametrize("distance", [0.0, 3_000.0, 60_000.0])
def test_buffer_equals_brute_force(spark, distance):
    rng = random.Random(21)
    ring = [(-100 + x, 38 + y) for x, y in _star(rng, 0, 0, 25, 3)]
    sides, rows = _sides(spark, {(0, 0): ring})
    cells = _grid(spark, 30, 0.25).withColumns({"lon": F.col("lon") - 100, "lat": F.col("lat") + 38})
    twice = cells.unionByName(cells)
    kept = [(r.row, r.col) for r in clip.clip_buffer(twice, sides, distance).collect()]
    listed = cells.collect()
    flat_cells = _flat(spark, [(r.lon, r.lat) for r in listed])
    corners = _flat(spark, ring)
    flat_sides = [(*corners[i], *corners[(i + 1) % len(ring)]) for i in range(len(ring))]
    wanted = {
        (r.row, r.col)
        for i, r in enumerate(listed)
        if _inside(rows, r.lon, r.lat) or min(_distance(*flat_cells[i], *side) for side in flat_sides) <= distance
    }
    assert set(kept) == wanted
    assert len(kept) == 2 * len(wanted)


def _segments_meet_box(x1, y1, x2, y2, w, s, e, n):
    """Clip the segment to the box by its parameter range."""
    low, high = 0.0, 1.0
    for start, delta, lower, upper in ((x1, x2 - x1, w, e), (y1, y2 - y1, s, n)):
        if delta == 0:
            if not lower <= start <= upper:
                return False
            continue
        a, b = sorted(((lower - start) / delta, (upper - start) / delta))
        low, high = max(low, a), min(high, b)
    return low <= high


def test_bounds_filter_equals_brute_force(spark, shapes):
    sides, rows = shapes
    rng = random.Random(17)
    boxes = []
    for i in range(1500):
        w, s, size = rng.uniform(-9, 8), rng.uniform(-9, 8), rng.choice([0.01, 0.4, 3.0, 30.0])
        boxes.append((i, w, s, w + size, s + size * rng.uniform(0.3, 1)))
    boxes += [(2000 + i, *boxes[i][1:]) for i in range(500)]
    scenes = spark.createDataFrame(boxes, "scene_id INT, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE")
    kept = sorted(r.scene_id for r in clip.filter_bounds(scenes, sides).collect())
    wanted = sorted(
        i
        for i, w, s, e, n in boxes
        if any(_segments_meet_box(*side[2:], w, s, e, n) for side in rows)
        or any(_inside(rows, w, s, fid) for fid in (0, 1))
    )
    assert kept == wanted
    assert 0 < len(kept) < len(boxes)


def test_albers_worked_example(spark):
    # Snyder's example on the Clarke 1866 ellipsoid.
    clarke = Albers(6378206.4, 0.00676866, 29.5, 45.5, 23.0, -96.0)
    x, y = project(F.lit(-75.0), F.lit(35.0), clarke)
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (row.x, row.y) == pytest.approx((1885472.7, 1535925.0), abs=0.1)


def test_projection_round_trip(spark):
    points = spark.range(2000).select((F.col("id") % 60 - 125.0).alias("lon"), (F.col("id") / 80 + 24.0).alias("lat"))
    x, y = project(F.col("lon"), F.col("lat"))
    lon, lat = unproject(F.col("x"), F.col("y"))
    back = points.withColumns({"x": x, "y": y}).select(F.abs(lon - F.col("lon")).alias("a"), F.abs(lat - F.col("lat")).alias("b"))
    worst = back.agg(F.max("a").alias("a"), F.max("b").alias("b")).first()
    assert worst.a < 1e-6 and worst.b < 1e-6


def test_projection_keeps_areas(spark):
    """A small degree cell has the same projected area anywhere along its parallel."""
    step = 0.01
    corners = [(lon + dx, 40 + dy) for lon in (-120, -96, -75) for dx, dy in ((0, 0), (step, 0), (step, step), (0, step))]
    flat = _flat(spark, [(float(x), float(y)) for x, y in corners])
    areas = []
    for k in range(3):
        ring = [flat[4 * k + i] for i in range(4)]
        areas.append(abs(sum(ring[i][0] * ring[i - 3][1] - ring[i - 3][0] * ring[i][1] for i in range(4))) / 2)
    assert areas[0] == pytest.approx(areas[1], rel=1e-6) and areas[2] == pytest.approx(areas[1], rel=1e-6)


def test_regrid_gathers_every_target_cell_once(spark):
    target = regrid.MasterGrid(-300_000.0, 1_500_000.0, 10_000.0, 40, 30)
    source = regrid.SourceGrid(-101.0, 35.0, 0.5, 0.5)
    cells = regrid.master_cells(spark, target)
    assert cells.count() == 1200
    index = regrid.gather_index(cells, source)
    lon, lat = unproject(F.col("x"), F.col("y"))
    wrong = index.withColumns({"lon": lon, "lat": lat}).where(
        "lon < -101.0 + col * 0.5 OR lon >= -101.0 + (col + 1) * 0.5 OR lat < 35.0 + row * 0.5 OR lat >= 35.0 + (row + 1) * 0.5"
    )
    assert wrong.count() == 0
    values = index.select("row", "col").distinct().withColumn("v", F.col("row") * 100 + F.col("col"))
    merged = regrid.regrid_nearest(values, index)
    assert merged.count() == 1200 and merged.select("grid_row", "grid_col").distinct().count() == 1200


def test_covering_grid_holds_the_polygon(spark):
    sides, _ = _sides(spark, {(0, 0): [(-105.0, 33.0), (-97.0, 32.5), (-96.5, 42.0), (-104.5, 41.0)]})
    grid = regrid.covering_grid(sides, 1000)
    x, y = project(F.col("x1"), F.col("y1"))
    box = sides.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert grid.x0 <= box[0] and grid.x0 + 1000 * grid.n_cols >= box[1]
    assert grid.y0 <= box[2] and grid.y0 + 1000 * grid.n_rows >= box[3]
    assert grid.x0 % 1000 == 0 and grid.y0 % 1000 == 0


def test_buffer_tells_grids_apart(spark):
    """Two datasets use the same row and column for places far apart."""
    sides, _ = _sides(spark, {(0, 0): [(-100.0, 38.0), (-99.0, 38.0), (-99.0, 39.0), (-100.0, 39.0)]})
    px = spark.createDataFrame([("a", 5, 7, -99.5, 38.5), ("b", 5, 7, -79.5, 38.5)], "dataset_id string, row int, col int, lon double, lat double")
    assert [r.dataset_id for r in clip.clip_buffer(px, sides, 1000.0).collect()] == ["a"]
