"""Clipping pixels to polygons, with holes and buffers, and filtering scenes by footprint.

Polygons are cut into a sparse quadtree once (see ``quadtree``). An observation is looked up by the tile it is in, an
equality join without a shuffle while the tiles are few enough to broadcast; neither the observations nor their distinct places
are read to prepare it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gridloom.functions.projection import EPSG_5070, Albers, project
from gridloom.operators import quadtree
from gridloom.operators.quadtree import Quadtree
from gridloom.shared import materialise
from gridloom.sources.boundary import total_bounds


def build_mask(sides: DataFrame) -> Quadtree | None:
    """Tiles of the features' union, written once for reuse; None without any."""
    return quadtree.build(sides, merged=True)


def _within(px: DataFrame, mask: Quadtree, x: str, y: str) -> DataFrame:
    """Rows inside the mask's square, a filter that the scan can use."""
    square = mask.square
    return px.where(F.col(x).between(square.x0, square.x0 + square.size) & F.col(y).between(square.y0, square.y0 + square.size))


def apply_mask(px: DataFrame, mask: Quadtree | None, x: str = "lon", y: str = "lat") -> DataFrame:
    """Rows whose point lies in any feature of the mask."""
    if mask is None:
        return px.where(F.lit(False))
    return Quadtree.where(_within(px, mask, x, y), [(mask, F.col(x), F.col(y), mask.holds)])


def clip(px: DataFrame, sides: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Pixels whose centre is inside any feature (even-odd rule, so holes are outside)."""
    return apply_mask(px, build_mask(sides), x, y)


def inside_features(points: DataFrame, sides: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """One row per point and feature that holds it."""
    mask = quadtree.build(sides)
    if mask is None:
        return points.where(F.lit(False)).withColumn("fid", F.lit(None).cast("long"))
    return mask.with_features(_within(points, mask, x, y), x, y)


def clip_buffer(px: DataFrame, sides: DataFrame, distance: float, crs: Albers = EPSG_5070) -> DataFrame:
    """Pixels inside the polygon or within ``distance`` metres of a side, measured on the projected plane."""
    (ax, ay), (bx, by) = project(F.col("x1"), F.col("y1"), crs), project(F.col("x2"), F.col("y2"), crs)
    inside = build_mask(sides)
    near = quadtree.build_near(sides.select(ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2")), distance)
    if inside is None or near is None:
        return px.where(F.lit(False))
    x, y = project(F.col("lon"), F.col("lat"), crs)
    return Quadtree.where(px, [(inside, F.col("lon"), F.col("lat"), inside.holds), (near, x, y, quadtree.is_near(distance))])


def _overlapping(scenes: DataFrame, box: Row) -> DataFrame:
    """Scenes whose footprint box overlaps a bounding box; none where there is no box."""
    if box.west is None:
        return scenes.where(F.lit(False))
    in_x = (F.col("west") <= box.east) & (F.col("east") >= box.west)
    return scenes.where(in_x & (F.col("south") <= box.north) & (F.col("north") >= box.south))


def filter_bbox(scenes: DataFrame, sides: DataFrame) -> DataFrame:
    """Scenes whose footprint box overlaps the bounding box of the features."""
    return _overlapping(scenes, total_bounds(sides).first())


def filter_bounds(scenes: DataFrame, sides: DataFrame) -> DataFrame:
    """Scenes whose footprint intersects the features.

    A box intersects a polygon if a side meets the box, or if no side does but a corner of the box is inside. Each distinct
    footprint is tested once; boxes and sides of any size meet through the tiles they share.
    """
    corners = ["west", "south", "east", "north"]
    mask = quadtree.build(sides)
    if mask is None:
        return scenes.where(F.lit(False))
    near = _overlapping(scenes, total_bounds(sides).first())
    boxes = materialise(near.select(*corners).distinct(), "footprints")
    touched = quadtree.boxes_that_meet(boxes, mask)
    cornered = apply_mask(boxes, mask, "west", "south").select(*corners)
    found = materialise(touched.unionByName(cornered).distinct(), "footprints-found")
    return near.join(found, corners, "left_semi")
