"""Sparse quadtree of polygons: which tile a point is in tells whether it is inside, or which few sides decide.

The plane is a square that is cut into quarters again and again. A tile that no side passes is inside or outside a
feature as a whole; one that few sides pass keeps them; any other one is cut further, several levels at a time. So tiles are
small where the outline is dense, and their number grows with the outline, not with the points that are looked up.

Whether a point of a tile is inside follows from the tile's sides alone, by the even-odd rule along a path: from the point
to the right until the tile's right edge, then along that edge down to its lower corner, whose parity is known. A side
that ends beyond that edge counts once more if that end lies above the point; its other crossings are part of the parity.
A crossing is the same expression as in a test against all sides, so results do not differ by rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import materialise

#: Sides a tile may keep, and sides of one feature in it; each of the latter has a column in the tile's row.
LEAF, SLOTS = 32, 2
#: Rows that the first round of cutting makes, about; and levels cut at once in the later ones.
ROUND_ROWS, STEP = 1 << 20, 2
#: Levels at most; the tiles of the last one keep all their sides, such as many that share a corner.
DEPTH = 24
#: Rounds of cutting that do not part the sides of a tile before it stays as it is.
STUCK = 4
#: Where the square begins, in parts of its size, so that tile edges do not run along round coordinates.
_OFFSET = 0.0437208171
#: Slack of the test whether a side passes a tile, in parts of the square: far above rounding, far below a tile.
_SLACK = 2.0**-44

SIDE = ["x1", "y1", "x2", "y2"]


@dataclass(frozen=True)
class Square:
    """The whole tree's square: lower-left corner and size, a power of two."""

    x0: float
    y0: float
    size: float

    def cell(self, level: int) -> float:
        return self.size / (1 << level)

    def place(self, x: Column, y: Column, level: int) -> tuple[Column, Column]:
        """Tile numbers of a point."""
        cell = F.lit(self.cell(level))
        return F.floor((x - F.lit(self.x0)) / cell), F.floor((y - F.lit(self.y0)) / cell)


def tile_key(level: int | Column, ix: Column, iy: Column) -> Column:
    """One number for a tile: level, then its two numbers."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(level.cast("long"), 56) + F.shiftleft(ix.cast("long"), 28) + iy.cast("long")


@dataclass(frozen=True)
class _Extent:
    """The sides, written down, their number, the sum of their heights, and a square that holds them."""

    sides: DataFrame
    count: int
    heights: float
    square: Square | None


def _extent(sides: DataFrame, margin: float = 0.0) -> _Extent:
    """Extent of the sides with ``margin`` around them and room to spare."""
    written = materialise(sides, "quadtree-sides")
    bounds = [(F.min, F.least, "x", "west"), (F.min, F.least, "y", "south"), (F.max, F.greatest, "x", "east"), (F.max, F.greatest, "y", "north")]
    told = [fold(pick(f"{axis}1", f"{axis}2")).alias(name) for fold, pick, axis, name in bounds]
    box = written.agg(F.count("*").alias("n"), F.sum(F.abs(F.col("y2") - F.col("y1"))).alias("heights"), *told).first()
    if box["west"] is None:
        return _Extent(written, 0, 0.0, None)
    extent = max(box["east"] - box["west"], box["north"] - box["south"], 1e-6) + 2 * margin
    size = 2.0 ** math.ceil(math.log2(extent * 1.2))
    square = Square(box["west"] - margin - _OFFSET * size, box["south"] - margin - _OFFSET * size, size)
    return _Extent(written, box["n"], box["heights"], square)


def _side(at: Column | None) -> list[Column]:
    return [F.col(c) if at is None else at[c] for c in SIDE]


def crossed(x: Column, y: Column, at: Column | None = None) -> Column:
    """Whether the ray from (x, y) to the right crosses a side; ``at`` is a struct that holds it."""
    x1, y1, x2, y2 = _side(at)
    right = F.when((y1 > y) != (y2 > y), x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return F.coalesce(right, F.lit(False))


def _beyond(edge: Column) -> Column:
    """Height of the end of a side that lies beyond a tile's right edge; NULL if not just one does."""
    x1, y1, x2, y2 = _side(None)
    return F.when((x1 > edge) & (x2 <= edge), y1).when((x2 > edge) & (x1 <= edge), y2)


def _counts(edge: Column) -> Column:
    """Whether a side counts in a tile: one that is all beyond the right edge is crossed on the way there or not at all."""
    return (F.col("x1") <= edge) | (F.col("x2") <= edge)


def _turned(x: Column, y: Column, beyond: Column, at: Column | None = None) -> Column:
    """Whether a side changes the parity between (x, y) and the path's end."""
    return crossed(x, y, at) != F.coalesce(beyond > y, F.lit(False))


def side_meets_box(west: Column, south: Column, east: Column, north: Column, at: Column | None = None) -> Column:
    """Separating-axis test of a side against a closed box."""
    x1, y1, x2, y2 = _side(at)
    overlap = (F.least(x1, x2) <= east) & (F.greatest(x1, x2) >= west) & (F.least(y1, y2) <= north) & (F.greatest(y1, y2) >= south)

    def turn(cx: Column, cy: Column) -> Column:
        return (x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1)

    corners = [turn(cx, cy) for cx in (west, east) for cy in (south, north)]
    return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def _near_box(west: Column, south: Column, east: Column, north: Column, slack: float) -> Column:
    """A side passes the box or comes within ``slack`` of it; may also hold for a side that just misses it."""
    s = F.lit(slack)
    return side_meets_box(west - s, south - s, east + s, north + s)


@dataclass(frozen=True)
class Quadtree:
    """Tiles ``(level, ix, iy, key, fid, covered, ...)``, a row per tile and feature that meets it; see ``build``.

    The tiles of one feature do not overlap, so a point is in one of them at most; those of different features may. ``wide``
    tells that some tile has more sides of a feature than there are columns for them.
    """

    square: Square
    levels: tuple[int, ...]
    tiles: DataFrame
    wide: bool = False

    def _keys(self, x: Column, y: Column) -> list[Column]:
        """Key of a point's tile on each level; NULL for a NaN or a place outside the square."""
        low, size = (self.square.x0, self.square.y0), self.square.size
        within = x.between(low[0], low[0] + size) & y.between(low[1], low[1] + size)
        return [F.when(within, tile_key(level, *self.square.place(x, y, level))) for level in self.levels]

    @staticmethod
    def where(points: DataFrame, lookups: list[tuple[Quadtree, Column, Column, Callable[[Column, Column], Column]]]) -> DataFrame:
        """``points`` for which any lookup ``(tree, x, y, test)`` finds a row of their tile that passes ``test(x, y)``.

        One existence join per level, in one pass over the points and whatever the number of rows that pass.
        """
        made, found = [], F.lit(False)
        for n, (tree, x, y, test) in enumerate(lookups):
            keys = {level: f"_key_{n}_{level}" for level in tree.levels}
            made += [x.alias(f"_x_{n}"), y.alias(f"_y_{n}"), *[key.alias(name) for key, name in zip(tree._keys(x, y), keys.values())]]
            for level, name in keys.items():
                own = tree.tiles.where(F.col("level") == level).withColumnsRenamed({c: f"_t_{c}" for c in tree.tiles.columns})
                same = F.col("_t_key") == F.col(name).outer()
                found = found | own.where(same & test(F.col(f"_x_{n}").outer(), F.col(f"_y_{n}").outer())).exists()
        # Generated columns are worked out once; others would be copied into every test.
        return points.select("*", F.inline(F.array(F.struct(*made)))).where(found).select(*points.columns)

    def with_features(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """``points`` once per feature that holds them, with its ``fid``."""
        own = self.tiles.withColumnsRenamed({c: f"_t_{c}" for c in self.tiles.columns})
        keyed = points.withColumn("_key", F.explode(F.array(*self._keys(F.col(x), F.col(y))))).where("_key IS NOT NULL")
        held = (F.col("_key") == F.col("_t_key")) & self.holds(F.col(x), F.col(y))
        return keyed.join(own, held).select(*points.columns, F.col("_t_fid").alias("fid"))

    def holds(self, x: Column, y: Column) -> Column:
        """Whether the feature of a row of the point's tile holds the point."""
        odd = F.col("_t_odd")
        for k in range(SLOTS):
            side = F.col(f"_t_side_{k}")
            odd = odd != _turned(x, y, side["beyond"], side)
        if self.wide:
            more = F.aggregate("_t_more", F.lit(False), lambda turned, side: turned != _turned(x, y, side["beyond"], side))
            odd = odd != F.coalesce(more, F.lit(False))
        return F.col("_t_covered") | odd


_BOX = ["_west", "_south", "_east", "_north"]


def _boxed(tiles: DataFrame, square: Square, level: int) -> DataFrame:
    """Adds the tile's box."""
    cell = F.lit(square.cell(level))
    west, south = F.lit(square.x0) + F.col("ix") * cell, F.lit(square.y0) + F.col("iy") * cell
    return tiles.withColumns({"_west": west, "_south": south, "_east": F.lit(square.x0) + (F.col("ix") + 1) * cell, "_north": F.lit(square.y0) + (F.col("iy") + 1) * cell})


def _quartered(rows: DataFrame, step: int) -> DataFrame:
    """``rows`` once per part of their tile, ``step`` levels down, which becomes their tile."""
    across = 1 << step
    part = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(across * across - 1))))
    return part.withColumns({"ix": F.col("ix") * across + F.col("_part") % across, "iy": F.col("iy") * across + F.floor(F.col("_part") / across)}).drop("_part")


def _first_parts(extent: _Extent) -> tuple[DataFrame, int]:
    """The first cut, as ``_quartered`` makes it, and its level: as deep as ``ROUND_ROWS`` allow.

    A side meets all tiles of the bands that it reaches into: what is right of it counts for those to its left.
    """
    square, level = extent.square, 2
    while level < 6 and (extent.heights * 2 ** (level + 1) / square.size + extent.count) * 2 ** (level + 1) <= ROUND_ROWS:
        level += 1
    cell, slack = square.cell(level), square.size * _SLACK
    low, high = F.least("y1", "y2") - F.lit(square.y0 + slack), F.greatest("y1", "y2") - F.lit(square.y0 - slack)
    bands = F.sequence(F.floor(low / cell), F.floor(high / cell))
    across = F.sequence(F.lit(0).cast("long"), F.lit((1 << level) - 1).cast("long"))
    return extent.sides.withColumn("iy", F.explode(bands)).withColumn("ix", F.explode(across)), level


def _crowded(sizes: DataFrame, leaf: int) -> tuple[DataFrame, int]:
    """Tiles ``(ix, iy)`` that hold too many sides, of ``sizes(ix, iy, _n)``, and the number of these."""
    crowded = sizes.where(F.col("_n") > leaf)
    return crowded.select("ix", "iy"), crowded.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def _cut(sizes: DataFrame, keys: list[str], crowded: Column, level: int) -> DataFrame:
    """``sizes(ix, iy, *keys, _n, _within, _stuck)`` with ``_stuck`` counted on and whether ``_cut`` applies to a row.

    Sides that lie on each other fill ever more tiles without ever parting. A tile in which most of its parent's sides
    are left, among others that hold more together than the parent did, is stuck; one is not cut after ``STUCK`` such rounds.
    """
    family = Window.partitionBy(*keys, F.floor(F.col("ix") / (1 << STEP)), F.floor(F.col("iy") / (1 << STEP)))
    spread = (F.sum(F.when(crowded, F.col("_n"))).over(family) > 2 * F.col("_within")) & (2 * F.col("_n") > F.col("_within"))
    stuck = sizes.withColumn("_stuck", F.when(spread, F.col("_stuck") + 1).otherwise(0))
    return stuck.withColumn("_cut", crowded & (F.col("_stuck") < STUCK) & F.lit(level + STEP <= DEPTH))


def _union(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def _told(sizes: DataFrame, own: str) -> tuple[int, bool]:
    """Sides still to be cut, and whether a tile that stays has more sides of a feature than there are columns."""
    told = sizes.agg(F.sum(F.when(F.col("_cut"), F.col("_n"))).alias("rows"), F.max(F.when(~F.col("_cut"), F.col(own))).alias("most")).first()
    return told["rows"] or 0, (told["most"] or 0) > SLOTS


def _own_tiles(parity: DataFrame, kept: DataFrame, level: int) -> tuple[DataFrame, DataFrame, int, bool]:
    """Sides ``kept`` of the tiles with whether these are cut, covered tiles, and what ``_told`` says: each feature by itself."""
    parity = materialise(_cut(parity, ["fid"], F.col("_n") > SLOTS, level), "quadtree-parity")
    rows, wide = _told(parity, "_n")
    of = parity.where("_n > 0").select("ix", "iy", "fid", "odd", F.col("_n").alias("_within"), "_stuck", "_cut")
    current = kept.join(of, ["ix", "iy", "fid"])
    return materialise(current, "quadtree-sides") if rows else current, parity.where("_n = 0"), rows, wide


def _shared_tiles(parity: DataFrame, kept: DataFrame, leaf: int, level: int) -> tuple[DataFrame, DataFrame, int, bool]:
    """As ``_own_tiles``, for the union of the features: no other rows where one covers a tile, one of those that are alike in it."""
    parity = materialise(parity, "quadtree-parity")
    covers = materialise(parity.where("_n = 0").groupBy("ix", "iy").agg(F.min("fid").alias("fid")), "quadtree-covered")
    open_ = parity.where("_n > 0").join(covers.select("ix", "iy"), ["ix", "iy"], "left_anti").withColumnRenamed("_n", "_own")
    sided = kept.join(open_, ["ix", "iy", "fid"])
    once = [F.max(c).alias(c) for c in ("_own", "_within", "_stuck")]
    few = sided.where(F.col("_own") <= leaf).groupBy("ix", "iy", "fid", "odd").agg(F.sort_array(F.collect_list(F.struct(*SIDE))).alias("_all"), *once)
    few = few.groupBy("ix", "iy", "odd", "_all").agg(F.min("fid").alias("fid"), *once).select("*", F.inline("_all")).select(*sided.columns)
    sided = materialise(few.unionByName(sided.where(F.col("_own") > leaf)), "quadtree-sides")
    sizes = sided.groupBy("ix", "iy").agg(F.count("*").alias("_n"), *once)
    sizes = materialise(_cut(sizes, [], (F.col("_n") > leaf) | (F.col("_own") > SLOTS), level), "quadtree-sizes")
    rows, wide = _told(sizes, "_own")
    of = sizes.select("ix", "iy", F.col("_n").alias("_within"), "_stuck", "_cut")
    return sided.drop("_own", "_within", "_stuck").join(of, ["ix", "iy"]), covers, rows, wide


def build(sides: DataFrame, leaf: int = LEAF, merged: bool = False) -> Quadtree | None:
    """Quadtree of the features ``sides(fid, x1, y1, x2, y2)``, whose rings are closed; None without sides.

    A row per tile and feature: ``covered`` where the feature holds the whole tile; else the parity ``odd`` at the path's end
    and the feature's sides there, ``side_0`` and so on, with ``more`` for what these cannot hold. Each feature is cut by its
    own sides alone, so that features that overlap or repeat each other cost their own tiles and no more. ``merged`` tells
    only whether any feature holds a point: features share the tiles, which keep up to ``leaf`` sides; where one covers a tile
    or several are alike in it, one row stands for all. The rounds grow with the logarithm of the sides, and no round brings
    the sides of a feature or of a tile that is still to be cut together: sides are dealt to tiles, parities are sums over sides.
    """
    extent = _extent(sides.select(F.col("fid").cast("long").alias("fid"), *SIDE))
    square, rows = extent.square, extent.count
    if square is None:
        return None
    slack = square.size * _SLACK
    current, level, wide = None, 0, False
    done, levels = [], []
    while rows:
        # Each part of a crowded tile: the parity at its corner from all sides of the tile, and the sides that pass it.
        if current is None:
            todo, level = _first_parts(extent)
            parts = todo.withColumns({"odd": F.lit(0).cast("long"), "_beyond": F.lit(None).cast("double"), "_counts": F.lit(True)})
            parts = parts.withColumns({"_within": F.lit(None).cast("long"), "_stuck": F.lit(0)})
        else:
            edge = F.lit(square.x0) + (F.col("ix") + 1) * F.lit(square.cell(level))
            parts, level = _quartered(current.where("_cut").withColumns({"_beyond": _beyond(edge), "_counts": _counts(edge)}), STEP), level + STEP
        dealt = _boxed(parts, square, level)
        east, south = F.col("_east"), F.col("_south")
        passes = _near_box(F.col("_west"), south, east, F.col("_north"), slack)
        outer = _beyond(east)
        start = F.coalesce(passes & (crossed(east, south) != (outer > south)), F.lit(False))
        turned = F.col("_counts") & _turned(east, south, F.col("_beyond"))
        turns = turned.cast("long") + start.cast("long")
        dealt = dealt.select("ix", "iy", "fid", "odd", "_within", "_stuck", passes.alias("_passes"), turns.alias("_turns"), *SIDE)
        parity = dealt.groupBy("ix", "iy", "fid").agg(
            ((F.max("odd") + F.sum("_turns")) % 2).alias("odd"), F.sum(F.col("_passes").cast("long")).alias("_n"),
            F.max("_within").alias("_within"), F.max("_stuck").alias("_stuck"),
        )
        parity, kept = parity.where("_n > 0 OR odd = 1"), dealt.where("_passes").select("ix", "iy", "fid", *SIDE)
        current, covers, rows, more_sides = _shared_tiles(parity, kept, leaf, level) if merged else _own_tiles(parity, kept, level)
        wide = wide or more_sides
        edge = F.lit(square.x0) + (F.col("ix") + 1) * F.lit(square.cell(level))
        side = F.when(_counts(edge), F.struct(*SIDE, _beyond(edge).alias("beyond")))
        decided = current.where("NOT _cut").groupBy("ix", "iy", "fid").agg((F.max("odd") % 2 == 1).alias("odd"), F.collect_list(side).alias("_sides"))
        slots = [F.get("_sides", F.lit(k)).alias(f"side_{k}") for k in range(SLOTS)]
        more = F.when(F.size("_sides") > SLOTS, F.slice("_sides", SLOTS + 1, F.size("_sides"))).alias("more")
        tiles = decided.select("ix", "iy", "fid", F.lit(False).alias("covered"), "odd", *slots, more)
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in tiles.schema.fields[4:]]
        tiles = tiles.unionByName(covers.select("ix", "iy", "fid", F.lit(True).alias("covered"), *none))
        done.append(tiles.withColumn("level", F.lit(level)))
        levels.append(level)
    tiles = _union(done).withColumn("key", tile_key(F.col("level"), F.col("ix"), F.col("iy")))
    return Quadtree(square, tuple(levels), materialise(tiles, "quadtree"), wide)


def distance_squared(px: Column, py: Column, at: Column | None = None) -> Column:
    """Squared distance of a point from a side."""
    x1, y1, x2, y2 = _side(at)
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.nullif(length2, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def build_near(sides: DataFrame, distance: float, leaf: int = LEAF) -> Quadtree | None:
    """Quadtree of the places within ``distance`` of any of ``sides``, on a plane; None without sides.

    A tile's least and greatest distance from the sides decide it as a whole where they can: ``covered`` tiles lie within
    the distance, absent ones beyond it; the others have a row ``(x1, y1, x2, y2)`` per side that may be near enough.
    """
    extent = _extent(sides.select(*SIDE), distance)
    square, rows = extent.square, extent.count
    if square is None:
        return None
    zero = F.lit(0).cast("long")
    level, current, crowded, done, levels = 0, extent.sides.select(zero.alias("ix"), zero.alias("iy"), *SIDE), None, [], []
    while rows:
        step = STEP if level else max(STEP, min(6, int(math.log(max(ROUND_ROWS / rows, 1), 4))))
        level += step
        todo = current if crowded is None else current.join(crowded, ["ix", "iy"], "left_semi").drop("covered")
        dealt = _boxed(_quartered(todo, step), square, level)
        # A distance changes by no more than the way from the tile's centre, half its diagonal at most.
        away = F.sqrt(distance_squared((F.col("_west") + F.col("_east")) / 2, (F.col("_south") + F.col("_north")) / 2))
        reach = square.cell(level) * math.sqrt(0.5) + square.size * _SLACK
        reached = dealt.withColumn("_away", away).where(F.col("_away") <= distance + reach)
        reached = materialise(reached.select("ix", "iy", *SIDE, (F.col("_away") + reach <= distance).alias("covered")), "quadtree-sides")
        # One row stands for a tile that lies within the distance.
        whole = reached.where("covered").dropDuplicates(["ix", "iy"])
        current = reached.join(whole.select("ix", "iy"), ["ix", "iy"], "left_anti").unionByName(whole)
        sizes = current.where("NOT covered").groupBy("ix", "iy").agg(F.count("*").alias("_n"))
        crowded, rows = _crowded(sizes, leaf)
        rest = current
        if level + STEP > DEPTH:
            rows = 0
        elif rows:
            current, crowded = materialise(current, "quadtree-sides"), materialise(crowded, "quadtree-crowded")
            rest = current.join(crowded, ["ix", "iy"], "left_anti")
        done.append(rest.withColumn("level", F.lit(level)))
        levels.append(level)
    tiles = _union(done).withColumn("key", tile_key(F.col("level"), F.col("ix"), F.col("iy")))
    return Quadtree(square, tuple(levels), materialise(tiles, "quadtree-near"))


def is_near(distance: float) -> Callable[[Column, Column], Column]:
    """Test of a row of a ``build_near`` tile: whether a point of the tile is within the distance."""

    def test(x: Column, y: Column) -> Column:
        x1, y1, x2, y2 = (F.col(f"_t_{c}") for c in SIDE)
        side = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
        return F.col("_t_covered") | (distance_squared(x, y, side) <= distance * distance)

    return test


def boxes_that_meet(boxes: DataFrame, tree: Quadtree) -> DataFrame:
    """Those of ``boxes(west, south, east, north)`` that a side of the tree's features meets.

    A box is covered by the up to four cells of the level at which a cell is no smaller than it, so large boxes have large
    cells and small ones small cells. Cells and tiles meet where one is the other or lies in it, which is an equality
    with one of its ancestors, either way round; the sides of such tiles are then tested.
    """
    corners = ["west", "south", "east", "north"]
    square = tree.square
    size = F.lit(square.size)
    inside = {c: F.least(F.greatest(F.col(c) - F.lit(o), F.lit(0.0)), size * (1 - 2.0**-30)) for c, o in zip(corners, (square.x0, square.y0) * 2)}
    extent = F.greatest(inside["east"] - inside["west"], inside["north"] - inside["south"], size * 2.0 ** -(DEPTH - 1))
    placed = boxes.withColumn("_level", F.floor(F.log2(size / extent)).cast("int"))
    placed = placed.withColumn("_cell", size / F.pow(F.lit(2.0), F.col("_level")))
    across, along = (F.sequence(F.floor(inside[a] / F.col("_cell")), F.floor(inside[b] / F.col("_cell"))) for a, b in (("west", "east"), ("south", "north")))
    cells = placed.withColumn("_ix", F.explode(across)).withColumn("_iy", F.explode(along))

    def above(level: Column, ix: Column, iy: Column, to: Column) -> Column:
        by = F.pow(F.lit(2.0), level - to)
        return tile_key(to, F.floor(ix / by), F.floor(iy / by))

    columns = [F.col(f"side_{k}") for k in range(SLOTS)]
    every = F.concat(F.filter(F.array(*columns), lambda side: side.isNotNull()), F.coalesce("more", F.array().cast(tree.tiles.schema["more"].dataType)))
    sides = tree.tiles.where("NOT covered").select("level", "ix", "iy", "key", F.inline(every)).drop("beyond")
    meets = side_meets_box(*[F.col(c) for c in corners])
    levels = F.filter(F.array(*[F.lit(n) for n in tree.levels]), lambda n: n <= F.col("_level"))
    upwards = cells.withColumn("_to", F.explode(levels))
    upwards = upwards.select(*corners, above(F.col("_level"), F.col("_ix"), F.col("_iy"), F.col("_to")).alias("_key"))
    own = upwards.join(sides.select("key", *SIDE), (F.col("_key") == F.col("key")) & meets, "left_semi")
    downwards = cells.select(*corners, tile_key(F.col("_level"), F.col("_ix"), F.col("_iy")).alias("_key"))
    lower = sides.where("level > 0").withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("level") - 1)))
    lower = lower.select(above(F.col("level"), F.col("ix"), F.col("iy"), F.col("_to")).alias("key"), *SIDE)
    under = downwards.join(lower, (F.col("_key") == F.col("key")) & meets, "left_semi")
    return own.select(*corners).unionByName(under.select(*corners)).distinct()
