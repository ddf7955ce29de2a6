"""Queries over pixels: filters, clips, composites, regridding, projection, value functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.projection import EPSG_5070, project, snap, unproject
from gridloom.functions.status import days_since_epoch
from gridloom.functions.values import from_fill, palette_class, palette_colour, quicklook_byte, to_fill
from gridloom.operators import axes, clip, composites, filters, quality, regrid, scenes
from gridloom.plans import chunks, composite
from gridloom.shared import fresh_path
from gridloom.sources import boundary, clustered, pixels
from gridloom.workload.registered import Inputs, query
from gridloom.workload.source_queries import BANDS, GRID_SQL, INSIDE_AOI, stored_boundary

START, END = "1996-03-01", "2000-09-30"
IN_PERIOD = f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"


MEDIANS = "median(band_a) AS band_a, median(band_b) AS band_b, CAST(median(qa) AS DOUBLE) AS qa"


@query("yearly_median", f"""WITH {INSIDE_AOI}
    SELECT dataset_id, part, CAST(year(ts) AS INT) AS year, p.row, p.col, {MEDIANS}
    FROM {{px_obs}} p JOIN inside i ON p.row = i.row AND p.col = i.col WHERE {IN_PERIOD} GROUP BY ALL""")
def yearly_median(inputs: Inputs) -> DataFrame:
    kept = clip.clip(filters.filter_date(inputs.px_obs, START, END), inputs.aoi)
    return composites.yearly_median(kept, BANDS, keep=True)


@query("all_bands_composite", f"""
    SELECT dataset_id, part, CAST(year(ts) AS INT) AS year, row, col, {MEDIANS} FROM {{px_obs}} GROUP BY ALL""")
def all_bands_composite(inputs: Inputs) -> DataFrame:
    return composites.yearly_median(inputs.px_obs)


@query("band_select", "SELECT dataset_id, part, scene_id, ts, row, col, lon, lat, band_b FROM {px_obs}")
def band_select(inputs: Inputs) -> DataFrame:
    return pixels.select_bands(inputs.px_obs, ["band_b"])


@query("date_filter", f"SELECT scene_id, ts, row, col, band_a FROM {{px_obs}} WHERE {IN_PERIOD}")
def date_filter(inputs: Inputs) -> DataFrame:
    return filters.filter_date(inputs.px_obs, START, END).select("scene_id", "ts", "row", "col", "band_a")


@query("bounds_filter", """
    WITH box AS (SELECT min(least(x1, x2)) AS w, min(least(y1, y2)) AS s, max(greatest(x1, x2)) AS e,
            max(greatest(y1, y2)) AS n FROM {aoi}),
        near AS (SELECT scenes.* FROM {scenes}, box WHERE west <= e AND east >= w AND south <= n AND north >= s),
        boxes AS (SELECT DISTINCT west, east, south, north FROM near),
        turns AS (SELECT b.*, e.*, (x2 - x1) * (south - y1) - (y2 - y1) * (west - x1) AS t1,
                   (x2 - x1) * (north - y1) - (y2 - y1) * (west - x1) AS t2,
                   (x2 - x1) * (south - y1) - (y2 - y1) * (east - x1) AS t3,
                   (x2 - x1) * (north - y1) - (y2 - y1) * (east - x1) AS t4 FROM boxes b, {aoi} e),
        touched AS (SELECT DISTINCT west, south FROM turns
                    WHERE least(x1, x2) <= east AND greatest(x1, x2) >= west AND least(y1, y2) <= north
                      AND greatest(y1, y2) >= south AND least(t1, t2, t3, t4) <= 0 AND greatest(t1, t2, t3, t4) >= 0),
        cornered AS (SELECT west, south FROM boxes JOIN {aoi} e
                     ON (y1 > south) <> (y2 > south) AND west < (x2 - x1) * (south - y1) / (y2 - y1) + x1
                     GROUP BY west, south HAVING count(*) % 2 = 1)
    SELECT scene_id, acquired, west, south, east, north FROM near
    WHERE (west, south) IN (SELECT (west, south) FROM touched UNION SELECT (west, south) FROM cornered)""")
def bounds_filter(inputs: Inputs) -> DataFrame:
    return clip.filter_bounds(inputs.scenes, inputs.aoi).select("scene_id", "acquired", "west", "south", "east", "north")


@query("bbox_filter", """
    SELECT scene_id, west, south FROM {scenes} WHERE west <= -96.5 AND east >= -105 AND south <= 43.5 AND north >= 32.5""")
def bbox_filter(inputs: Inputs) -> DataFrame:
    return clip.filter_bbox(inputs.scenes, inputs.aoi).select("scene_id", "west", "south")


@query("finite_filter", """
    SELECT col, scene_id, value FROM {px_raw} WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)""")
def finite_filter(inputs: Inputs) -> DataFrame:
    return filters.finite(inputs.px_raw, "value").select("col", "scene_id", "value")


@query("fill_roundtrip", """
    SELECT col, scene_id, CASE WHEN masked IS NULL OR isnan(masked) THEN -9999.0::DOUBLE ELSE masked END AS filled,
           CASE WHEN isnan(masked) THEN NULL ELSE masked END AS unfilled FROM {px_raw}""")
def fill_roundtrip(inputs: Inputs) -> DataFrame:
    filled = inputs.px_raw.select("col", "scene_id", to_fill(F.col("masked")).alias("filled"))
    return filled.withColumn("unfilled", from_fill(F.col("filled")))


@query("clip_polygon", f"""WITH {INSIDE_AOI}
    SELECT dataset_id, part, scene_id, ts, p.row, p.col, band_a, band_b, qa
    FROM {{px_obs}} p JOIN inside i ON p.row = i.row AND p.col = i.col""")
def clip_polygon(inputs: Inputs) -> DataFrame:
    return clip.clip(inputs.px_obs, inputs.aoi).drop("lon", "lat")


NATION_SIDES = "n_name IN ('NATION_7', 'NATION_15', 'NATION_20')"


@query("clip_features", f"""
    WITH cells AS (SELECT DISTINCT row, col, lon, lat FROM {{px_obs}}),
        inside AS (SELECT c.row, c.col, e.fid FROM cells c JOIN {{supplier_sides}} e ON {NATION_SIDES}
            AND (e.y1 > c.lat) <> (e.y2 > c.lat) AND c.lon < (e.x2 - e.x1) * (c.lat - e.y1) / (e.y2 - e.y1) + e.x1
            GROUP BY c.row, c.col, e.fid HAVING count(*) % 2 = 1)
    SELECT p.scene_id, p.row, p.col, p.band_b FROM {{px_obs}} p
    JOIN (SELECT DISTINCT row, col FROM inside) i ON p.row = i.row AND p.col = i.col""")
def clip_features(inputs: Inputs) -> DataFrame:
    features = stored_boundary(inputs)
    chosen = [boundary.filter_features(features, "name", f"NATION_{n}") for n in (7, 15, 20)]
    sides = boundary.edges(chosen[0].unionByName(chosen[1]).unionByName(chosen[2]))
    return clip.clip(inputs.px_obs, sides).select("scene_id", "row", "col", "band_b")


@query("cells_in_features", """
    SELECT c.row, c.col, e.fid FROM (SELECT DISTINCT row, col, lon, lat FROM {px_obs}) c JOIN {supplier_sides} e
        ON (e.y1 > c.lat) <> (e.y2 > c.lat) AND c.lon < (e.x2 - e.x1) * (c.lat - e.y1) / (e.y2 - e.y1) + e.x1
    GROUP BY c.row, c.col, e.fid HAVING count(*) % 2 = 1""")
def cells_in_features(inputs: Inputs) -> DataFrame:
    cells = inputs.px_obs.select("row", "col", "lon", "lat").distinct()
    return clip.inside_features(cells, boundary.edges(stored_boundary(inputs))).select("row", "col", "fid")


@query("reclip_composite", f"""WITH {INSIDE_AOI}
    SELECT dataset_id, p.row, p.col, avg(band_b) AS band_b
    FROM {{px_obs}} p JOIN inside i ON p.row = i.row AND p.col = i.col WHERE {IN_PERIOD} GROUP BY ALL""")
def reclip_composite(inputs: Inputs) -> DataFrame:
    mask = clip.build_mask(inputs.aoi)
    keys = ("dataset_id", "row", "col", "lon", "lat")
    clipped = clip.apply_mask(inputs.px_obs, mask)
    means = composites.period_mean(clipped, START, END, ["band_b"], keys)
    return clip.apply_mask(means, mask).drop("lon", "lat")


ALBERS_SQL = """
    k AS (SELECT CAST({a} AS DOUBLE) AS a, CAST({e2} AS DOUBLE) AS e2, CAST({e} AS DOUBLE) AS e, CAST({n} AS DOUBLE) AS n,
        CAST({c} AS DOUBLE) AS c, CAST({r0} AS DOUBLE) AS r0, CAST({lon0} AS DOUBLE) AS lon0, CAST({qp} AS DOUBLE) AS qp)"""
ALBERS_SQL = ALBERS_SQL.format(
    a=EPSG_5070.semi_major, e2=repr(EPSG_5070.ecc2), e=repr(EPSG_5070.ecc), n=repr(EPSG_5070.cone),
    c=repr(EPSG_5070.constant), r0=repr(EPSG_5070.origin_radius), lon0=EPSG_5070.origin_lon, qp=repr(EPSG_5070.polar_q),
)


def _forward_sql(source: str, lon: str, lat: str, keep: str) -> str:
    """Projection of a relation's points as SQL: keeps columns, adds x and y."""
    q = "(1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e))"
    return f"""SELECT {keep}, a * sqrt(c - n * q) / n * sin(n * radians({lon} - lon0)) AS x,
        r0 - a * sqrt(c - n * q) / n * cos(n * radians({lon} - lon0)) AS y
        FROM (SELECT *, {q} AS q FROM (SELECT *, sin(radians({lat})) AS s FROM {source}, k))"""


@query("project_albers", f"""
    WITH {ALBERS_SQL}, cells AS (SELECT DISTINCT row, col, lon, lat FROM {{px_obs}}),
        flat AS ({_forward_sql("cells", "lon", "lat", "row, col")})
    SELECT row, col, round(x, 3) AS x, round(y, 3) AS y FROM flat""")
def project_albers(inputs: Inputs) -> DataFrame:
    x, y = project(F.col("lon"), F.col("lat"))
    cells = inputs.px_obs.select("row", "col", "lon", "lat").distinct()
    return cells.select("row", "col", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("unproject_albers", "SELECT DISTINCT row, col, round(lon, 7) AS lon, round(lat, 7) AS lat FROM {px_obs}")
def unproject_albers(inputs: Inputs) -> DataFrame:
    x, y = project(F.col("lon"), F.col("lat"))
    cells = inputs.px_obs.select("row", "col", "lon", "lat").distinct().select("row", "col", x.alias("x"), y.alias("y"))
    lon, lat = unproject(F.col("x"), F.col("y"))
    return cells.select("row", "col", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("grid_snap", f"""
    WITH {ALBERS_SQL}, cells AS (SELECT DISTINCT row, col, lon, lat FROM {{px_obs}}),
        flat AS ({_forward_sql("cells", "lon", "lat", "row, col")})
    SELECT row, col, CAST(floor(x / 1000) AS BIGINT) AS km_col, CAST(floor(y / 1000) AS BIGINT) AS km_row,
           CAST(floor(x / 30) AS BIGINT) AS fine_col, CAST(floor(y / 30) AS BIGINT) AS fine_row FROM flat""")
def grid_snap(inputs: Inputs) -> DataFrame:
    x, y = project(F.col("lon"), F.col("lat"))
    cells = inputs.px_obs.select("row", "col", "lon", "lat").distinct().withColumns({"x": x, "y": y})
    named = {"km_col": ("x", 1000), "km_row": ("y", 1000), "fine_col": ("x", 30), "fine_row": ("y", 30)}
    return cells.select("row", "col", *[snap(F.col(axis), scale).alias(name) for name, (axis, scale) in named.items()])


@query("clip_buffer", f"""
    WITH {ALBERS_SQL}, {INSIDE_AOI}, cells AS (SELECT DISTINCT row, col, lon, lat FROM {{px_obs}}),
        flat AS ({_forward_sql("cells", "lon", "lat", "row, col")}),
        starts AS ({_forward_sql("(SELECT *, row_number() OVER () AS i FROM {aoi})", "x1", "y1", "i")}),
        ends AS ({_forward_sql("(SELECT *, row_number() OVER () AS i FROM {aoi})", "x2", "y2", "i")}),
        sides AS (SELECT s.x AS x1, s.y AS y1, t.x - s.x AS dx, t.y - s.y AS dy FROM starts s JOIN ends t ON s.i = t.i),
        placed AS (SELECT row, col, x, y, x1, y1, dx, dy,
            greatest(0, least(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) AS t FROM flat, sides),
        near AS (SELECT DISTINCT row, col FROM placed
                 WHERE (x - x1 - t * dx) * (x - x1 - t * dx) + (y - y1 - t * dy) * (y - y1 - t * dy) <= 15000.0 * 15000.0)
    SELECT p.scene_id, p.row, p.col, p.band_b FROM {{px_obs}} p
    JOIN (SELECT row, col FROM near UNION SELECT row, col FROM inside) m ON p.row = m.row AND p.col = m.col""")
def clip_buffer(inputs: Inputs) -> DataFrame:
    return clip.clip_buffer(inputs.px_obs, inputs.aoi, 15_000.0).select("scene_id", "row", "col", "band_b")


TARGET = regrid.MasterGrid(x0=-870_137.0, y0=1_071_261.0, scale=20_000.0, n_cols=42, n_rows=60)
SOURCE = regrid.SourceGrid(lon0=-106.0, lat0=31.68, d_lon=0.2, d_lat=0.24)


@query("regrid_nearest", f"""
    WITH {ALBERS_SQL},
        target AS (SELECT i // {TARGET.n_cols} AS grid_row, i % {TARGET.n_cols} AS grid_col,
            {TARGET.x0}::DOUBLE + (i % {TARGET.n_cols} + 0.5::DOUBLE) * {TARGET.scale}::DOUBLE AS x,
            {TARGET.y0}::DOUBLE + (i // {TARGET.n_cols} + 0.5::DOUBLE) * {TARGET.scale}::DOUBLE AS y
            FROM range({TARGET.n_cols * TARGET.n_rows}) AS r(i)),
        polar AS (SELECT *, asin((c - rho * rho * n * n / (a * a)) / n / qp) AS b
            FROM (SELECT *, sqrt(x * x + (r0 - y) * (r0 - y)) AS rho FROM target, k)),
        placed AS (SELECT grid_row, grid_col, lon0 + degrees(atan2(x, r0 - y)) / n AS lon,
            degrees(b + (e2 / 3 + 31 * e2 * e2 / 180 + 517 * e2 * e2 * e2 / 5040) * sin(2 * b)
                + (23 * e2 * e2 / 360 + 251 * e2 * e2 * e2 / 3780) * sin(4 * b)
                + 761 * e2 * e2 * e2 / 45360 * sin(6 * b)) AS lat FROM polar),
        composite AS (SELECT dataset_id, row, col, avg(band_b) AS band_b FROM {{px_obs}} WHERE {IN_PERIOD} GROUP BY ALL)
    SELECT t.grid_row, t.grid_col, s.dataset_id, s.band_b FROM placed t JOIN composite s
        ON s.col = CAST(floor((t.lon + 106.0) / 0.2) AS BIGINT) AND s.row = CAST(floor((t.lat - 31.68) / 0.24) AS BIGINT)""")
def regrid_nearest(inputs: Inputs) -> DataFrame:
    means = composites.period_mean(inputs.px_obs, START, END, ["band_b"])
    merged = composite.regridded(means, SOURCE, TARGET)
    return merged.select("grid_row", "grid_col", "dataset_id", "band_b")


@query("period_mean", f"""
    SELECT dataset_id, row, col, avg(band_a) AS band_a, avg(band_b) AS band_b
    FROM {{px_obs}} WHERE {IN_PERIOD} GROUP BY ALL""")
def period_mean(inputs: Inputs) -> DataFrame:
    return composites.period_mean(inputs.px_obs, START, END, ["band_a", "band_b"])


@query("time_mean_grid", f"WITH {GRID_SQL} SELECT dataset_id, part, var, y, x, avg(value) AS value FROM grid GROUP BY ALL")
def time_mean_grid(inputs: Inputs) -> DataFrame:
    return composites.time_mean_wide(inputs.px_obs, BANDS)


@query("quicklook", f"""WITH {GRID_SQL},
    image AS (SELECT dataset_id, part, var, y, x, avg(value) AS value FROM grid GROUP BY ALL),
    extremes AS (SELECT dataset_id, part, var, min(value) AS low, max(value) AS high FROM image GROUP BY ALL)
    SELECT dataset_id, part, var, y, x, CAST(CASE WHEN value IS NOT NULL
        THEN floor(greatest(0, least(1, (value - low) / (high - low))) * 255) END AS INT) AS grey
    FROM image JOIN extremes USING (dataset_id, part, var)""")
def quicklook(inputs: Inputs) -> DataFrame:
    return quality.quicklook(composites.time_mean_wide(inputs.px_obs, BANDS))


PX_PLAN_SQL = """
    years AS (SELECT dataset_id, CAST(part AS BIGINT) AS part, CAST(unnest(generate_series(y0 - 1, y1 + 1)) AS INT) AS year
        FROM (SELECT dataset_id, max(part) AS last_part, min(year(ts)) AS y0, max(year(ts)) AS y1 FROM {px_obs} GROUP BY 1) d,
             (VALUES (0), (1)) AS parts(part) WHERE parts.part <= d.last_part)"""


def px_catalog(px: DataFrame, wider: int, scale: int = 1000) -> DataFrame:
    """Catalog of the datasets of some pixels; ``wider`` years before the first and after the last."""
    spans = px.groupBy("dataset_id").agg(
        F.max("part").alias("last"), F.min(F.year("ts")).alias("y0"), F.max(F.year("ts")).alias("y1")
    )
    assets = F.transform(F.sequence(F.lit(0).cast("bigint"), "last"), lambda i: F.concat(F.lit("asset/"), i.cast("string")))
    kind = F.when(F.col("last") > 0, "collection_group").otherwise("collection")
    return spans.select(
        "dataset_id", F.lit("MULTI").alias("vars"), assets.alias("assets"), F.lit(scale).alias("scale"), kind.alias("kind"),
        F.concat((F.col("y0") - wider).cast("string"), F.lit("-06-01")).alias("start"),
        F.concat((F.col("y1") + wider).cast("string"), F.lit("-06-30")).alias("end"),
    )


def px_plan(inputs: Inputs) -> DataFrame:
    plan = chunks.named_chunks(chunks.year_chunks(px_catalog(inputs.px_obs, wider=1)))
    return plan.withColumn("part", F.col("part").cast("bigint"))


@query("plan_chunk_join", f"""WITH {PX_PLAN_SQL}
    SELECT y.dataset_id, y.part, y.year, count(DISTINCT scene_id) AS n_img, count(scene_id) AS n_px
    FROM years y LEFT JOIN {{px_obs}} p ON p.dataset_id = y.dataset_id AND p.part = y.part
        AND p.ts >= make_date(y.year, 1, 1) AND p.ts < make_date(y.year + 1, 1, 1) GROUP BY ALL""")
def plan_chunk_join(inputs: Inputs) -> DataFrame:
    plan = px_plan(inputs).select("dataset_id", "part", "year")
    return chunks.chunk_sizes(inputs.px_obs, plan)


PLANNED_SQL = f"""WITH {INSIDE_AOI},
    periods AS (SELECT dataset_id, max(part) + 1 AS n_parts,
        CAST(CAST(min(year(ts)) AS VARCHAR) || '-06-01' AS TIMESTAMP) AS t0,
        CAST(CAST(max(year(ts)) AS VARCHAR) || '-06-30' AS TIMESTAMP) AS t1 FROM {{px_obs}} GROUP BY dataset_id)
    SELECT p.dataset_id, p.part, CAST(year(ts) AS INT) AS year, p.row, p.col,
           'OG_' || p.dataset_id || '_MULTI' || CASE WHEN n_parts > 1 THEN '_part' || CAST(p.part + 1 AS VARCHAR) ELSE '' END
           || '_' || CAST(year(ts) AS VARCHAR) || '-01-01_' || CAST(year(ts) AS VARCHAR) || '-12-31_1000m' AS out_name,
           {MEDIANS}
    FROM {{px_obs}} p JOIN inside i ON p.row = i.row AND p.col = i.col
        JOIN periods d ON p.dataset_id = d.dataset_id AND ts >= t0 AND ts < t1 GROUP BY ALL"""


@query("planned_composite", PLANNED_SQL)
def planned_composite(inputs: Inputs) -> DataFrame:
    return composite.named_composite(inputs.px_obs, px_catalog(inputs.px_obs, wider=0), inputs.aoi)


@query("clustered_composite", PLANNED_SQL)
def clustered_composite(inputs: Inputs) -> DataFrame:
    path = fresh_path(inputs.spark, "clustered")
    clustered.write_clustered(inputs.px_obs, path)
    px = clustered.clustered(inputs.spark, path)
    return composite.named_composite(px, px_catalog(px, wider=0), inputs.aoi, keep=False)


@query("days_since_epoch", """
    SELECT scene_id, row, col, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS days FROM {px_obs}""")
def days_since_epoch_query(inputs: Inputs) -> DataFrame:
    return inputs.px_obs.select("scene_id", "row", "col", days_since_epoch(F.col("ts")).alias("days"))


@query("axis_normalise", "SELECT band_b, lat AS y, lon AS x, lat, lon FROM {px_obs}")
def axis_normalise(inputs: Inputs) -> DataFrame:
    return axes.normalise_axes(inputs.px_obs.select("band_b", "lat", "lon")).select("band_b", "y", "x", "lat", "lon")


@query("index_axis", """
    SELECT lon, x_index, count(*) AS n FROM (SELECT lon, dense_rank() OVER (ORDER BY lon) - 1 AS x_index FROM {px_obs})
    GROUP BY ALL""")
def index_axis(inputs: Inputs) -> DataFrame:
    indexed = axes.index_axis(inputs.px_obs.select("lon"), "lon", "x_index")
    return indexed.groupBy("lon", "x_index").agg(F.count("*").alias("n"))


@query("chunk_shape", f"""WITH {GRID_SQL},
    sizes AS (SELECT dataset_id, part, 'time' AS axis, count(DISTINCT time) AS dim FROM grid GROUP BY ALL
        UNION ALL SELECT dataset_id, part, 'y', count(DISTINCT y) FROM grid GROUP BY ALL
        UNION ALL SELECT dataset_id, part, 'x', count(DISTINCT x) FROM grid GROUP BY ALL)
    SELECT dataset_id, part, axis, dim, CAST(least(24, dim) AS BIGINT) AS chunk FROM sizes""")
def chunk_shape(inputs: Inputs) -> DataFrame:
    return axes.chunk_shape(composites.to_grid(inputs.px_obs, BANDS))


@query("palette_classes", """
    WITH scaled AS (SELECT scene_id, row, col, band_a, greatest(0, least(1, ((band_a - 25) + 25) / 50)) AS t,
            (band_a - 1) / 49 AS g FROM {px_obs})
    SELECT scene_id, row, col, CAST(CASE WHEN band_a IS NOT NULL THEN floor(t * 3 + 0.5) END AS INT) AS class,
           CASE WHEN band_a IS NOT NULL
                THEN list_extract(['001137', '01abab', 'e7eb05', '620500'], CAST(floor(t * 3 + 0.5) AS INT) + 1) END AS colour,
           CAST(CASE WHEN band_a IS NOT NULL THEN floor(greatest(0, least(1, g)) * 255) END AS INT) AS grey FROM scaled""")
def palette_classes(inputs: Inputs) -> DataFrame:
    value = F.col("band_a") - 25
    return inputs.px_obs.select(
        "scene_id", "row", "col", palette_class(value).alias("class"), palette_colour(value).alias("colour"),
        quicklook_byte(F.col("band_a"), F.lit(1.0), F.lit(50.0)).alias("grey"),
    )


def _scale_bands(px: DataFrame, factor: float) -> DataFrame:
    return px.withColumns({"band_a": F.col("band_a") * factor, "band_b": F.col("band_b") * factor})


@query("map_scenes", f"""WITH {INSIDE_AOI},
    image AS (SELECT dataset_id, part, scene_id, p.row, p.col, avg(band_a * 0.5::DOUBLE) AS band_a, avg(band_b * 0.5::DOUBLE) AS band_b
        FROM {{px_obs}} p JOIN inside i ON p.row = i.row AND p.col = i.col GROUP BY ALL),
    focal AS (SELECT a.dataset_id, a.part, a.scene_id, a.row, a.col, avg(b.band_b) AS smooth, count(*) AS around
        FROM image a JOIN image b ON a.dataset_id = b.dataset_id AND a.part = b.part AND a.scene_id = b.scene_id
            AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL)
    SELECT dataset_id, part, scene_id, row, col, round(image.band_a, 6) AS band_a, round(image.band_b, 6) AS band_b,
        round(smooth, 6) AS smooth, around::DOUBLE AS around
    FROM image JOIN focal USING (dataset_id, part, scene_id, row, col)""")
def map_scenes(inputs: Inputs) -> DataFrame:
    scaled = composites.map_scenes(inputs.px_obs, _scale_bands, 0.5)
    clipped = composites.map_scenes(scaled, clip.clip, inputs.aoi)
    smooth = scenes.map_arrays(clipped, ["band_a", "band_b"], _focal_mean, ["band_a", "band_b", "smooth", "around"], halo=1, block=8)
    return smooth.select(
        *scenes.SCENE, "row", "col", *[F.round(name, 6).alias(name) for name in ("band_a", "band_b", "smooth")], "around"
    )


def _focal_mean(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Mean and number of the pixels in the 3 x 3 window around each one."""
    there = ~np.isnan(arrays["band_b"])
    total, count = np.zeros(there.shape), np.zeros(there.shape)
    wide = [(0, 0), (1, 1), (1, 1)]
    values, held = np.pad(np.where(there, arrays["band_b"], 0.0), wide), np.pad(there, wide)
    rows, cols = there.shape[1:]
    for down in range(3):
        for right in range(3):
            total += values[:, down : down + rows, right : right + cols]
            count += held[:, down : down + rows, right : right + cols]
    with np.errstate(invalid="ignore", divide="ignore"):
        return {**arrays, "smooth": total / count, "around": count}
