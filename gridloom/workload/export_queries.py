"""Queries over composites of datasets with grids of their own, brought to master grids and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import composites
from gridloom.plans import chunks, composite
from gridloom.shared import fresh_path
from gridloom.workload.raster_queries import ALBERS_SQL, END, IN_PERIOD, START, _forward_sql, px_catalog
from gridloom.workload.registered import Inputs, query

#: Scale of datasets that have none configured.
SCALE = 50_000

INDEX_SQL = f"""{ALBERS_SQL},
    scaled AS (SELECT g.*, CAST(coalesce(s.scale, {SCALE}) AS DOUBLE) AS scale
        FROM {{grids}} g LEFT JOIN {{grid_scales}} s ON g.dataset_id = s.dataset_id),
    outline AS ({_forward_sql("{aoi}", "x1", "y1", "fid")}),
    master AS (SELECT s.*, floor(w / scale) * scale AS l, floor(b / scale) * scale AS u, e, t
        FROM scaled s, (SELECT min(x) AS w, min(y) AS b, max(x) AS e, max(y) AS t FROM outline)),
    sized AS (SELECT *, CAST(ceil((e - l) / scale) AS BIGINT) AS n_cols, CAST(ceil((t - u) / scale) AS BIGINT) AS n_rows FROM master),
    target AS (SELECT *, l + (grid_col + 0.5::DOUBLE) * scale AS x, u + (grid_row + 0.5::DOUBLE) * scale AS y
        FROM (SELECT *, unnest(range(n_cols)) AS grid_col FROM (SELECT *, unnest(range(n_rows)) AS grid_row FROM sized))),
    polar AS (SELECT *, asin((c - rho * rho * n * n / (a * a)) / n / qp) AS beta
        FROM (SELECT *, sqrt(x * x + (r0 - y) * (r0 - y)) AS rho FROM target, k)),
    placed AS (SELECT dataset_id, grid_row, grid_col, x0, y0, dx, dy, lon0 + degrees(atan2(x, r0 - y)) / n AS lon,
        degrees(beta + (e2 / 3 + 31 * e2 * e2 / 180 + 517 * e2 * e2 * e2 / 5040) * sin(2 * beta)
            + (23 * e2 * e2 / 360 + 251 * e2 * e2 * e2 / 3780) * sin(4 * beta)
            + 761 * e2 * e2 * e2 / 45360 * sin(6 * beta)) AS lat FROM polar),
    held AS (SELECT dataset_id, grid_row, grid_col FROM placed p JOIN {{aoi}} s
        ON (s.y1 > p.lat) <> (s.y2 > p.lat) AND p.lon < (s.x2 - s.x1) * (p.lat - s.y1) / (s.y2 - s.y1) + s.x1
        GROUP BY ALL HAVING count(*) % 2 = 1),
    source AS (SELECT dataset_id, grid_row, grid_col, CAST(floor((lat - y0) / dy) AS BIGINT) AS row,
        CAST(floor((lon - x0) / dx) AS BIGINT) AS col FROM placed JOIN held USING (dataset_id, grid_row, grid_col))"""

NATIVE_SQL = """
    native AS (SELECT DISTINCT dataset_id, row, col, lon, lat FROM {px_two}),
    native_inside AS (SELECT dataset_id, row, col FROM native p JOIN {aoi} s
        ON (s.y1 > p.lat) <> (s.y2 > p.lat) AND p.lon < (s.x2 - s.x1) * (p.lat - s.y1) / (s.y2 - s.y1) + s.x1
        GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _grids(inputs: Inputs) -> DataFrame:
    bare = inputs.grids.withColumn("scale", F.lit(None).cast("int"))
    return chunks.with_scale(bare, inputs.grid_scales, SCALE)


@query("regrid_datasets", f"""WITH {INDEX_SQL},
    composite AS (SELECT dataset_id, part, row, col, avg(band_b) AS band_b FROM {{px_two}} WHERE {IN_PERIOD} GROUP BY ALL)
    SELECT t.dataset_id, s.part, t.grid_row, t.grid_col, s.band_b FROM source t JOIN composite s USING (dataset_id, row, col)""")
def regrid_datasets(inputs: Inputs) -> DataFrame:
    keys = ("dataset_id", "part", "row", "col")
    means = composites.period_mean(inputs.px_two, START, END, ["band_b"], keys)
    merged = composite.on_master_grids(means, _grids(inputs), inputs.aoi)
    return merged.select("dataset_id", "part", "grid_row", "grid_col", "band_b")


@query("export_listing", f"""WITH {INDEX_SQL}, {NATIVE_SQL},
    spans AS (SELECT dataset_id, max(part) + 1 AS n_parts, min(year(ts)) AS y0, max(year(ts)) AS y1 FROM {{px_two}} GROUP BY 1),
    plan AS (SELECT dataset_id, n_parts, CAST(part AS BIGINT) AS part, CAST(unnest(generate_series(y0 - 1, y1 + 1)) AS INT) AS year
        FROM (SELECT *, unnest(range(n_parts)) AS part FROM spans)),
    medians AS (SELECT dataset_id, part, CAST(year(ts) AS INT) AS year, row, col, median(band_b) AS band_b
        FROM {{px_two}} JOIN native_inside USING (dataset_id, row, col) GROUP BY ALL),
    cells AS (SELECT m.dataset_id, part, year, count(*) AS n_px, sum(band_b) AS total
        FROM medians m JOIN source USING (dataset_id, row, col) GROUP BY ALL)
    SELECT p.dataset_id, p.part, p.year, coalesce(n_px, 0) AS n_px, total,
           'OG_' || p.dataset_id || '_MULTI' || CASE WHEN n_parts > 1 THEN '_part' || CAST(p.part + 1 AS VARCHAR) ELSE '' END
           || '_' || CAST(p.year AS VARCHAR) || '-01-01_' || CAST(p.year AS VARCHAR) || '-12-31_'
           || CAST(CAST(s.scale AS BIGINT) AS VARCHAR) || 'm' AS out_name
    FROM plan p JOIN scaled s USING (dataset_id) LEFT JOIN cells c USING (dataset_id, part, year)""")
def export_listing(inputs: Inputs) -> DataFrame:
    px = inputs.px_two
    records = chunks.with_scale(px_catalog(px, wider=1, scale=SCALE), inputs.grid_scales)
    path = fresh_path(inputs.spark, "export")
    composite.export(px, records, inputs.grids, inputs.aoi, path)
    cells, listed = composite.read_export(inputs.spark, path)
    totals = cells.groupBy("dataset_id", "part", "year").agg(F.sum("band_b").alias("total"))
    return listed.join(totals, ["dataset_id", "part", "year"], "left").select(
        "dataset_id", "part", "year", "n_px", "total", "out_name"
    )
