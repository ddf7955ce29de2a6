"""Queries for sources and sinks: each writes a view to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.attrs import coordinate_attrs, global_attrs
from gridloom.functions.paths import url_path
from gridloom.functions.status import format_iso, parse_iso
from gridloom.operators.clip import clip
from gridloom.operators.composites import to_grid
from gridloom.operators.quality import qc_stats, qc_stats_wide
from gridloom.shared import fresh_path
from gridloom.sources import boundary, catalog, chunks, payloads, pixels, registry, sinks
from gridloom.workload.registered import Inputs, query
from gridloom.workload.views import RINGS


def catalog_records(inputs: Inputs) -> DataFrame:
    """The catalog view with lists for assets and bands."""
    listed = F.filter(F.array("asset_1", "asset_2"), lambda asset: asset.isNotNull())
    bands = F.transform(F.sequence(F.lit(1), "n_bands"), lambda i: F.concat(F.lit("b"), i.cast("string")))
    return inputs.catalog.select(
        "dataset_id", "family", "name", listed.alias("assets"), "vars", bands.alias("bands"), "scale", "kind",
        F.col("start_day").alias("start"), F.col("end_day").alias("end"), "folder", "endpoint",
    )


def naive(column: Column | str) -> Column:
    """Instant as the wall-clock time of the session."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")


@query(
    "catalog_scan",
    """
    SELECT dataset_id, family, name, CAST((asset_1 IS NOT NULL)::INT + (asset_2 IS NOT NULL)::INT AS INT) AS n_assets,
           asset_1 AS first_asset, coalesce(asset_2, asset_1) AS last_asset, vars, n_bands,
           'b' || CAST(n_bands AS VARCHAR) AS last_band, scale, kind, start_day, end_day, endpoint
    FROM {catalog}""",
)
def catalog_scan(inputs: Inputs) -> DataFrame:
    records = catalog_records(inputs)
    common = [name for name in records.columns if name != "assets"]
    several = F.to_json(F.struct(*common, F.col("assets").alias("asset_id")))
    single = F.to_json(F.struct(*common, F.element_at("assets", 1).alias("asset_id")))
    none = F.to_json(F.struct(*common))
    n = F.size("assets")
    path = fresh_path(inputs.spark, "catalog")
    records.select(F.when(n > 1, several).when(n == 1, single).otherwise(none).alias("value")).write.text(path)
    return catalog.catalog(inputs.spark, path, layout="records").select(
        "dataset_id", "family", "name", F.size("assets").alias("n_assets"),
        F.try_element_at("assets", F.lit(1)).alias("first_asset"), F.try_element_at("assets", F.lit(-1)).alias("last_asset"),
        "vars", F.size("bands").alias("n_bands"), F.element_at("bands", -1).alias("last_band"), "scale", "kind",
        F.col("start").alias("start_day"), F.col("end").alias("end_day"), "endpoint",
    )


@query("asset_parts", """
    SELECT dataset_id, CAST(0 AS INT) AS part, asset_1 AS asset_id FROM {catalog} WHERE asset_1 IS NOT NULL
    UNION ALL SELECT dataset_id, CAST(1 AS INT), asset_2 FROM {catalog} WHERE asset_2 IS NOT NULL""")
def asset_parts(inputs: Inputs) -> DataFrame:
    return catalog.asset_parts(catalog_records(inputs))


@query("collection_scan", """
    SELECT row, col, scene_id, ts, part, band_a, band_b, qa, CAST(year(ts) AS INT) AS year FROM {px_obs}
    WHERE dataset_id = '01b'""")
def collection_scan(inputs: Inputs) -> DataFrame:
    path = fresh_path(inputs.spark, "collection")
    pixels.write_px_obs(inputs.px_obs, path)
    return pixels.px_obs(inputs.spark, path, "01b").select(
        "row", "col", "scene_id", "ts", "part", "band_a", "band_b", "qa", "year"
    )


INSIDE_AOI = """
    inside AS (SELECT c.row, c.col FROM (SELECT DISTINCT row, col, lon, lat FROM {px_obs}) c JOIN {aoi} e
        ON (e.y1 > c.lat) <> (e.y2 > c.lat) AND c.lon < (e.x2 - e.x1) * (c.lat - e.y1) / (e.y2 - e.y1) + e.x1
        GROUP BY c.row, c.col HAVING count(*) % 2 = 1)"""


@query("static_image", f"""WITH {INSIDE_AOI}
    SELECT dataset_id, p.row, p.col, max(band_b) AS band_b
    FROM {{px_obs}} p JOIN inside i ON p.row = i.row AND p.col = i.col WHERE dataset_id = '01a' GROUP BY ALL""")
def static_image(inputs: Inputs) -> DataFrame:
    path = fresh_path(inputs.spark, "images")
    # One image per dataset: a row per pixel, no time.
    images = inputs.px_obs.groupBy("dataset_id", "row", "col", "lon", "lat").agg(F.max("band_b").alias("band_b"))
    pixels.write_px_obs(images, path)
    image = pixels.static_image(inputs.spark, path, "01a")
    return clip(image, inputs.aoi).select("dataset_id", "row", "col", "band_b")


@query("collection_group", """
    SELECT row, col, scene_id, band_a, band_b, CAST(NULL AS INT) AS qa, CAST(0 AS BIGINT) AS part, '_part1' AS part_tag
    FROM {px_obs} WHERE part = 0
    UNION ALL SELECT row, col, scene_id, NULL, band_b, qa, 1, '_part2' FROM {px_obs} WHERE part = 1""")
def collection_group(inputs: Inputs) -> DataFrame:
    px = inputs.px_obs
    first = px.where("part = 0").select("row", "col", "scene_id", "band_a", "band_b")
    second = px.where("part = 1").select("row", "col", "scene_id", "band_b", "qa")
    return pixels.collection_group([first, second])


def supplier_features(inputs: Inputs) -> DataFrame:
    """Polygons around the suppliers' centres, every third with a hole, as GeoJSON-shaped columns."""

    def ring(corners: tuple[tuple[float, float], ...]) -> Column:
        return F.array(*[F.array(F.col("cx") + dx, F.col("cy") + dy) for dx, dy in corners])

    outer, hole = (ring(corners) for corners in RINGS)
    coordinates = F.when(F.col("has_hole"), F.array(outer, hole)).otherwise(F.array(outer))
    return inputs.centres.select(
        F.col("s_suppkey").alias("id"),
        F.struct(F.col("n_name").alias("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )


def stored_boundary(inputs: Inputs) -> DataFrame:
    """Supplier polygons after a round trip through line-delimited GeoJSON."""
    path = fresh_path(inputs.spark, "boundary")
    features = supplier_features(inputs).withColumn("type", F.lit("Feature"))
    features.select(F.to_json(F.struct(*features.columns)).alias("value")).write.text(path)
    return boundary.boundary(inputs.spark, path, layout="lines")


@query("aoi_edges", "SELECT fid, ring, x1, y1, x2, y2 FROM {supplier_sides}")
def aoi_edges(inputs: Inputs) -> DataFrame:
    return boundary.edges(stored_boundary(inputs))


@query("feature_attr_filter", """
    SELECT s_suppkey AS fid, n_name AS name, CASE WHEN has_hole THEN 2 ELSE 1 END AS n_rings
    FROM {centres} WHERE n_name = 'NATION_7'""")
def feature_attr_filter(inputs: Inputs) -> DataFrame:
    kept = boundary.filter_features(stored_boundary(inputs), "name", "NATION_7")
    return kept.select("fid", F.col("properties")["name"].alias("name"), F.size("rings").alias("n_rings"))


@query("total_bounds", """
    SELECT min(least(x1, x2)) AS west, min(least(y1, y2)) AS south, max(greatest(x1, x2)) AS east,
           max(greatest(y1, y2)) AS north FROM {supplier_sides}""")
def total_bounds(inputs: Inputs) -> DataFrame:
    return boundary.total_bounds(boundary.edges(stored_boundary(inputs)))


REGISTRY_SQL = """
    SELECT "timestamp", notebook_id, dataset, task_id_or_file, pathway, status, start_time, end_time, n_bytes,
           error_message, retries FROM {registry_rows}"""


@query("registry_scan", REGISTRY_SQL)
def registry_scan(inputs: Inputs) -> DataFrame:
    path = fresh_path(inputs.spark, "registry")
    registry.append_event(inputs.registry_rows, path)
    back = registry.registry(inputs.spark, path)
    return back.withColumns({name: naive(name) for name in ("timestamp", "start_time", "end_time")})


@query("registry_append", """
    SELECT notebook_id, task_id_or_file, pathway, status, start_time, n_bytes, error_message, retries,
           TRUE AS has_timestamp FROM {registry_rows}
    UNION ALL SELECT notebook_id, task_id_or_file, 'xee', status, NULL, NULL, NULL, NULL, TRUE FROM {registry_rows}""")
def registry_append(inputs: Inputs) -> DataFrame:
    path = fresh_path(inputs.spark, "registry")
    rows = inputs.registry_rows
    registry.append_event(rows.drop("timestamp"), path)
    sparse = rows.select("notebook_id", "task_id_or_file", "status")
    registry.append_event(sparse.withColumn("pathway", F.lit("xee")), path)
    return registry.registry(inputs.spark, path).select(
        "notebook_id", "task_id_or_file", "pathway", "status", naive("start_time").alias("start_time"), "n_bytes",
        "error_message", "retries", F.col("timestamp").isNotNull().alias("has_timestamp"),
    )


@query("iso_timestamps", """
    SELECT event_id, strftime(timestamp_, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso, timestamp_ AS parsed FROM {task_events}""")
def iso_timestamps(inputs: Inputs) -> DataFrame:


    iso = format_iso(F.col("timestamp_").cast("timestamp"))
    texts = inputs.task_events.select("event_id", iso.alias("iso"))
    return texts.withColumn("parsed", naive(parse_iso(F.col("iso"))))


@query("payload_dispatch", r"""
    WITH paths AS (SELECT page_id, url, strlen(html) AS length,
            regexp_replace(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^[^?#]*'),
                           ';[^/]*$', '') AS path FROM {pages}),
        found AS (SELECT *, regexp_extract(regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$'),
                           '^\.*[^.].*(\.[^.]+)$', 1) AS s FROM paths)
    SELECT page_id, path, length, CASE WHEN s = '' THEN '.bin' ELSE lower(s) END AS suffix,
           CASE WHEN lower(s) IN ('.tif', '.tiff') THEN 'raster' WHEN lower(s) IN ('.nc', '.nc4', '.netcdf') THEN 'gridded'
                ELSE 'other' END AS payload_class FROM found""")
def payload_dispatch(inputs: Inputs) -> DataFrame:
    length = F.octet_length("html").cast("bigint")
    return payloads.dispatch(inputs.pages.select("page_id", url_path(F.col("url")).alias("path"), length.alias("length")))


@query("payload_grid", """
    SELECT page_id, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS x, CAST(strlen(html) AS FLOAT) AS value FROM {pages}""")
def payload_grid(inputs: Inputs) -> DataFrame:
    return payloads.payload_grid(inputs.pages.select("page_id", F.octet_length("html").alias("length")))


GRID_SQL = """
    grid AS (SELECT dataset_id, part, 'band_a' AS var, CAST(ts AS DATE) AS time, lat AS y, lon AS x, band_a AS value FROM {px_obs}
        UNION ALL SELECT dataset_id, part, 'band_b', CAST(ts AS DATE), lat, lon, band_b FROM {px_obs}
        UNION ALL SELECT dataset_id, part, 'qa', CAST(ts AS DATE), lat, lon, CAST(qa AS DOUBLE) FROM {px_obs})"""
BANDS = ["band_a", "band_b", "qa"]


@query("grid_sink", f"""WITH {GRID_SQL}
    SELECT dataset_id, part, var, CAST(time AS VARCHAR) AS time, y, x, value, 'm' AS units, 'CF-1.8' AS conventions FROM grid""")
def grid_sink(inputs: Inputs) -> DataFrame:
    grid = to_grid(inputs.px_obs, BANDS)
    datasets = inputs.px_obs.select("dataset_id").distinct()
    given = F.create_map(F.lit("title"), F.col("dataset_id"))
    attrs = datasets.select("dataset_id", global_attrs(given, F.lit("2024-01-01T00:00:00+00:00")).alias("attrs"))
    path = fresh_path(inputs.spark, "grid")
    sinks.write_grid(grid, attrs, coordinate_attrs(datasets), path)
    stored = sinks.read_grid(inputs.spark, path)
    units = stored["var_attrs"].where("var = 'y'").agg(F.max(F.col("attrs")["units"])).scalar()
    convention = stored["attrs"].agg(F.min(F.col("attrs")["Conventions"])).scalar()
    return stored["grid"].withColumns(
        {"time": F.col("time").cast("string"), "units": units, "conventions": convention}
    )


@query("grid_window", f"""WITH {GRID_SQL}
    SELECT dataset_id, part, var, CAST(time AS VARCHAR) AS time, y, x, value FROM grid
    WHERE y BETWEEN 32.01 AND 36.01 AND x BETWEEN -101.01 AND -99.01 AND time BETWEEN DATE '1995-02-03' AND DATE '1996-06-30'""")
def grid_window(inputs: Inputs) -> DataFrame:
    path = fresh_path(inputs.spark, "grid")
    chunks.write_chunks(to_grid(inputs.px_obs, BANDS), path)
    days = tuple(F.lit(day).cast("date") for day in ("1995-02-03", "1996-06-30"))
    cells = chunks.read_chunks(inputs.spark, path, y=(32.01, 36.01), x=(-101.01, -99.01), time=days)
    return cells.withColumn("time", F.col("time").cast("string"))


@query("file_inventory", """
    SELECT 'external' AS family, 'pages' AS folder, TRUE AS has_bytes
    FROM (SELECT count(*) AS n FROM {pages}) WHERE n > 0
    UNION ALL SELECT DISTINCT 'raster', 'dataset_id=' || dataset_id || '/year=' || CAST(year(ts) AS VARCHAR), TRUE
    FROM {px_obs}""")
def file_inventory(inputs: Inputs) -> DataFrame:
    rasters, others = fresh_path(inputs.spark, "rasters"), fresh_path(inputs.spark, "others")
    pixels.write_px_obs(inputs.px_obs, rasters)
    inputs.pages.write.parquet(f"{others}/pages")
    files = payloads.file_inventory(inputs.spark, {"raster": rasters, "external": others})
    folder = F.regexp_extract("path", r"/(?:rasters|others)-[0-9a-f]+/(.*)/[^/]*$", 1)
    return files.groupBy("family", folder.alias("folder")).agg((F.sum("length") > 0).alias("has_bytes"))


@query("manifest_rollup", """
    SELECT f.notebook_id, f.status, f.file, s.size_bytes, 'CF-1.8' AS cf_version, f.dataset
    FROM {notebook_files} f JOIN {stored_files} s ON f.file = s.file""")
def manifest_rollup(inputs: Inputs) -> DataFrame:
    lines = sinks.manifest(inputs.notebook_files, inputs.stored_files)
    path = fresh_path(inputs.spark, "manifest")
    sinks.write_manifest(lines, path)
    return inputs.spark.read.schema(lines.schema).json(path).select(*lines.columns)


def rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({name: F.round(name, 4) for name in ("mean", "std")})


QC_SQL = """
    SELECT dataset_id, part, var, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean,
           round(stddev_pop(value), 4) AS std, count(value) AS n_valid FROM grid GROUP BY dataset_id, part, var"""


@query("qc_sink", f"WITH {GRID_SQL} {QC_SQL}")
def qc_sink(inputs: Inputs) -> DataFrame:
    stats = qc_stats(to_grid(inputs.px_obs, BANDS))
    path = fresh_path(inputs.spark, "qc")
    sinks.write_qc(stats, path)
    return rounded(inputs.spark.read.schema(stats.schema).json(path))


@query("qc_stats", f"WITH {GRID_SQL} {QC_SQL}")
def qc_stats_query(inputs: Inputs) -> DataFrame:
    return rounded(qc_stats_wide(inputs.px_obs, BANDS))


@query("index_lines", """
    WITH listed AS (SELECT file, size_bytes FROM {stored_files}),
        failures AS (SELECT count(*) AS n FROM {task_events} WHERE state = 'FAILED' AND error_message IS NOT NULL)
    SELECT '# output index' AS line UNION ALL SELECT '' UNION ALL SELECT '## Files'
    UNION ALL SELECT '- `' || file || '` (' || CAST(size_bytes AS VARCHAR) || ' bytes)' FROM listed
    UNION ALL SELECT '' UNION ALL SELECT '## Validation'
    UNION ALL SELECT '- Files checked: ' || CAST(count(*) AS VARCHAR) FROM listed
    UNION ALL SELECT '- Failures: ' || CAST(n AS VARCHAR) FROM failures""")
def index_lines(inputs: Inputs) -> DataFrame:
    files = inputs.stored_files.select(F.col("file").alias("path"), F.col("size_bytes").alias("length"))
    failed = inputs.task_events.where("state = 'FAILED' AND error_message IS NOT NULL").agg(F.count("*")).scalar()
    path = fresh_path(inputs.spark, "index")
    sinks.write_index(sinks.index_lines(files, failed, "output index"), path)
    return inputs.spark.read.text(path).withColumnRenamed("value", "line")
