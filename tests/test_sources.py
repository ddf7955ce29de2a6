"""Readers and writers on small files."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from gridloom.functions.paths import stem, suffix, url_suffix
from gridloom.functions.status import format_iso, parse_iso
from gridloom.operators.axes import normalise_axes
from gridloom.operators.composites import time_mean
from gridloom.operators.filters import filter_date
from gridloom.operators.quality import qc_stats, qc_stats_wide
from gridloom.plans import steps
from gridloom.shared import fresh_path, shared_folder
from gridloom.sources import boundary, catalog, payloads, pixels, registry, sinks


def test_catalog_document(spark, tmp_path):
    document = {
        "MASTER_SCALE": {"01a": 250},
        "datasets": {
            "01a": {"name": "A", "asset_id": "x/y", "bands": ["p", "q"], "scale": 30, "kind": "collection"},
            "01b": {"name": "B", "asset_id": ["u", "v"], "bands": ["r"], "kind": "collection_group"},
            "01c": {"name": "C"},
        },
        "independent_datasets": {"02a": {"name": "D", "endpoint": "REPLACE_ME"}},
    }
    (tmp_path / "catalog.json").write_text(json.dumps(document, indent=2))
    rows = {r.dataset_id: r for r in catalog.catalog(spark, str(tmp_path / "catalog.json")).collect()}
    assert {k: r.assets for k, r in rows.items()} == {"01a": ["x/y"], "01b": ["u", "v"], "01c": [], "02a": []}
    assert rows["01a"].family == "raster" and rows["02a"].family == "external"
    scales = catalog.master_scales(spark, str(tmp_path / "catalog.json")).collect()
    assert [(r.dataset_id, r.scale) for r in scales] == [("01a", 250)]


def _feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def test_boundary_collection(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    hole = [[0.5, 0.5], [1, 0.5], [1, 1]]
    other = [[5, 5], [6, 5], [6, 6], [5, 5]]
    features = [
        _feature("Polygon", [square, hole], zone="yes"),
        _feature("MultiPolygon", [[square], [other]], zone="no"),
    ]
    path = tmp_path / "b.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    shapes = boundary.boundary(spark, str(path))
    sides = boundary.edges(shapes)
    counted = {(r.fid, r.ring): r["count"] for r in sides.groupBy("fid", "ring").count().collect()}
    assert counted == {(0, 0): 4, (0, 1): 3, (1, 0): 4, (1, 1): 3}
    closing = sides.where("fid = 0 AND ring = 1 AND x1 = 1 AND y1 = 1").first()
    assert (closing.x2, closing.y2) == (0.5, 0.5)
    assert [r.fid for r in boundary.boundary(spark, str(path), pick="first").collect()] == [0]
    assert [r.fid for r in boundary.filter_features(shapes, "zone", "no").collect()] == [1]
    assert tuple(boundary.total_bounds(sides).first()) == (0.0, 0.0, 6.0, 6.0)


HEADER = "timestamp,notebook_id,dataset,task_id_or_file,pathway,status,start_time,end_time,n_bytes,error_message,retries"


def test_registry_reads_blanks_decimals_and_quotes(spark, tmp_path):
    lines = [
        HEADER,
        "2026-01-01T10:08:44.749321+00:00,01a,A,t1,xee,COMPLETED,2026-01-01T10:00:00+00:00,,,,",
        '2026-01-01T12:00:00+02:00,01b,B,t2,batch,FAILED,,,12.0,"too ""many"", sorry",3.0',
        "not a time,01c,C,,batch,STARTED,,,,,0",
    ]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    events = registry.registry(spark, str(tmp_path / "r.csv"), foreign=True).withColumn("ts", F.unix_micros("timestamp"))
    rows = {r.notebook_id: r for r in events.collect()}
    assert rows["01a"].ts == 1767262124749321
    assert rows["01b"].ts == 1767261600000000
    assert rows["01b"].n_bytes == 12 and rows["01b"].retries == 3
    assert rows["01b"].error_message == 'too "many", sorry'
    assert rows["01a"].end_time is None and rows["01a"].n_bytes is None
    assert rows["01c"].ts is None and rows["01c"].task_id_or_file is None and rows["01c"].retries == 0


def test_append_keeps_earlier_events(spark, tmp_path):
    path = str(tmp_path / "reg")
    for n in range(3):
        registry.append_event(spark.createDataFrame([(f"t{n}", "STARTED")], "task_id_or_file STRING, status STRING"), path)
    back = registry.registry(spark, path)
    assert sorted(r.task_id_or_file for r in back.collect()) == ["t0", "t1", "t2"]
    assert back.where("timestamp IS NULL").count() == 0


def test_messages_keep_line_breaks(spark, tmp_path):
    message = 'first, "quoted"\nsecond\n\nlast'
    path = str(tmp_path / "reg")
    registry.append_event(spark.createDataFrame([("t", message)], "task_id_or_file STRING, error_message STRING"), path)
    assert [(r.task_id_or_file, r.error_message) for r in registry.registry(spark, path).collect()] == [("t", message)]


def test_ids_that_look_like_numbers_stay_text(spark, tmp_path):
    rows = [(i, 0, 2001, 1.0) for i in ("01d", "01f", "02")]
    path = str(tmp_path / "composite")
    pixels.write_composite(spark.createDataFrame(rows, "dataset_id STRING, part BIGINT, year INT, v DOUBLE"), path)
    back = pixels.read_partitioned(spark, path)
    assert sorted(tuple(r) for r in back.select("dataset_id", "part", "year", "v").collect()) == rows
    assert dict(back.dtypes)["dataset_id"] == "string" and dict(back.dtypes)["part"] == "bigint"


def test_iso_round_trip(spark):
    df = spark.createDataFrame([("2026-07-26T10:08:44.749321+00:00",), ("2026-07-26T10:08:44-05:30",), ("",), (None,)], "t STRING")
    back = [r[0] for r in df.select(format_iso(parse_iso(F.col("t")))).collect()]
    assert back == ["2026-07-26T10:08:44.749321+00:00", "2026-07-26T15:38:44.000000+00:00", None, None]


def test_raw_payloads_by_suffix(spark, tmp_path):
    sizes = {"a.TIF": 3, "b.nc4": 5, "sub/c": 7, "sub/d.csv": 1, ".hidden.nc": 2}
    for name, size in sizes.items():
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    listed = payloads.raw_payloads(spark, str(tmp_path / "raw")).collect()
    found = {os.path.basename(r.path): (r.length, r.suffix, r.payload_class) for r in listed}
    assert found["a.TIF"] == (3, ".tif", "raster")
    assert found["b.nc4"] == (5, ".nc4", "gridded")
    assert found["c"] == (7, ".bin", "other")
    assert found["d.csv"] == (1, ".csv", "other")
    grid = payloads.payload_grid(payloads.raw_payloads(spark, str(tmp_path / "raw")).where("suffix = '.bin'")).first()
    assert (grid.y, grid.x, grid.value) == (0.0, 0.0, 7.0)


@pytest.mark.parametrize(
    "url, wanted",
    [
        ("https://e.org/data/file.TIF?x=1.nc", ".TIF"),
        ("https://e.org/data/", ".bin"),
        ("https://e.org", ".bin"),
        ("https://e.org/a.b/c", ".bin"),
        ("https://e.org/a/archive.tar.gz#top", ".gz"),
        ("https://e.org/.profile", ".bin"),
        ("https://e.org/x.nc;v=2", ".nc"),
        ("https://e.org/x.", ".bin"),
        ("local/x.nc", ".nc"),
    ],
)
def test_url_suffix(spark, url, wanted):
    assert spark.range(1).select(url_suffix(F.lit(url))).first()[0] == wanted


def test_stem(spark):
    df = spark.createDataFrame([("/a/b.tar.gz",), ("/a/.x",), ("c",)], "p STRING")
    assert [tuple(r) for r in df.select(stem(F.col("p")), suffix(F.col("p"))).collect()] == [("b.tar", ".gz"), (".x", ""), ("c", "")]


def test_pixels_are_pruned_by_dataset_and_year(spark, tmp_path):
    px = spark.range(100).select(
        F.concat(F.lit("0"), F.col("id") % 3).alias("dataset_id"), F.lit(0).alias("part"), F.col("id").alias("scene_id"),
        F.make_date((F.col("id") % 4 + 2000).cast("int"), F.lit(6), F.lit(1)).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("row"), F.col("id").alias("col"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), F.lit(1.0).alias("v"),
    )
    path = str(tmp_path / "px")
    pixels.write_px_obs(px, path)
    # Ids like 00 must come back as text, not as numbers.
    kept = filter_date(pixels.px_obs(spark, path, "01"), "2001-01-01", "2002-01-01")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan and "year" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    wanted = px.where("dataset_id = '01' AND year(ts) = 2001").count()
    assert kept.count() == wanted > 0


def test_collection_group_tags(spark):
    one = spark.createDataFrame([(1, 1.0)], "scene_id INT, a DOUBLE")
    two = spark.createDataFrame([(2, 2.0)], "scene_id INT, b DOUBLE")
    rows = {r.scene_id: r for r in pixels.collection_group([one, two]).collect()}
    assert (rows[1].part, rows[1].part_tag, rows[1].b) == (0, "_part1", None)
    assert (rows[2].part, rows[2].part_tag, rows[2].a) == (1, "_part2", None)
    assert pixels.collection_group([one]).first().part_tag == ""


def test_manifest_lists_existing_files_once(spark, tmp_path):
    files = spark.range(1000).select(
        F.when(F.col("id") < 900, "big").otherwise("small").alias("notebook_id"), F.lit("COMPLETED").alias("status"),
        F.concat(F.lit("f"), F.col("id")).alias("file"), F.lit("d").alias("dataset"),
    )
    inventory = files.where("file <> 'f7'").select("file", F.lit(5).cast("bigint").alias("size_bytes"))
    sinks.write_manifest(sinks.manifest(files, inventory), str(tmp_path / "manifest"))
    listed = spark.read.json(str(tmp_path / "manifest" / "notebook_id=big")).collect()
    assert len(listed) == len({line.file for line in listed}) == 899 and "f7" not in {line.file for line in listed}
    assert {line.size_bytes for line in listed} == {5}
    assert spark.read.json(str(tmp_path / "manifest")).count() == 999


def test_features_without_numbers_stay_apart(spark, tmp_path):
    square = '{"type": "Feature", %s"properties": {"n": "%s"}, "geometry": {"type": "Polygon", "coordinates": [[[%d,0],[9,0],[9,9],[%d,0]]]}}'
    lines = [square % ("", "a", 0, 0), square % ("", "b", 1, 1), square % ('"id": "x", ', "c", 2, 2), square % ('"id": 7, ', "d", 3, 3)]
    path = tmp_path / "layer.json"
    path.write_text("\n".join(lines))
    fids = [r.fid for r in boundary.boundary(spark, str(path), layout="lines").collect()]
    assert len(set(fids)) == 4 and 7 in fids


def test_features_that_share_a_number_keep_their_parts(spark, tmp_path):
    square = '{"type": "Feature", "id": %s, "properties": {"n": "%s"}, "geometry": {"type": "Polygon", "coordinates": [[[%d,0],[%d,0],[%d,1],[%d,0]]]}}'
    lines = [square % (i, n, x, x + 1, x + 1, x) for i, n, x in ((7, "a", 0), (7, "a", 4), (7, "b", 4), (7, "a", 0), ('"x"', "a", 0), ('"x"', "a", 4), ('"x"', "a", 0))]
    path = tmp_path / "layer.json"
    path.write_text("\n".join(lines))
    rows = boundary.boundary(spark, str(path), layout="lines").collect()
    assert sorted((r.properties["n"], r.rings[0][0][0]) for r in rows if r.fid == 7) == [("a", 0.0), ("a", 4.0), ("b", 4.0)]
    assert sorted(r.rings[0][0][0] for r in rows if r.fid < 0) == [0.0, 4.0]


def test_registry_numbers_and_breaks(spark, tmp_path):
    path = str(tmp_path / "events")
    message = "a\\nb\nc\r\\"
    events = spark.createDataFrame([("t", message, "9007199254740993"), ("u", None, "unknown"), ("v", "", "12.0")], "task_id_or_file string, error_message string, n_bytes string")
    registry.append_event(events, path)
    got = {r.task_id_or_file: (r.error_message, r.n_bytes) for r in registry.registry(spark, path).collect()}
    assert got == {"t": (message, 9007199254740993), "u": (None, None), "v": (None, 12)}


def test_static_images_have_no_time(spark, tmp_path):
    image = spark.createDataFrame([("01c", 1, 2, 3.0)], "dataset_id string, row long, col long, band double")
    pixels.write_px_obs(image, str(tmp_path / "images"))
    assert pixels.static_image(spark, str(tmp_path / "images"), "01c").select("row", "col", "band").collect() == [(1, 2, 3.0)]


def test_index_text_is_in_order(spark, tmp_path):
    files = spark.createDataFrame([("b.nc", 2), ("a.nc", 1)], "path STRING, length BIGINT")
    path = str(tmp_path / "index")
    sinks.write_index(sinks.index_lines(files, F.lit(3), "out"), path)
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    text = "".join(open(os.path.join(path, p)).read() for p in parts)
    assert text == (
        "# out\n\n## Files\n- `a.nc` (1 bytes)\n- `b.nc` (2 bytes)\n\n## Validation\n- Files checked: 2\n- Failures: 3\n"
    )
    timed = sinks.index_lines(files, F.lit(3), "out", F.lit("2024-01-01T00:00:00+00:00")).orderBy("section", "line")
    assert [r.line for r in timed.collect()][:5] == ["# out", "", "Generated: 2024-01-01T00:00:00+00:00", "", "## Files"]


def test_quality_of_empty_and_infinite_values(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", float("nan")), ("a", float("inf")), ("b", None), ("b", float("-inf"))]
    long = qc_stats(spark.createDataFrame(rows, "var STRING, value DOUBLE"))
    got = {r.var: tuple(r)[1:] for r in long.collect()}
    assert got == {"a": (1.0, 3.0, 2.0, 1.0, 2), "b": (None, None, None, None, 0)}
    wide = spark.createDataFrame([(1.0, None), (3.0, float("-inf")), (float("nan"), None)], "a DOUBLE, b DOUBLE")
    assert {r.var: tuple(r)[1:] for r in qc_stats_wide(wide, ["a", "b"]).collect()} == got


def test_time_mean_ignores_nan_and_keeps_untimed_grids(spark):
    rows = [
        ("v", "2001-01-01", 0.0, 0.0, 2.0),
        ("v", "2001-01-02", 0.0, 0.0, float("nan")),
        ("v", "2001-01-03", 0.0, 0.0, 4.0),
        ("v", "2001-01-01", 1.0, 0.0, None),
    ]
    grid = spark.createDataFrame(rows, "var STRING, time STRING, y DOUBLE, x DOUBLE, value DOUBLE")
    assert {(r.y, r.value) for r in time_mean(grid).collect()} == {(0.0, 3.0), (1.0, None)}
    untimed = grid.drop("time")
    assert time_mean(untimed) is untimed


def test_axes_keep_given_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "lat DOUBLE, lon DOUBLE, y DOUBLE")
    assert normalise_axes(df).first().asDict() == {"lat": 1.0, "x": 2.0, "y": 3.0, "lon": 2.0}


def test_failed_step_is_recorded_and_gives_no_rows(spark, tmp_path):
    path = str(tmp_path / "audit")

    def fails():
        raise ValueError("no such asset")

    def lazily_fails():
        return spark.range(1).select(F.raise_error(F.lit("late")).cast("string").alias("v"))

    for step in (fails, lazily_fails):
        assert steps.audited_step(spark, step, path, "01a", "d", "v STRING", pathway="batch").count() == 0
    rows = registry.registry(spark, path).collect()
    assert {(r.task_id_or_file, r.status, r.pathway) for r in rows} == {("fails", "FAILED", "batch"), ("lazily_fails", "FAILED", "batch")}
    assert all(r.start_time <= r.end_time for r in rows)
    assert "no such asset" in {r.task_id_or_file: r.error_message for r in rows}["fails"]


def test_work_folder_comes_from_the_session(spark, tmp_path):
    named = str(tmp_path / uuid.uuid4().hex)
    spark.sparkContext._conf.set("spark.checkpoint.dir", named)
    try:
        assert shared_folder(spark) == named
        assert fresh_path(spark, "x").startswith(f"{named}/gridloom/{spark.sparkContext.applicationId}/x-")
    finally:
        spark.sparkContext._conf._jconf.remove("spark.checkpoint.dir")
