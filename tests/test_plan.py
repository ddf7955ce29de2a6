"""The yearly plan, names and gates, on the published dataset periods."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions.names import subfolder
from gridloom.operators import filters, rules, tasks
from gridloom.plans import chunks, composite, external

# Id, kind, first and last day, parts, bands, scale of the raster datasets.
RASTERS = [
    ("01a", "collection", "2002-04-01", "2024-09-30", 1, 1, 1000),
    ("01b", "collection_group", "2015-04-01", "2024-09-30", 2, 2, 1000),
    ("01d", "collection", "2018-05-01", "2024-09-30", 1, 1, 1000),
    ("01e", "collection", "2002-01-01", "2024-09-30", 1, 4, 1000),
    ("01f", "collection", "1979-01-01", "2024-09-30", 1, 6, 1000),
    ("01g", "collection", "2000-02-18", "2024-09-30", 1, 5, 1000),
    ("01h", "collection", "2001-01-01", "2023-12-31", 1, 3, 1000),
    ("01i", "image", "2000-01-01", "2000-12-31", 1, 1, 1000),
    ("01j", "collection", "2008-01-01", "2024-12-31", 1, 1, 30),
    ("01k", "image", "2000-01-01", "2000-12-31", 1, 1, 1000),
    ("01l", "image", "1970-01-01", "2000-12-31", 1, 1, 1000),
    ("01m", "image", "2021-01-01", "2021-12-31", 1, 1, 30),
    ("01n", "collection", "2013-04-01", "2024-09-30", 1, 10, 30),
    ("01o", "collection", "2017-03-28", "2024-09-30", 1, 14, 30),
    ("01p", "collection", "2000-01-01", "2023-12-31", 1, 5, 1000),
    ("01q", "collection", "2003-01-01", "2024-09-30", 1, 1, 1000),
    ("01r", "image", "2017-01-01", "2017-12-31", 1, 4, 1000),
    ("01s", "image", "2000-01-01", "2000-12-31", 1, 3, 1000),
]
# Chunks per raster dataset.
CHUNKS = {
    "01a": 23, "01b": 20, "01d": 7, "01e": 23, "01f": 46, "01g": 25, "01h": 23, "01i": 1, "01j": 17, "01k": 1,
    "01l": 1, "01m": 1, "01n": 12, "01o": 8, "01p": 24, "01q": 22, "01r": 1, "01s": 1,
}
# Beginnings of the external endpoints.
ENDPOINTS = [
    ("02a", "REPLACE_WITH_URL"), ("02b", "https://example.org/b/"), ("02c", "https://example.org/c/"),
    ("02d", "REQUIRES_ACCOUNT"), ("02e", "REQUIRES_REGISTRATION"), ("02f", "REQUIRES_URL"),
    ("02g", "https://example.org/g/"), ("02h", "REPLACE_WITH_URL"), ("02i", "https://example.org/i/"),
    ("02j", "A_COLLECTION_NAME"),
]


RECORD = "dataset_id STRING, kind STRING, start STRING, end STRING, assets ARRAY<STRING>, scale INT, vars STRING"


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [
        (i, kind, start, end, [f"asset/{i}/{p}" for p in range(parts)], [f"b{b}" for b in range(bands)], scale, "MULTI")
        for i, kind, start, end, parts, bands, scale in RASTERS
    ]
    return spark.createDataFrame(
        rows,
        "dataset_id STRING, kind STRING, start STRING, end STRING, assets ARRAY<STRING>, bands ARRAY<STRING>, "
        "scale INT, vars STRING",
    )


def test_plan_has_all_chunks(catalog):
    counted = {r.dataset_id: r["count"] for r in chunks.year_chunks(catalog).groupBy("dataset_id").count().collect()}
    assert counted == CHUNKS
    assert sum(counted.values()) == 256
    assert catalog.agg(F.sum(F.size("bands"))).first()[0] == 64


def test_names_and_labels(catalog):
    named = chunks.named_chunks(chunks.year_chunks(catalog))
    rows = {r.task_label: r.out_name for r in named.collect()}
    assert len(rows) == 256
    assert rows["01b_1_2015"] == "OG_01b_MULTI_part2_2015-01-01_2015-12-31_1000m"
    assert rows["01a_0_2024"] == "OG_01a_MULTI_2024-01-01_2024-12-31_1000m"
    assert rows["01m_0_static"] == "OG_01m_MULTI_2021-01-01_2021-12-31_30m"


def test_period_ending_before_it_starts_has_no_chunks(spark):
    row = [("x", "collection", "2005-01-01", "2004-01-01", ["a"], 30, "V")]
    empty = spark.createDataFrame(row, RECORD)
    assert chunks.year_chunks(empty).count() == 0


def test_list_of_assets_counts_only_for_groups(spark):
    row = [("x", "collection", "2005-01-01", "2006-01-01", ["a", "b"], 30, "V")]
    one = spark.createDataFrame(row, RECORD)
    assert {(r.asset_id, r.year) for r in chunks.year_chunks(one).collect()} == {("a", 2005), ("a", 2006)}


def test_scale_falls_back_to_catalog_then_default(spark):
    cat = spark.createDataFrame([("a", 30), ("b", 30), ("c", None)], "dataset_id STRING, scale INT")
    scales = spark.createDataFrame([("a", 250)], "dataset_id STRING, scale INT")
    assert {r.dataset_id: r.scale for r in chunks.with_scale(cat, scales).collect()} == {"a": 250, "b": 30, "c": 1000}


def test_endpoint_gate(spark):
    cat = spark.createDataFrame(ENDPOINTS, "dataset_id STRING, endpoint STRING")
    assert {r.dataset_id for r in filters.endpoint_gate(cat).collect()} == {"02a", "02d", "02e", "02f", "02h"}
    assert external.configured(cat.withColumn("family", F.lit("external"))).count() == 5


def test_subfolder(spark):
    df = spark.createDataFrame([("01a", "x"), ("02b", "y")], "i STRING, f STRING")
    assert [r[0] for r in df.orderBy("i").select(subfolder(F.col("i"), F.col("f"))).collect()] == [
        "01_gee_rasters/x",
        "02_independent/y",
    ]


def test_dry_run_submits_nothing(catalog):
    plan = chunks.year_chunks(catalog)
    assert filters.dry_run_gate(plan, True).count() == 0
    assert filters.dry_run_gate(plan, False).count() == 256


def test_run_report_labels(spark):
    cat = spark.createDataFrame(
        [("01a", "A", "raster", None), ("01b", "B", "raster", None), ("02a", "C", "external", "REPLACE_X"),
         ("02b", "D", "external", "https://e.org"), ("02c", "E", "external", "https://e.org")],
        "dataset_id STRING, name STRING, family STRING, endpoint STRING",
    )
    reg = spark.createDataFrame([("01a",), ("01a",), ("02b",)], "dataset_id STRING")
    report = {r.dataset_id: (r.n_tasks, r.status) for r in tasks.run_report(cat, reg).collect()}
    assert report == {
        "01a": (2, "QUEUED"), "01b": (0, "FAILED_OR_NOT_RUN"), "02a": (0, "CONFIGURATION_REQUIRED"),
        "02b": (1, "COMPLETED"), "02c": (0, "CONFIGURATION_REQUIRED"),
    }
    dry = {r.dataset_id: r.status for r in tasks.run_report(cat, reg, dry_run=True).collect()}
    assert dry["01a"] == "DRY_RUN_NO_EXPORT"


def test_empty_chunk_keeps_its_row(spark):
    plan = spark.createDataFrame([("d", 0, 2000), ("d", 0, 2001)], "dataset_id STRING, part BIGINT, year INT")
    rows = [("d", 0, 2001, 5), ("d", 0, 2001, 5), ("d", 0, 2001, 6)]
    px = spark.createDataFrame(rows, "dataset_id STRING, part BIGINT, year INT, scene_id INT")
    assert {(r.year, r.n_img, r.n_px) for r in chunks.chunk_sizes(px, plan).collect()} == {(2000, 0, 0), (2001, 2, 3)}


def test_admission_respects_the_cap(spark):
    plan = spark.createDataFrame([(f"t{i:02d}",) for i in range(30)], "task STRING")
    reg = spark.createDataFrame([("t00", "RUNNING"), ("t01", "COMPLETED"), ("zz", "STARTED")], "task STRING, status STRING")
    admitted = [r.task for r in tasks.admission_list(plan, reg, "task", cap=5).orderBy("slot").collect()]
    assert admitted == ["t02", "t03", "t04"]
    busy = spark.createDataFrame([(f"x{i}", "RUNNING") for i in range(20)], "task STRING, status STRING")
    assert tasks.admission_list(plan, busy, "task").count() == 0


def test_poll_merge_cases(spark):
    reg = spark.createDataFrame(
        [("a", "STARTED", None, None), ("b", "RUNNING", None, "old"), ("c", "COMPLETED", "e0", None),
         ("d", "STARTED", "e0", None), ("e", "STARTED", None, None), ("", "STARTED", None, None), (None, "RUNNING", None, None)],
        "task STRING, status STRING, end_time STRING, error_message STRING",
    )
    polls = spark.createDataFrame(
        [("a", "READY", "p1", None), ("a", "CANCELLED", "p2", "stop"), ("b", "COMPLETED", "p3", None), ("c", "FAILED", "p4", "x"),
         ("d", "SOMETHING_ELSE", "p5", None), ("", "FAILED", "p6", "y")],
        "task STRING, state STRING, polled_at STRING, error_message STRING",
    )
    merged = tasks.poll_merge(reg, polls, "task", ["polled_at"])
    got = {r.task: (r.status, r.end_time, r.error_message) for r in merged.collect()}
    assert got == {
        "a": ("FAILED", "p2", "stop"), "b": ("COMPLETED", "p3", None), "c": ("COMPLETED", "e0", None),
        "d": ("SOMETHING_ELSE", None, None), "e": ("STARTED", None, None), "": ("STARTED", None, None),
        None: ("RUNNING", None, None),
    }


def test_poll_without_a_state_is_unknown(spark):
    reg = spark.createDataFrame([("a", "RUNNING", "e0", "old")], "task STRING, status STRING, end_time STRING, error_message STRING")
    polls = spark.createDataFrame([("a", None, "p1", None)], "task STRING, state STRING, polled_at STRING, error_message STRING")
    merged = tasks.poll_merge(reg, polls, "task", ["polled_at"]).first()
    assert (merged.status, merged.end_time, merged.error_message) == ("UNKNOWN", None, None)


def test_active_count_of_nothing(spark):
    assert tasks.active_count(spark.createDataFrame([], "status STRING")).first().n_active == 0


def test_named_composite_has_partial_years(spark):
    days = ["2001-03-31", "2001-04-01", "2001-12-31", "2002-09-29", "2002-09-30"]
    px = spark.createDataFrame(
        [("d", 0, i, day, 0, 0, 0.5, 0.5, float(i)) for i, day in enumerate(days)],
        "dataset_id STRING, part BIGINT, scene_id BIGINT, ts STRING, row BIGINT, col BIGINT, lon DOUBLE, lat DOUBLE, v DOUBLE",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    cat = spark.createDataFrame(
        [("d", "collection", "2001-04-01", "2002-09-30", ["a"], 1000, "V")],
        RECORD,
    )
    square = [(0, 0, 0.0, 0.0, 1.0, 0.0), (0, 0, 1.0, 0.0, 1.0, 1.0), (0, 0, 1.0, 1.0, 0.0, 1.0), (0, 0, 0.0, 1.0, 0.0, 0.0)]
    sides = spark.createDataFrame(square, "fid BIGINT, ring INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    got = {(r.year, r.v, r.out_name) for r in composite.named_composite(px, cat, sides).collect()}
    assert got == {
        (2001, 1.5, "OG_d_V_2001-01-01_2001-12-31_1000m"),
        (2002, 3.0, "OG_d_V_2002-01-01_2002-12-31_1000m"),
    }


def test_static_image_is_clipped_and_named(spark):
    pixels = [("s", 0, 0, 0.5, 0.5, 7.0), ("s", 0, 1, 1.5, 0.5, 8.0), ("other", 0, 0, 0.5, 0.5, 9.0)]
    image = spark.createDataFrame(
        pixels, "dataset_id STRING, row BIGINT, col BIGINT, lon DOUBLE, lat DOUBLE, v DOUBLE"
    )
    cat = spark.createDataFrame(
        [("s", "image", "2001-01-01", "2001-12-31", ["a"], 30, "V"), ("other", "collection", "2001-01-01", "2001-12-31", ["a"], 30, "V")],
        RECORD,
    )
    square = [(0, 0, 0.0, 0.0, 1.0, 0.0), (0, 0, 1.0, 0.0, 1.0, 1.0), (0, 0, 1.0, 1.0, 0.0, 1.0), (0, 0, 0.0, 1.0, 0.0, 0.0)]
    sides = spark.createDataFrame(square, "fid BIGINT, ring INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    kept = composite.named_static(image, cat, sides).collect()
    assert [(r.v, r.out_name) for r in kept] == [(7.0, "OG_s_V_2001-01-01_2001-12-31_30m")]


def test_first_errors_in_order(spark):
    errors = spark.range(50).select((49 - F.col("id")).alias("nth"))
    assert [r.nth for r in rules.first_errors(errors, ["nth"]).collect()] == list(range(20))
