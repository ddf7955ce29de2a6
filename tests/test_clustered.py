"""Pixel tables clustered by place: composites without a shuffle, boxes from few row groups."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.functions.values import z_order
from gridloom.plans import composite
from gridloom.sources import clustered


@pytest.fixture(scope="module")
def px(spark):
    df = spark.range(120_000).select((F.col("id") % 100).alias("col"), (F.floor(F.col("id") / 100) % 100).alias("row"), F.col("id").alias("scene_id"))
    df = df.withColumns({"dataset_id": F.when(F.col("scene_id") % 3 == 0, "a").otherwise("01b"), "part": F.lit(0).cast("long")})
    df = df.withColumns({"lon": F.col("col") / 10.0, "lat": F.col("row") / 10.0, "ts": F.timestamp_seconds(978307200 + F.col("scene_id") * 400).cast("timestamp_ntz")})
    return df.withColumn("v", (F.col("scene_id") * 7919 % 1009).cast("double"))


@pytest.fixture(scope="module")
def stored(spark, px, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "px")
    clustered.write_clustered(px, path, 4, rows_in_group=500)
    return path


def test_rows_come_back(spark, px, stored):
    back = clustered.clustered(spark, stored)
    assert clustered.clustered(spark, stored).count() == px.count()
    dated = px.withColumn("year", F.year("ts"))
    assert back.select(*dated.columns).exceptAll(dated).count() == 0


def test_a_composite_of_clustered_pixels_has_no_shuffle(spark, px, stored):
    sides = spark.createDataFrame([(0, 0, 1.0, 1.0, 8.0, 1.5), (0, 0, 8.0, 1.5, 5.0, 9.0), (0, 0, 5.0, 9.0, 1.0, 1.0)], "fid long, ring int, x1 double, y1 double, x2 double, y2 double")
    catalog = spark.createDataFrame([(d, "v", ["x"], 1000, "collection", "2001-02-01", "2003-12-31") for d in ("a", "01b")], "dataset_id string, vars string, assets array<string>, scale int, kind string, start string, end string")
    with_layout = composite.named_composite(clustered.clustered(spark, stored), catalog, sides, keep=False)
    plan = with_layout._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Bucketed: true" in plan
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    without = composite.named_composite(px, catalog, sides)
    assert "Exchange hashpartitioning" in without._jdf.queryExecution().executedPlan().toString()
    told = lambda df: sorted(repr(tuple(r)) for r in df.select("dataset_id", "part", "year", "row", "col", "out_name", "v").collect())
    assert told(with_layout) == told(without) and len(told(without)) > 0


def test_a_small_box_reads_few_row_groups(spark, px, stored):
    box = clustered.in_box(clustered.clustered(spark, stored), (40, 44), (10, 14))
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row,40)" in plan
    assert box.count() == px.where("row BETWEEN 40 AND 44 AND col BETWEEN 10 AND 14").count()
    met = total = 0
    for file in glob.glob(f"{stored}/rows/*/*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
        for k in range(meta.num_row_groups):
            span = {c: meta.row_group(k).column(at[c]).statistics for c in ("row", "col")}
            total += 1
            met += span["row"].min <= 44 and span["row"].max >= 40 and span["col"].min <= 14 and span["col"].max >= 10
    assert total > 50 and met < total / 4


def test_z_order_is_the_bits_in_turn(spark):
    df = spark.range(64).select((F.col("id") % 8 - 4).alias("c"), (F.floor(F.col("id") / 8) - 4).alias("r"))
    got = {(r.r, r.c): r.z for r in df.withColumn("z", z_order(F.col("r"), F.col("c"))).collect()}
    bits = lambda n: [(n + (1 << 20)) >> k & 1 for k in range(21)]
    assert all(z == sum(a << 2 * k + 1 | b << 2 * k for k, (a, b) in enumerate(zip(bits(r), bits(c)))) for (r, c), z in got.items())


def test_buckets_grow_with_the_rows(spark, px, tmp_path, monkeypatch):
    assert [clustered.buckets_for(n) for n in (0, 4 * clustered.BUCKET_ROWS, 216_000_000)] == [4, 4, 206]
    monkeypatch.setattr(clustered, "BUCKET_ROWS", 20_000)
    path = str(tmp_path / "px")
    clustered.write_clustered(px, path)
    back = clustered.clustered(spark, path)
    assert spark.read.parquet(f"{path}/_layout").first()["buckets"] == 6
    assert back.count() == px.count()
