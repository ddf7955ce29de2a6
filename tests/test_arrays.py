"""Scene arrays with halos, and grids stored as chunked arrays."""

import datetime
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import scenes
from gridloom.operators.composites import to_grid
from gridloom.sources import chunks, sinks

PIXELS = "dataset_id string, part long, scene_id long, row long, col long, v double"


def _scene(rng, scene, rows, cols, share):
    return [("d", 0, scene, r, c, None if rng.random() < 0.1 else float(rng.integers(0, 100))) for r in range(rows) for c in range(cols) if rng.random() < share]


def _window_mean():
    """A function made here travels to the tasks by value."""

    def mean(arrays):
        v = arrays["v"]
        padded = np.pad(v, [(0, 0), (2, 2), (2, 2)], constant_values=np.nan)
        stack = np.stack([padded[:, a : a + v.shape[1], b : b + v.shape[2]] for a in range(5) for b in range(5)])
        held = ~np.isnan(stack)
        with np.errstate(invalid="ignore", divide="ignore"):
            return {"mean": np.where(held, stack, 0).sum(axis=0) / held.sum(axis=0), "n": held.sum(axis=0).astype(float)}

    return mean


@pytest.mark.parametrize(("block", "cells"), [(4, 1 << 20), (7, 300), (64, 1 << 20)])
def test_a_focal_mean_crosses_block_edges(spark, monkeypatch, block, cells):
    monkeypatch.setattr(scenes, "CELLS", cells)
    rng = np.random.default_rng(3)
    rows = _scene(rng, 1, 23, 17, 1.0) + _scene(rng, 2, 30, 30, 0.4) + _scene(rng, 3, 1, 1, 1.0)
    rows += [("d", 0, 4, -5, -9, 2.0), ("d", 0, 4, -4, -8, 4.0), ("d", 0, 4, 100_000, 3, 1.0)]
    px = spark.createDataFrame(rows, PIXELS)
    got = scenes.map_arrays(px, ["v"], _window_mean(), ["mean", "n"], halo=2, block=block)
    found = {(r.scene_id, r.row, r.col): (r["mean"], r.n) for r in got.collect()}
    known = {(s, r, c): v for _, _, s, r, c, v in rows}
    assert found.keys() == known.keys() and got.count() == len(known)
    for (s, r, c), (mean, n) in found.items():
        near = [known.get((s, r + a, c + b)) for a in range(-2, 3) for b in range(-2, 3)]
        near = [v for v in near if v is not None]
        assert n == len(near) and (mean == pytest.approx(sum(near) / len(near)) if near else mean is None)


def test_repeated_pixels_are_averaged_and_nothing_gives_nothing(spark):
    px = spark.createDataFrame([("d", 0, 1, 0, 0, 1.0), ("d", 0, 1, 0, 0, 4.0), (None, None, None, 2, 2, 7.0)], PIXELS)
    same = lambda arrays: {"v": arrays["v"]}
    assert sorted(r.v for r in scenes.map_arrays(px, ["v"], same, ["v"]).collect()) == [2.5, 7.0]
    assert scenes.map_arrays(px.limit(0), ["v"], same, ["v"]).count() == 0


def _rows_of(df):
    return Counter(repr(tuple(r[c] for c in ("dataset_id", "part", "var", "time", "y", "x", "value"))) for r in df.collect())


def _grid(spark):
    rng = np.random.default_rng(5)
    day = datetime.date(2001, 1, 1)
    rows = [("a", k % 2, f"v{k % 3}", day + datetime.timedelta(int(t)), float(y) / 4, float(x) / 4, float(v))
            for k, (t, y, x, v) in enumerate(zip(rng.integers(0, 60, 4000), rng.integers(0, 70, 4000), rng.integers(0, 50, 4000), rng.normal(size=4000)))]
    rows += [rows[7]] * 5 + [("b", 0, "v0", None, None, 1.0, 2.0), ("b", 0, "v0", day, 2.0, None, None), ("b", 0, "v0", day, 2.0, 1.0, math.nan), (None, None, None, day, 0.0, 0.0, -0.0)]
    rows += [("b", 0, "v0", day, 2.0, 1.0, None), ("b", 0, "v0", day, 2.0, 1.0, math.inf)]
    return spark.createDataFrame(rows, "dataset_id string, part long, var string, time date, y double, x double, value double")


@pytest.mark.parametrize("side", [24, 5])
def test_chunks_round_trip(spark, tmp_path, side):
    grid = _grid(spark)
    chunks.write_chunks(grid, str(tmp_path / "g"), side)
    assert _rows_of(chunks.read_chunks(spark, str(tmp_path / "g"))) == _rows_of(grid)
    stored = spark.read.parquet(str(tmp_path / "g"))
    assert stored.agg(F.max(F.greatest("n_time", "n_y", "n_x"))).first()[0] <= side
    assert stored.where("NOT dense").count() >= 1 and stored.count() < grid.count()


def test_a_very_often_repeated_cell_is_in_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunks, "LIST", 100)
    grid = spark.range(3000).select(F.lit("v").alias("var"), F.lit(1.0).alias("y"), (F.col("id") % 2).cast("double").alias("x"), F.col("id").cast("double").alias("value"))
    chunks.write_chunks(grid, str(tmp_path / "g"))
    back = chunks.read_chunks(spark, str(tmp_path / "g"))
    assert back.count() == 3000 and back.agg(F.sum("value")).first()[0] == 3000 * 2999 / 2
    assert back.where("time IS NOT NULL").isEmpty()


def test_a_window_decodes_only_its_chunks(spark, tmp_path):
    grid = _grid(spark)
    path = str(tmp_path / "g")
    chunks.write_chunks(grid, path, 8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    got = chunks.read_chunks(spark, path, y=(3.0, 4.5), x=(1.0, 2.0))
    assert _rows_of(got) == _rows_of(grid.where("y BETWEEN 3.0 AND 4.5 AND x BETWEEN 1.0 AND 2.0"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters: [") :]
    assert all(f in pushed for f in ("LessThanOrEqual(min_y,4.5)", "GreaterThanOrEqual(max_y,3.0)", "LessThanOrEqual(min_x,2.0)", "GreaterThanOrEqual(max_x,1.0)"))
    stored = spark.read.parquet(path)
    inside = stored.where("min_y <= 4.5 AND max_y >= 3.0 AND min_x <= 2.0 AND max_x >= 1.0")
    assert 0 < inside.count() < stored.count() / 5
    with pytest.raises(ValueError, match="no axis"):
        chunks.read_chunks(spark, path, z=(0, 1))


def test_grid_sink_reads_a_window(spark, tmp_path):
    px = spark.createDataFrame([("a", 0, datetime.datetime(2001, 2, 3), float(k), 0.0, float(k)) for k in range(60)], "dataset_id string, part long, ts timestamp, lat double, lon double, v double")
    none = spark.createDataFrame([("a", {"title": "t"})], "dataset_id string, attrs map<string,string>")
    sinks.write_grid(to_grid(px, ["v"]), none, none.withColumn("var", F.lit("y")), str(tmp_path / "s"))
    back = sinks.read_grid(spark, str(tmp_path / "s"), y=(10.0, 12.0))
    assert sorted(r.value for r in back["grid"].collect()) == [10.0, 11.0, 12.0] and back["attrs"].count() == 1


def test_an_empty_grid(spark, tmp_path):
    grid = _grid(spark).limit(0)
    chunks.write_chunks(grid, str(tmp_path / "g"))
    assert chunks.read_chunks(spark, str(tmp_path / "g")).count() == 0


def test_cells_are_dealt_once_and_by_number(spark, tmp_path, monkeypatch):
    """No pass to find ranges of the cells: only the encoded chunks are ranged over files."""
    grid, seen = _grid(spark), []
    plain = chunks.materialise
    monkeypatch.setattr(chunks, "materialise", lambda df, name: (seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())), plain(df, name))[1])
    chunks.write_chunks(grid, str(tmp_path / "g"), 5)
    plan = dict(seen)["grid-chunks"]
    assert "RepartitionByExpression [_chunk" in plan and "ASC" in plan and plan.count("ASC") == 1
    assert _rows_of(chunks.read_chunks(spark, str(tmp_path / "g"))) == _rows_of(grid)
