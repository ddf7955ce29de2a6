"""Medians and row numbers when one key holds a third of the rows and more."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import skew
from gridloom.operators.medians import key_values, median_by, ordered_keys
from gridloom.operators.skew import row_number_by
from gridloom.operators.tasks import latest_status, retry_ladder


def _pixels(spark, rows, seed=5):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        key = ("a", None) if i % 3 == 0 else ("b", i % 40)
        value = None if rng.random() < 0.1 else round(rng.uniform(-50, 50), 2)
        data.append((*key, value, rng.choice([1.0, 2.0, 7.0]), None if key[0] == "a" else 3.0))
    return spark.createDataFrame(data, "k1 STRING, k2 INT, u DOUBLE, v DOUBLE, w DOUBLE"), data


def _brute(data, bands="uvw"):
    groups = {}
    for k1, k2, *values in data:
        for band, value in zip(bands, values):
            held = groups.setdefault((k1, k2, band), [])
            if value is not None:
                held.append(value)
    return {key: statistics.median(values) if values else None for key, values in groups.items()}


def _flat(rows, bands):
    return {(r.k1, r.k2, band): r[band] for r in rows for band in bands}


@pytest.mark.parametrize(("task_rows", "keep"), [(10**9, False), (10**9, True), (500, True), (0, False)])
@pytest.mark.parametrize("rows", [3000, 3001])
def test_median_is_exact_on_every_path(spark, rows, task_rows, keep):
    df, data = _pixels(spark, rows)
    medians = median_by(df, ["k1", "k2"], ["u", "v", "w"], task_rows, keep).collect()
    assert _flat(medians, "uvw") == pytest.approx(_brute(data))
    assert 3 * len(medians) == len(_brute(data))


def test_a_kept_input_is_read_once(spark, tmp_path):
    """Records that the scan of the input gives, counted by the input's own task metrics."""
    spark.range(5000).selectExpr("id % 7 AS k", "CAST(id AS DOUBLE) AS v").write.parquet(str(tmp_path / "px"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for keep, times in ((True, 1), (False, 2)):
        before = seen.value
        df = spark.read.parquet(str(tmp_path / "px")).mapInArrow(counted, "k long, v double")
        assert len(median_by(df, ["k"], ["v"], keep=keep).collect()) == 7
        assert seen.value - before == 5000 * times


def test_hot_median_without_broadcast(spark, no_broadcast):
    df, data = _pixels(spark, 2000, seed=9)
    medians = median_by(df, ["k1", "k2"], ["u"], 100).collect()
    assert _flat(medians, "u") == pytest.approx(_brute(data, "u"))


def test_hot_median_of_few_distinct_values(spark):
    df = spark.range(10_000).select(F.lit(1).alias("k"), (F.col("id") % 4).alias("v"))
    assert median_by(df, ["k"], ["v"], 100).first().v == 1.5


def test_radix_selection_of_odd_values_equals_the_built_in_median(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(8)
    pool = [nan, inf, -inf, 0.0, -0.0, 1.0, 1.0 + 2**-52, -1.0, 5e-324, -5e-324, 1e308, -1e308, 3.5, None]
    groups = [[nan], [nan, 1.0], [inf, -inf], [inf, inf], [-0.0, 0.0], [None], [None, 2.0], [1e308, 1e308], [5e-324, -5e-324], [nan, nan, 1.0], []]
    groups += [[rng.choice(pool) for _ in range(n)] for n in (2, 3, 10, 11, 200, 201)] + [[rng.uniform(-1, 1) for _ in range(501)]]
    rows = [(k, v) for k, values in enumerate(groups) for v in values]
    df = spark.createDataFrame(rows, "k int, v double")
    told = lambda task_rows: {r.k: repr(r.v if r.v is None else r.v + 0.0) for r in median_by(df, ["k"], ["v"], task_rows).collect()}
    assert told(0) == told(10**9)


def test_keys_keep_the_order_of_values():
    values = np.array([-np.inf, -1e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e308, np.inf, np.nan])
    keys = ordered_keys(values)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5] and len(set(keys.tolist())) == len(values) - 1
    assert repr(key_values(keys).tolist()) == repr([0.0 if v == 0 else v for v in values.tolist()])


def _pieces_of(monkeypatch):
    """Corrections that row numbers take: rows of the table of carries."""
    seen = []
    carries = skew.carries
    monkeypatch.setattr(skew, "carries", lambda edges: seen.append(carries(edges)) or seen[-1])
    return seen


def test_corrections_are_one_per_piece_however_many_keys(spark, monkeypatch):
    seen = _pieces_of(monkeypatch)
    df = spark.range(200_000).select((F.col("id") * 7919 % 100_003).alias("k"), F.col("id"))
    numbered = row_number_by(df, ["k"], ["id"], "n")
    assert numbered.where("n > 2 OR n < 1").count() == 0
    assert numbered.where("n = 1").count() == 100_003
    assert seen[0].count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_carries_go_through_whole_pieces(spark):
    edges = [(0, "a", "b", 3, False), (1, "b", "b", 5, True), (2, "b", "b", 4, True), (3, "b", "c", 2, False), (4, "d", "d", 6, True), (5, "d", "e", 1, False), (6, None, None, 2, True), (7, None, None, 2, True)]
    table = spark.createDataFrame([(p, (0, h), (0, t), n, w) for p, h, t, n, w in edges], "_piece long, _head struct<z: int, k: string>, _tail struct<z: int, k: string>, _rows long, _whole boolean")
    assert [r._carry for r in skew.carries(table).orderBy("_piece").collect()] == [0, 3, 8, 12, 0, 6, 0, 2]


@pytest.mark.parametrize("kind", ["double", "string", "array<int>", "timestamp", "decimal(9,2)"])
def test_row_numbers_by_keys_of_any_kind(spark, kind):
    values = {"double": "CASE id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN NULL WHEN 2 THEN -0.5D ELSE 2D END", "string": "nullif(concat('k', id % 3), 'k1')",
              "array<int>": "array(int(id % 3))", "timestamp": "timestamp_seconds(id % 3)", "decimal(9,2)": "CAST(id % 3 AS DECIMAL(9,2))"}
    df = spark.range(600).selectExpr("id", f"CAST({values[kind]} AS {kind}) AS k")
    rows = row_number_by(df, ["k"], ["id"], "n").collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r.id):
        groups.setdefault(repr(r.k), []).append(r.n)
    assert len(groups) in (3, 4) and all(numbers == list(range(1, len(numbers) + 1)) for numbers in groups.values())


def test_row_number_of_a_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("k"),
        (F.col("id") * 7919 % 5003).alias("t"),
        F.col("id"),
    )
    rows = row_number_by(df, ["k"], ["t", "id"], "n").collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.k, []).append((r.t, r.id, r.n))
    assert len(rows) == 5000
    for members in by_key.values():
        assert [n for *_, n in sorted(members)] == list(range(1, len(members) + 1))


def test_rows_without_a_key_are_numbered_too(spark):
    df = spark.range(10).select(F.when(F.col("id") < 4, "a").alias("k"), F.col("id").alias("t"))
    rows = row_number_by(df, ["k"], ["t"], "n").collect()
    assert sorted((r.k or "", r.t, r.n) for r in rows) == [("", t, t - 3) for t in range(4, 10)] + [("a", t, t + 1) for t in range(4)]


def test_row_number_spreads_one_key_and_one_time_over_tasks(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.lit(0).alias("t"), F.col("id"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = row_number_by(df, ["k"], ["t", "id"], "n")
        assert numbered.where("n <> id + 1").count() == 0
        assert numbered.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_latest_of_a_hot_task(spark):
    df = spark.range(1000).select(F.lit("hot").alias("task"), F.lit(0).alias("t"), F.col("id").alias("event_id"))
    assert latest_status(df, "task", ["t", "event_id"]).collect()[0].event_id == 999


def test_retry_ladder_decisions(spark):
    messages = ["HTTP 429", "rate LIMIT", "Quota", "quota", "quota", "Not found"]
    df = spark.createDataFrame([("x", i, m) for i, m in enumerate(messages)] + [("y", 0, None)], "task STRING, t INT, error_message STRING")
    rows = retry_ladder(df, "task", ["t"]).orderBy("task", "t").collect()
    assert [(r.attempt, r.outcome, r.delay_s) for r in rows] == [
        (0, "RETRIED", 10), (1, "RETRIED", 60), (2, "RETRIED", 300), (3, "FAILED", None), (4, "FAILED", None),
        (5, "FAILED", None), (0, "FAILED", None),
    ]
