"""Rule checks, attribute contracts and set operations on small cases."""

from pyspark.sql import functions as F

from gridloom.functions.attrs import coordinate_attrs, global_attrs, variable_attrs
from gridloom.functions.status import is_active, is_retryable, map_status
from gridloom.functions.values import from_fill, palette_colour, quicklook_byte, to_fill
from gridloom.operators import filters, quality, rules, sets
from gridloom.plans import validation


def test_token_rules(spark):
    docs = spark.createDataFrame([(1, "a needle"), (2, "bad needle"), (3, "")], "doc_id INT, text STRING")
    checks = [rules.TokenRule("no needle", "needle", True), rules.TokenRule("bad", "bad", False)]
    found = {(r.doc_id, r.rule) for r in rules.token_rules(docs, checks).collect()}
    assert found == {(2, "bad"), (3, "no needle")}


def test_token_at_the_end_of_a_long_text(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("x"), 3_000_000), F.lit("needle")).alias("text"))
    assert rules.token_rules(docs, [rules.TokenRule("has", "needle", False)]).count() == 1


def test_structure_rules(spark):
    items = [(1, i, "markdown" if i == 0 else "code", True) for i in range(12)]
    items += [(2, i, "code", i != 5) for i in range(11)]
    df = spark.createDataFrame(items, "doc INT, pos INT, kind STRING, has BOOLEAN")
    found = {(r.doc, r.error) for r in rules.structure_rules(df, "doc", "pos", "kind", F.col("has"), "markdown").collect()}
    assert found == {(2, "expected 12 items, got 11"), (2, "first item is not markdown"), (2, "1 items lack the key")}


def test_attr_contract(spark):
    full = {k: "x" for k in ("title", "history", "institution", "source", "references", "comment")}
    rows = [
        ("good", {"Conventions": "CF-1.8", **full}),
        ("old", {"Conventions": "CF-1.6", **full}),
        ("bare", {"Conventions": "CF-1.8"}),
        ("none", {}),
    ]
    df = spark.createDataFrame(rows, "path STRING, attrs MAP<STRING,STRING>")
    got = {r.path: r.failure for r in rules.attr_contract(df).collect()}
    assert set(got) == {"old", "bare", "none"}
    assert got["old"] == "old: missing CF attrs []"
    assert got["bare"] == "bare: missing CF attrs [comment, history, institution, references, source, title]"
    assert got["none"].startswith("none: missing CF attrs [Conventions, comment")


def test_attribute_defaults(spark):
    given = F.create_map(F.lit("title"), F.lit("T"), F.lit("notebook_id"), F.lit("01a"), F.lit("Conventions"), F.lit("mine"))
    merged = spark.range(1).select(global_attrs(given, F.lit("now")).alias("a")).first().a
    assert merged["title"] == "T" and merged["Conventions"] == "CF-1.8" and merged["featureType"] == "grid"
    assert merged["history"] == "now notebook=01a revision=unknown"
    assert len(merged) == 9
    own = F.create_map(F.lit("units"), F.lit("mm"), F.lit("extra"), F.lit("e"))
    variable = spark.range(1).select(variable_attrs(F.lit("rain"), own).alias("a")).first().a
    assert variable == {
        "long_name": "rain", "units": "mm", "_FillValue": "-9999.0", "grid_mapping": "crs", "coordinates": "lat lon", "extra": "e",
    }


def test_validation_summary(spark):
    expected = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k INT")
    found = spark.createDataFrame([(1,), (2,), (3,), (9,)], "k INT")
    none = spark.createDataFrame([], "e STRING")
    row = rules.validation_summary(expected, found, {"a": none, "b": none}, "k").first()
    assert (row.expected, row.validated, row.errors, row.passed) == (3, 3, 0, True)
    some = spark.createDataFrame([("x",)], "e STRING")
    assert rules.validation_summary(expected, found, {"a": none, "b": some}, "k").first().passed is False
    assert rules.validation_summary(expected, found.where("k <> 3"), {"a": none}, "k").first().passed is False


def test_failures_and_pass(spark):
    metadata = spark.createDataFrame([("p", "m1"), ("q", "m1")], "path STRING, failure STRING")
    reg = spark.createDataFrame([("FAILED", "r1"), ("FAILED", None), ("COMPLETED", "r2")], "status STRING, error_message STRING")
    rollup = rules.failure_rollup(metadata, filters.failed_messages(reg))
    assert {tuple(r) for r in rollup.collect()} == {("metadata", "m1", 2), ("registry", "r1", 1)}
    assert tuple(rules.run_passed(rollup).first()) == (3, False)
    assert tuple(rules.run_passed(rollup.where("n > 5")).first()) == (0, True)


def test_validate_run(spark, tmp_path):
    datasets = spark.createDataFrame([("a.nc", {"Conventions": "CF-1.6"})], "path STRING, attrs MAP<STRING,STRING>")
    files = spark.createDataFrame([("a.nc", 10)], "path STRING, length BIGINT")
    reg = spark.createDataFrame([("FAILED", "m"), ("FAILED", "m"), ("COMPLETED", None)], "status STRING, error_message STRING")
    result = validation.validate(files, datasets, reg, str(tmp_path / "index"), "run")
    assert tuple(result.verdict.first()) == (3, False)
    assert {tuple(r) for r in result.statuses.collect()} == {("FAILED", 2), ("COMPLETED", 1)}
    lines = [r.value for r in spark.read.text(str(tmp_path / "index")).collect()]
    assert "- Failures: 3" in lines and "- `a.nc` (10 bytes)" in lines


def test_ordered_listing(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "z"), ("a", "y"), ("b", None)], "family STRING, name STRING")
    got = sorted((r.ordinal, r.family, r.name) for r in rules.ordered_listing(df, ["family", "name"]).collect())
    assert got == [(1, "a", "y"), (2, "a", "z"), (3, "b", None), (4, "b", "x")]


def test_sets(spark):
    expected = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k INT, v STRING")
    found = spark.createDataFrame([(1, "z"), (1, "z")], "k INT, v STRING")
    assert [r.k for r in sets.missing_outputs(expected, found, "k").collect()] == [2]
    assert {tuple(r) for r in sets.set_difference(expected, found).collect()} == {(1, "a"), (2, "b")}
    union = sets.family_union({"p": expected, "q": found.select("v", "k")})
    assert {tuple(r) for r in union.distinct().collect()} == {(1, "a", "p"), (2, "b", "p"), (1, "z", "q")}


def test_states_and_errors(spark):
    df = spark.createDataFrame([("READY",), ("CANCELLED",), ("COMPLETED",), ("CANCEL_REQUESTED",), (None,)], "s STRING")
    assert [r[0] for r in df.select(map_status(F.col("s"))).collect()] == ["RUNNING", "FAILED", "COMPLETED", "CANCEL_REQUESTED", None]
    assert [r[0] for r in df.select(is_active(map_status(F.col("s")))).collect()] == [True, False, False, False, False]
    texts = spark.createDataFrame([("Error 429",), ("RATE LIMIT",), ("Quota",), ("ratelimit",), (None,)], "m STRING")
    assert [r[0] for r in texts.select(is_retryable(F.col("m"))).collect()] == [True, True, True, False, False]


def test_fill_and_stretch(spark):
    df = spark.createDataFrame([(1.5,), (None,), (float("nan"),), (-9999.0,)], "v DOUBLE")
    filled = df.select(to_fill(F.col("v")).alias("f"))
    assert [r.f for r in filled.collect()] == [1.5, -9999.0, -9999.0, -9999.0]
    assert [r[0] for r in filled.select(from_fill(F.col("f"))).collect()] == [1.5, None, None, None]
    values = spark.createDataFrame([(-99.0,), (-25.0,), (-16.7,), (0.0,), (24.0,), (99.0,), (None,)], "v DOUBLE")
    colours = [r[0] for r in values.select(palette_colour(F.col("v"))).collect()]
    assert colours == ["001137", "001137", "001137", "e7eb05", "620500", "620500", None]
    grey = [r[0] for r in values.select(quicklook_byte(F.col("v"), F.lit(-25.0), F.lit(25.0))).collect()]
    assert grey == [0, 0, 42, 127, 249, 255, None]


def test_quicklook_of_a_constant_image(spark):
    rows = [("a", 0.0, 5.0), ("a", 1.0, 5.0), ("b", 0.0, 1.0), ("b", 1.0, 3.0), ("b", 2.0, None)]
    grid = spark.createDataFrame(rows, "var STRING, y DOUBLE, value DOUBLE").withColumn("x", F.lit(0.0))
    assert {(r.var, r.y, r.grey) for r in quality.quicklook(grid).collect()} == {
        ("a", 0.0, 0), ("a", 1.0, 0), ("b", 0.0, 0), ("b", 1.0, 255), ("b", 2.0, None),
    }


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v DOUBLE")
    assert [r.v for r in filters.finite(df, "v").collect()] == [1.0]


def test_date_filter_is_half_open(spark):
    df = spark.createDataFrame([("2024-09-29 23:59:59",), ("2024-09-30 00:00:00",), ("2002-04-01 00:00:00",)], "t STRING")
    for kind in ("timestamp", "timestamp_ntz", "date"):
        kept = filters.filter_date(df.select(F.col("t").cast(kind).alias("ts")), "2002-04-01", "2024-09-30")
        assert kept.count() == 2


def test_time_axis_names_its_calendar(spark):
    datasets = spark.createDataFrame([("a",), ("b",)], "dataset_id STRING")
    rows = coordinate_attrs(datasets).where("var = 'time'").collect()
    assert sorted(r.dataset_id for r in rows) == ["a", "b"]
    assert all((r.attrs["long_name"], r.attrs["calendar"]) == ("time", "proleptic_gregorian") for r in rows)


def test_a_table_of_many_rules_is_one_pass(spark):
    words = [f"w{k}" for k in range(5000)]
    listed = [(f"r{k}", w, k % 50 == 0) for k, w in enumerate(words)] + [("empty", "", True), ("not empty", "", False), ("none", None, True), ("same", "w7", False), ("é", "日本", False)]
    table = spark.createDataFrame(listed, "rule string, token string, required boolean")
    texts = [(1, " ".join(words)), (2, ""), (3, None), (4, "w12 日本 w4999"), (5, "w1" * 3)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    want = {
        (doc, rule) for doc, text in texts for rule, token, required in listed
        if token is not None and (text is not None and token in text) != required
    }
    for at_once in (100_000, 1200):
        got = [(r.doc_id, r.rule) for r in rules.token_table_rules(docs, table, at_once=at_once).collect()]
        assert set(got) == want and len(got) == len(want)
    assert rules.token_table_rules(docs, table.limit(0)).count() == 0
