"""Column layouts of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

PIXEL_KEYS = ("dataset_id", "part", "scene_id", "ts", "row", "col", "lon", "lat")
CELL = ("row", "col")
CHUNK = ("dataset_id", "part", "year")

# The task registry's columns, in file order.
REGISTRY_COLUMNS = (
    "timestamp",
    "notebook_id",
    "dataset",
    "task_id_or_file",
    "pathway",
    "status",
    "start_time",
    "end_time",
    "n_bytes",
    "error_message",
    "retries",
)
REGISTRY_TIMES = ("timestamp", "start_time", "end_time")
REGISTRY_TEXT = T.StructType([T.StructField(name, T.StringType()) for name in REGISTRY_COLUMNS])

# Field names of the catalog and of GeoJSON.
CATALOG_RECORD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("asset_id", T.StringType()),
        T.StructField("vars", T.StringType()),
        T.StructField("bands", T.ArrayType(T.StringType())),
        T.StructField("scale", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("usage", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("endpoint", T.StringType()),
    ]
)
CATALOG_DOCUMENT = T.StructType(
    [
        T.StructField("datasets", T.MapType(T.StringType(), CATALOG_RECORD)),
        T.StructField("independent_datasets", T.MapType(T.StringType(), CATALOG_RECORD)),
        T.StructField("MASTER_SCALE", T.MapType(T.StringType(), T.IntegerType())),
    ]
)

FEATURE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "geometry",
            T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]),
        ),
    ]
)
FEATURE_COLLECTION = T.StructType([T.StructField("features", T.ArrayType(FEATURE))])

EDGES = "fid BIGINT, ring INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
