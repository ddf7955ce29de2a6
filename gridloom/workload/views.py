"""Views that present the given tables as pixels, scenes, polygons, catalog records and task events.

Each view is plain SQL that Spark and the checking engine both run; ``{lineitem}`` and the like stand for the
given tables, ``{px_obs}`` and the like for other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Corner offsets in degrees of the supplier polygons: outer ring and hole. None falls on a cell centre.
RINGS = (
    ((-1.031, -0.911), (0.973, -1.073), (1.211, 0.533), (0.113, 1.331), (-1.171, 0.613)),
    ((-0.331, -0.411), (0.313, -0.373), (0.353, 0.433), (-0.293, 0.391)),
)


def _corner_sql() -> str:
    rows = ", ".join(
        f"({ring}, {pos}, {dx}, {dy}, {len(corners)})"
        for ring, corners in enumerate(RINGS)
        for pos, (dx, dy) in enumerate(corners)
    )
    return f"""
        SELECT CAST(ring AS INT) AS ring, pos, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, n
        FROM (VALUES {rows}) AS corners(ring, pos, dx, dy, n)"""


VIEWS: dict[str, str] = {
    "px_obs": """
        SELECT l_partkey % 50 AS col,
               CAST(floor(l_partkey / 50) AS BIGINT) % 50 AS row,
               CAST(-105.9 AS DOUBLE) + (l_partkey % 50) * CAST(0.2 AS DOUBLE) AS lon,
               CAST(31.8 AS DOUBLE) + (CAST(floor(l_partkey / 50) AS BIGINT) % 50) * CAST(0.24 AS DOUBLE) AS lat,
               CASE l_suppkey % 4 WHEN 0 THEN '01a' WHEN 1 THEN '01b' WHEN 2 THEN '01e' ELSE '01g' END AS dataset_id,
               CASE WHEN l_suppkey % 4 = 1 THEN l_orderkey % 2 ELSE 0 END AS part,
               l_orderkey AS scene_id, l_shipdate AS ts,
               CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL ELSE l_quantity END AS band_a,
               round(l_extendedprice * 100) AS band_b, l_linenumber AS qa
        FROM {lineitem}""",
    "px_two": """
        SELECT CASE WHEN wide THEN l_partkey % 40 ELSE l_partkey % 50 END AS col,
               CASE WHEN wide THEN CAST(floor(l_partkey / 40) AS BIGINT) % 40 ELSE CAST(floor(l_partkey / 50) AS BIGINT) % 50 END AS row,
               CASE WHEN wide THEN CAST(-105.87 AS DOUBLE) + (l_partkey % 40) * CAST(0.25 AS DOUBLE)
                    ELSE CAST(-105.9 AS DOUBLE) + (l_partkey % 50) * CAST(0.2 AS DOUBLE) END AS lon,
               CASE WHEN wide THEN CAST(31.83 AS DOUBLE) + (CAST(floor(l_partkey / 40) AS BIGINT) % 40) * CAST(0.3 AS DOUBLE)
                    ELSE CAST(31.8 AS DOUBLE) + (CAST(floor(l_partkey / 50) AS BIGINT) % 50) * CAST(0.24 AS DOUBLE) END AS lat,
               CASE l_suppkey % 4 WHEN 0 THEN '01a' WHEN 1 THEN '01b' WHEN 2 THEN '01e' ELSE '01g' END AS dataset_id,
               CASE WHEN l_suppkey % 4 = 1 THEN l_orderkey % 2 ELSE 0 END AS part,
               l_orderkey AS scene_id, l_shipdate AS ts, l_quantity AS band_a, round(l_extendedprice * 100) AS band_b
        FROM (SELECT *, l_suppkey % 4 >= 2 AS wide FROM {lineitem}) AS l""",
    "grids": """
        SELECT dataset_id, crs, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy
        FROM (VALUES ('01a', 'EPSG:4326', -106, 31.68, 0.2, 0.24), ('01b', 'EPSG:4326', -106, 31.68, 0.2, 0.24),
                     ('01e', 'EPSG:4326', -105.995, 31.68, 0.25, 0.3), ('01g', 'EPSG:4326', -105.995, 31.68, 0.25, 0.3)
             ) AS g(dataset_id, crs, x0, y0, dx, dy)""",
    "grid_scales": """
        SELECT dataset_id, CAST(scale AS INT) AS scale
        FROM (VALUES ('01a', 20000), ('01e', 20000), ('01x', 10)) AS s(dataset_id, scale)""",
    "token_table": """
        SELECT 'r' || CAST(item_id AS VARCHAR(20)) AS rule,
               substr(text, CAST(1 + item_id % 20 AS INT), CAST(3 + item_id % 4 AS INT)) AS token, item_id % 3 = 0 AS required
        FROM {benchmark}""",
    "px_raw": """
        SELECT l_partkey % 50 AS col, l_orderkey AS scene_id,
               CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE)
                    WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN CAST('Infinity' AS DOUBLE)
                    WHEN l_linenumber = 6 AND l_returnflag = 'N' THEN CAST('-Infinity' AS DOUBLE)
                    WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS value,
               CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE)
                    WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS masked
        FROM {lineitem}""",
    "scenes": """
        SELECT o_orderkey AS scene_id, o_orderdate AS acquired,
               CAST(-112.05 AS DOUBLE) + (o_custkey % 200) * CAST(0.1 AS DOUBLE) AS west,
               CAST(-110.55 AS DOUBLE) + (o_custkey % 200) * CAST(0.1 AS DOUBLE) AS east,
               CAST(27.05 AS DOUBLE) + (o_custkey % 180) * CAST(0.1 AS DOUBLE) AS south,
               CAST(28.55 AS DOUBLE) + (o_custkey % 180) * CAST(0.1 AS DOUBLE) AS north
        FROM {orders}""",
    "aoi": """
        SELECT CAST(fid AS BIGINT) AS fid, CAST(ring AS INT) AS ring, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
               CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2
        FROM (VALUES (0, 0, -105, 33, -97, 32.5), (0, 0, -97, 32.5, -96.5, 42), (0, 0, -96.5, 42, -100, 43.5),
                     (0, 0, -100, 43.5, -104.5, 41), (0, 0, -104.5, 41, -105, 33),
                     (0, 1, -102.03, 36.01, -99.51, 36.02), (0, 1, -99.51, 36.02, -99.53, 38.51),
                     (0, 1, -99.53, 38.51, -102.01, 38.53), (0, 1, -102.01, 38.53, -102.03, 36.01)
             ) AS sides(fid, ring, x1, y1, x2, y2)""",
    "centres": """
        SELECT s_suppkey, n_name, s_suppkey % 3 = 0 AS has_hole,
               CAST(-105.47 AS DOUBLE) + (s_suppkey * 7 % 90) * CAST(0.1 AS DOUBLE) AS cx,
               CAST(32.53 AS DOUBLE) + (s_suppkey * 13 % 100) * CAST(0.1 AS DOUBLE) AS cy
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "corners": _corner_sql(),
    "supplier_sides": """
        SELECT a.fid, a.ring, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.n_name
        FROM {supplier_points} a JOIN {supplier_points} b
          ON a.fid = b.fid AND a.ring = b.ring AND b.pos = (a.pos + 1) % a.n""",
    "supplier_points": """
        SELECT s_suppkey AS fid, n_name, ring, pos, n, cx + dx AS x, cy + dy AS y
        FROM {centres} JOIN {corners} ON ring = 0 OR has_hole""",
    "task_events": """
        SELECT event_id, ts AS timestamp_, concat('T', CAST(user_id AS VARCHAR(20))) AS task_id,
               CASE user_id % 4 WHEN 0 THEN '01a' WHEN 1 THEN '01b' WHEN 2 THEN '01e' ELSE '01g' END AS dataset_id,
               CASE WHEN event_type = 'click' THEN 'READY' WHEN event_type = 'view' THEN 'RUNNING'
                    WHEN event_type = 'purchase' THEN 'COMPLETED' WHEN event_type = 'error' THEN 'FAILED'
                    WHEN event_id % 5 = 0 THEN 'CANCEL_REQUESTED' ELSE 'CANCELLED' END AS state,
               CASE WHEN event_type <> 'error' THEN NULL
                    WHEN event_id % 4 = 0 THEN 'HTTP 429: Too Many Requests'
                    WHEN event_id % 4 = 1 THEN 'Rate limit exceeded'
                    WHEN event_id % 4 = 2 THEN 'User QUOTA reached' ELSE 'Image asset not found' END AS error_message,
               CAST(floor(value * 100) AS BIGINT) AS n_bytes
        FROM {events}""",
    "registry_rows": """
        SELECT event_id, timestamp_ AS "timestamp", dataset_id AS notebook_id, dataset_id AS dataset,
               CASE WHEN event_id % 50 = 0 THEN NULL ELSE task_id END AS task_id_or_file, 'batch' AS pathway,
               CASE state WHEN 'READY' THEN 'STARTED' WHEN 'CANCELLED' THEN 'FAILED' ELSE state END AS status,
               timestamp_ AS start_time,
               CASE WHEN state IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN timestamp_ END AS end_time,
               n_bytes, error_message, CAST(event_id % 4 AS INT) AS retries
        FROM {task_events}""",
    "catalog": """
        SELECT (CASE WHEN p_partkey % 14 < 9 THEN '01-' ELSE '02-' END) || CAST(p_partkey AS VARCHAR(20)) AS dataset_id,
               CASE WHEN p_partkey % 14 < 9 THEN 'raster' ELSE 'external' END AS family,
               CASE WHEN p_partkey % 89 = 88 THEN NULL ELSE p_name END AS name,
               CASE WHEN p_partkey % 14 < 9 AND p_partkey % 97 <> 96
                    THEN 'PUB/' || p_type || '/' || CAST(p_partkey AS VARCHAR(20)) END AS asset_1,
               CASE WHEN p_partkey % 14 < 9 AND p_partkey % 97 <> 96 AND p_partkey % 6 < 3
                    THEN 'PUB/' || p_brand || '/' || CAST(p_partkey AS VARCHAR(20)) END AS asset_2,
               p_type AS vars, CAST(1 + p_size % 6 AS INT) AS n_bands,
               CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 30 ELSE 1000 END AS INT) AS scale,
               CASE WHEN p_partkey % 14 >= 9 THEN NULL WHEN p_partkey % 6 = 0 THEN 'image'
                    WHEN p_partkey % 6 < 3 THEN 'collection_group' ELSE 'collection' END AS kind,
               CAST(1979 + p_size % 40 AS VARCHAR(4)) || '-04-01' AS start_day,
               CAST(1979 + p_size % 40 + p_partkey % 9 AS VARCHAR(4)) || '-09-30' AS end_day,
               lower(p_type) || '_' || CAST(p_partkey AS VARCHAR(20)) AS folder,
               CASE WHEN p_partkey % 14 < 9 THEN NULL WHEN p_partkey % 4 = 0 THEN 'REPLACE_WITH_URL'
                    WHEN p_partkey % 4 = 1 THEN 'REQUIRES_ACCOUNT'
                    ELSE 'https://data.example.org/v1/' || CAST(p_partkey AS VARCHAR(20)) || '.nc' END AS endpoint
        FROM {part}""",
    "scales": """
        SELECT (CASE WHEN p_partkey % 14 < 9 THEN '01-' ELSE '02-' END) || CAST(p_partkey AS VARCHAR(20)) AS dataset_id,
               CAST(CASE p_partkey % 6 WHEN 0 THEN 30 WHEN 3 THEN 250 END AS INT) AS scale
        FROM {part}""",
    "queued": """
        SELECT (CASE WHEN l_partkey % 14 < 9 THEN '01-' ELSE '02-' END) || CAST(l_partkey AS VARCHAR(20)) AS dataset_id
        FROM {lineitem} WHERE l_quantity > 49""",
    "attrs": """
        SELECT 'cf/' || s_name || '.nc' AS path,
               CASE WHEN s_suppkey % 29 = 0 THEN 'CF-1.6' WHEN s_suppkey % 5 <> 0 THEN 'CF-1.8' END AS conventions,
               CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS title,
               CASE WHEN s_suppkey % 11 <> 0 THEN 'h' END AS history,
               CASE WHEN s_suppkey % 13 <> 0 THEN 'i' END AS institution,
               CASE WHEN s_suppkey % 17 <> 0 THEN 's' END AS source,
               CASE WHEN s_suppkey % 19 <> 0 THEN 'r' END AS references_,
               CASE WHEN s_suppkey % 23 <> 0 THEN 'c' END AS comment_
        FROM {supplier}""",
    "expected_files": "SELECT p_partkey AS partkey FROM {part}",
    "found_files": "SELECT DISTINCT l_partkey AS partkey FROM {lineitem} WHERE l_quantity > 49",
    "notebook_files": """
        SELECT 'nb' || CAST(p_partkey % 5 AS VARCHAR(2)) AS notebook_id, 'COMPLETED' AS status,
               'cf/' || CAST(p_partkey AS VARCHAR(20)) || '.nc' AS file, p_name AS dataset
        FROM {part}""",
    "stored_files": """
        SELECT 'cf/' || CAST(l_partkey AS VARCHAR(20)) || '.nc' AS file, count(*) * 1000 AS size_bytes
        FROM {lineitem} WHERE l_quantity > 49 GROUP BY l_partkey""",
}

_NAME = re.compile(r"\{(\w+)\}")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace('"timestamp"', "`timestamp`")
    inputs = {used: spark_view(spark, sf_dir, used) for used in set(_NAME.findall(sql))}
    return spark.sql(sql, **inputs)


def _needed(sql: str) -> list[str]:
    """Views a statement uses, each after those it builds on."""
    order: list[str] = []
    for name in _NAME.findall(sql):
        if name in VIEWS:
            for needed in [*_needed(VIEWS[name]), name]:
                if needed not in order:
                    order.append(needed)
    return order


def portable_sql(body: str) -> str:
    """Statement with its views as common table expressions."""
    bare = lambda sql: _NAME.sub(r"\1", sql)
    parts = [f"{name} AS ({bare(VIEWS[name])})" for name in _needed(body)]
    text = bare(body).strip()
    if not parts:
        return text
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:]
    return "WITH " + ",\n".join(parts) + "\n" + text
