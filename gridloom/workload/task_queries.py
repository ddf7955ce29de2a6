"""Queries over catalogs, plans, task events, documents and dataset attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import attrs, names, paths, status
from gridloom.operators import filters, rules, sets, tasks
from gridloom.plans import chunks, external, steps
from gridloom.shared import fresh_path
from gridloom.sources import registry
from gridloom.streaming import monitor
from gridloom.workload.registered import Inputs, query
from gridloom.workload.source_queries import catalog_records, rounded

# --- plans and names -------------------------------------------------------------------------------------------

CHUNK_SQL = """
    assets AS (SELECT *, 0 AS part FROM {catalog} WHERE asset_1 IS NOT NULL AND family = 'raster'
        UNION ALL SELECT *, 1 FROM {catalog} WHERE asset_2 IS NOT NULL AND kind = 'collection_group'),
    parts AS (SELECT *, CASE WHEN kind = 'collection_group' AND asset_2 IS NOT NULL THEN 2 ELSE 1 END AS n_parts,
        coalesce(scale, 1000) AS metres FROM assets),
    yearly AS (SELECT *, CAST(unnest(generate_series(CAST(left(start_day, 4) AS INT),
        CAST(left(end_day, 4) AS INT))) AS INT) AS year FROM parts WHERE kind <> 'image'),
    chunks AS (SELECT * FROM yearly UNION ALL SELECT *, CAST(NULL AS INT) FROM parts WHERE kind = 'image'),
    named AS (SELECT *, 'OG_' || dataset_id || '_' || vars
            || CASE WHEN n_parts > 1 THEN '_part' || CAST(part + 1 AS VARCHAR) ELSE '' END || '_'
            || coalesce(CAST(year AS VARCHAR) || '-01-01', start_day) || '_'
            || coalesce(CAST(year AS VARCHAR) || '-12-31', end_day) || '_' || CAST(metres AS VARCHAR) || 'm' AS out_name,
        dataset_id || '_' || CAST(part AS VARCHAR) || '_' || coalesce(CAST(year AS VARCHAR), 'static') AS task_label
        FROM chunks)"""


def raster_chunks(inputs: Inputs) -> DataFrame:
    """Named chunks of the raster records, at the catalog's scale or the default."""
    rasters = catalog_records(inputs).where("family = 'raster'")
    return chunks.named_chunks(chunks.year_chunks(rasters))


@query("year_chunks", f"""WITH {CHUNK_SQL}
    SELECT dataset_id, CAST(part AS INT) AS part, year, CAST(make_date(year, 1, 1) AS VARCHAR) AS chunk_start,
           CAST(make_date(year + 1, 1, 1) AS VARCHAR) AS chunk_end, CASE WHEN part = 0 THEN asset_1 ELSE asset_2 END AS asset_id FROM chunks""")
def year_chunks(inputs: Inputs) -> DataFrame:
    days = [F.col(name).cast("string").alias(name) for name in ("chunk_start", "chunk_end")]
    return raster_chunks(inputs).select("dataset_id", "part", "year", *days, "asset_id")


@query("output_names", f"WITH {CHUNK_SQL} SELECT dataset_id, out_name FROM named")
def output_names(inputs: Inputs) -> DataFrame:
    return raster_chunks(inputs).select("dataset_id", "out_name")


@query("task_labels", f"WITH {CHUNK_SQL} SELECT dataset_id, task_label FROM named")
def task_labels(inputs: Inputs) -> DataFrame:
    return raster_chunks(inputs).select("dataset_id", "task_label")


@query("external_names", """
    SELECT dataset_id, 'OG_' || dataset_id || '_' || vars || '_2000-01-01_2024-09-30_1000m' AS out_name FROM {catalog}
    WHERE family = 'external' AND endpoint NOT LIKE 'REPLACE%' AND endpoint NOT LIKE 'REQUIRES%'""")
def external_names(inputs: Inputs) -> DataFrame:
    ready = external.configured(catalog_records(inputs))
    return external.named_external(ready, "2000-01-01", "2024-09-30").select("dataset_id", "out_name")


@query("external_ingest", """
    WITH landed AS (SELECT dataset_id, vars AS var, CAST(CAST(strlen(html) AS FLOAT) AS DOUBLE) AS value
        FROM {pages} JOIN {catalog} ON dataset_id = '02-' || CAST(page_id AS VARCHAR)
        WHERE family = 'external' AND endpoint NOT LIKE 'REPLACE%' AND endpoint NOT LIKE 'REQUIRES%')
    SELECT dataset_id, var, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean,
           round(stddev_pop(value), 4) AS std, count(value) AS n_valid FROM landed GROUP BY dataset_id, var""")
def external_ingest(inputs: Inputs) -> DataFrame:
    dataset = F.concat(F.lit("02-"), F.col("page_id").cast("string"))
    payloads = inputs.pages.select(dataset.alias("dataset_id"), F.octet_length("html").alias("length"))
    return rounded(external.ingest_payloads(payloads, catalog_records(inputs), fresh_path(inputs.spark, "ingest")))


@query("dry_run_plan", f"""WITH {CHUNK_SQL}
    SELECT dry_run, count(*) AS n_planned, CASE WHEN dry_run THEN 0 ELSE count(*) END AS n_submitted
    FROM chunks, (VALUES (TRUE), (FALSE)) AS runs(dry_run) GROUP BY dry_run""")
def dry_run_plan(inputs: Inputs) -> DataFrame:
    plan = raster_chunks(inputs)
    planned = plan.agg(F.count("*").alias("n_planned"))
    reports = [
        planned.select(
            F.lit(dry_run).alias("dry_run"),
            "n_planned",
            filters.dry_run_gate(plan, dry_run).agg(F.count("*")).scalar().alias("n_submitted"),
        )
        for dry_run in (True, False)
    ]
    return reports[0].unionByName(reports[1])


@query("scale_defaults", """
    SELECT c.dataset_id, CAST(coalesce(s.scale, c.scale, 1000) AS INT) AS scale
    FROM {catalog} c LEFT JOIN {scales} s ON c.dataset_id = s.dataset_id""")
def scale_defaults(inputs: Inputs) -> DataFrame:
    return chunks.with_scale(inputs.catalog, inputs.scales).select("dataset_id", "scale")


@query("subfolder", """
    SELECT dataset_id, CASE WHEN dataset_id LIKE '01%' THEN '01_gee_rasters/' ELSE '02_independent/' END || folder
        AS drive_subfolder FROM {catalog}""")
def subfolder(inputs: Inputs) -> DataFrame:
    return inputs.catalog.select(
        "dataset_id", names.subfolder(F.col("dataset_id"), F.col("folder")).alias("drive_subfolder")
    )


@query("band_metadata", """
    WITH bands AS (SELECT dataset_id, CAST(unnest(generate_series(1, n_bands)) AS INT) AS i FROM {catalog})
    SELECT dataset_id, i - 1 AS position, 'b' || CAST(i AS VARCHAR) AS band, 'b' || CAST(i AS VARCHAR) AS long_name,
           '1' AS units, 'unknown' AS standard_name FROM bands""")
def band_metadata(inputs: Inputs) -> DataFrame:
    return attrs.band_metadata(catalog_records(inputs))


@query("endpoint_gate", """
    SELECT dataset_id, endpoint FROM {catalog}
    WHERE starts_with(endpoint, 'REPLACE_') OR starts_with(endpoint, 'REQUIRES_')""")
def endpoint_gate(inputs: Inputs) -> DataFrame:
    return filters.endpoint_gate(inputs.catalog).select("dataset_id", "endpoint")


@query("run_report", """
    WITH counted AS (SELECT dataset_id, count(*) AS n FROM {queued} GROUP BY dataset_id)
    SELECT c.dataset_id, name, family, coalesce(n, 0) AS n_tasks,
           CASE WHEN family = 'raster' THEN CASE WHEN n > 0 THEN 'QUEUED' ELSE 'FAILED_OR_NOT_RUN' END
                WHEN n IS NULL OR endpoint IN ('REPLACE_WITH_URL', 'REQUIRES_ACCOUNT') THEN 'CONFIGURATION_REQUIRED'
                ELSE 'COMPLETED' END AS status
    FROM {catalog} c LEFT JOIN counted q ON c.dataset_id = q.dataset_id""")
def run_report(inputs: Inputs) -> DataFrame:
    return tasks.run_report(inputs.catalog, inputs.queued)


# --- registry --------------------------------------------------------------------------------------------------


@query("active_tasks", """
    SELECT event_id, task_id_or_file, status FROM {registry_rows}
    WHERE status IN ('STARTED', 'RUNNING') AND task_id_or_file IS NOT NULL""")
def active_tasks(inputs: Inputs) -> DataFrame:
    return filters.active_tasks(inputs.registry_rows).select("event_id", "task_id_or_file", "status")


@query("failed_messages", """
    SELECT error_message FROM {registry_rows} WHERE status = 'FAILED' AND error_message IS NOT NULL""")
def failed_messages(inputs: Inputs) -> DataFrame:
    return filters.failed_messages(inputs.registry_rows)


@query("status_counts", "SELECT status, count(*) AS n FROM {registry_rows} GROUP BY status")
def status_counts(inputs: Inputs) -> DataFrame:
    return tasks.status_counts(inputs.registry_rows)


@query("active_count", "SELECT count(*) AS n_active FROM {registry_rows} WHERE status IN ('STARTED', 'RUNNING')")
def active_count(inputs: Inputs) -> DataFrame:
    return tasks.active_count(inputs.registry_rows)


STATUS_SQL = "CASE state WHEN 'READY' THEN 'RUNNING' WHEN 'CANCELLED' THEN 'FAILED' ELSE state END"


@query("status_map", f"""
    SELECT event_id, state, {STATUS_SQL} AS status,
           CASE WHEN {STATUS_SQL} IN ('COMPLETED', 'FAILED') THEN timestamp_ END AS end_time FROM {{task_events}}""")
def status_map(inputs: Inputs) -> DataFrame:
    mapped = status.map_status(F.col("state"))
    ended = F.when(status.is_terminal(F.col("status")), F.col("timestamp_"))
    return inputs.task_events.select("event_id", "state", mapped.alias("status"), "timestamp_").select(
        "event_id", "state", "status", ended.alias("end_time")
    )


RETRYABLE_SQL = """(lower(error_message) LIKE '%429%' OR lower(error_message) LIKE '%rate limit%'
    OR lower(error_message) LIKE '%quota%')"""


@query("retryable_errors", f"""
    SELECT event_id, error_message, {RETRYABLE_SQL} AS retryable FROM {{task_events}} WHERE error_message IS NOT NULL""")
def retryable_errors(inputs: Inputs) -> DataFrame:
    failed = inputs.task_events.where("error_message IS NOT NULL")
    return failed.select("event_id", "error_message", status.is_retryable(F.col("error_message")).alias("retryable"))


LATEST_SQL = """
    SELECT event_id, timestamp_, task_id, dataset_id, state, error_message, n_bytes FROM
        (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY timestamp_ DESC, event_id DESC) AS r FROM {task_events})
    WHERE r = 1"""


@query("latest_status", LATEST_SQL)
def latest_status(inputs: Inputs) -> DataFrame:
    return tasks.latest_status(inputs.task_events, "task_id", ["timestamp_", "event_id"])


@query("retry_ladder", f"""
    WITH tries AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY timestamp_, event_id) - 1 AS attempt,
            {RETRYABLE_SQL} AS retryable FROM {{task_events}} WHERE state = 'FAILED')
    SELECT event_id, task_id, attempt, retryable,
           CASE WHEN retryable AND attempt < 3 THEN 'RETRIED' ELSE 'FAILED' END AS outcome,
           CAST(CASE WHEN retryable AND attempt < 3
                THEN CASE attempt WHEN 0 THEN 10 WHEN 1 THEN 60 ELSE 300 END END AS INT) AS delay_s FROM tries""")
def retry_ladder(inputs: Inputs) -> DataFrame:
    failures = inputs.task_events.where("state = 'FAILED'")
    ladder = tasks.retry_ladder(failures, "task_id", ["timestamp_", "event_id"])
    return ladder.select("event_id", "task_id", "attempt", "retryable", "outcome", "delay_s")


@query("poll_merge", f"""
    WITH polls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY timestamp_ DESC, event_id DESC)
            AS r FROM {{task_events}} ) WHERE r = 1),
        merged AS (SELECT g.*, g.status IN ('STARTED', 'RUNNING') AND p.task_id IS NOT NULL AS polled,
            {STATUS_SQL.replace("state", "coalesce(p.state, 'UNKNOWN')")} AS new_status, p.timestamp_ AS polled_at, p.error_message AS new_error
            FROM {{registry_rows}} g LEFT JOIN polls p ON g.task_id_or_file = p.task_id)
    SELECT event_id, task_id_or_file, CASE WHEN polled THEN new_status ELSE status END AS status,
           CASE WHEN NOT polled THEN end_time WHEN new_status IN ('COMPLETED', 'FAILED') THEN polled_at END AS end_time,
           CASE WHEN polled THEN new_error ELSE error_message END AS error_message FROM merged""")
def poll_merge(inputs: Inputs) -> DataFrame:
    events = inputs.task_events.withColumnsRenamed({"task_id": "task_id_or_file", "timestamp_": "polled_at"})
    merged = tasks.poll_merge(
        inputs.registry_rows,
        events,
        "task_id_or_file",
        ["polled_at", "event_id"],
    )
    return merged.select("event_id", "task_id_or_file", "status", "end_time", "error_message")


@query("admission_list", f"""
    WITH plan AS (SELECT DISTINCT 'T' || CAST(l_partkey AS VARCHAR) AS task_id FROM {{lineitem}}),
        latest AS ({LATEST_SQL}), active AS (SELECT count(*) AS n FROM latest WHERE state IN ('STARTED', 'RUNNING')),
        pending AS (SELECT task_id, row_number() OVER (ORDER BY task_id) AS slot FROM plan
            WHERE task_id NOT IN (SELECT task_id FROM latest))
    SELECT task_id, CAST(slot AS INT) AS slot FROM pending, active WHERE slot <= 500 - n""")
def admission_list(inputs: Inputs) -> DataFrame:
    plan = inputs.lineitem.select(F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("task_id")).distinct()
    states = inputs.task_events.select("task_id", "state", "timestamp_", "event_id")
    latest = tasks.latest_status(states, "task_id", ["timestamp_", "event_id"])
    return tasks.admission_list(plan, latest.withColumnRenamed("state", "status"), "task_id", cap=500)


# --- files, sets, rules ----------------------------------------------------------------------------------------


@query("missing_outputs", "SELECT partkey FROM {expected_files} EXCEPT SELECT partkey FROM {found_files}")
def missing_outputs(inputs: Inputs) -> DataFrame:
    return sets.missing_outputs(inputs.expected_files, inputs.found_files, "partkey")


@query("set_difference", """
    SELECT dataset_id, family FROM {catalog} EXCEPT SELECT dataset_id, CASE WHEN dataset_id LIKE '01%' THEN 'raster'
    ELSE 'external' END FROM {queued}""")
def set_difference(inputs: Inputs) -> DataFrame:
    family = F.when(F.col("dataset_id").startswith("01"), "raster").otherwise("external")
    present = inputs.queued.withColumn("family", family)
    return sets.set_difference(inputs.catalog.select("dataset_id", "family"), present)


@query("family_union", """
    SELECT file, size_bytes, 'stored' AS family FROM {stored_files}
    UNION ALL SELECT url, strlen(html), 'page' FROM {pages}""")
def family_union(inputs: Inputs) -> DataFrame:
    pages = inputs.pages.select(F.octet_length("html").cast("bigint").alias("size_bytes"), F.col("url").alias("file"))
    return sets.family_union({"stored": inputs.stored_files, "page": pages})


@query("ordered_listing", """
    SELECT dataset_id, family, name, row_number() OVER (ORDER BY family, name NULLS FIRST, dataset_id) AS ordinal
    FROM {catalog}""")
def ordered_listing(inputs: Inputs) -> DataFrame:
    files = inputs.catalog.select("dataset_id", "family", "name")
    return rules.ordered_listing(files, ["family", "name", "dataset_id"])


@query("url_suffix", r"""
    WITH paths AS (SELECT page_id, url, regexp_extract(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url,
            '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^[^?#]*'), ';[^/]*$', ''), '/+$', ''), '[^/]*$') AS name FROM {pages}),
        found AS (SELECT *, regexp_extract(name, '^\.*[^.].*(\.[^.]+)$', 1) AS s FROM paths)
    SELECT page_id, CASE WHEN s = '' THEN '.bin' ELSE s END AS suffix, left(name, length(name) - length(s)) AS stem FROM found""")
def url_suffix(inputs: Inputs) -> DataFrame:
    url = F.col("url")
    return inputs.pages.select(
        "page_id", paths.url_suffix(url).alias("suffix"), paths.stem(paths.url_path(url)).alias("stem")
    )


@query("catalog_checks", """
    SELECT dataset_id, 'dataset missing asset_id' AS error FROM {catalog} WHERE family = 'raster' AND asset_1 IS NULL
    UNION ALL SELECT dataset_id, 'independent dataset missing name' FROM {catalog}
    WHERE family = 'external' AND coalesce(name, '') = ''""")
def catalog_checks(inputs: Inputs) -> DataFrame:
    return rules.catalog_checks(catalog_records(inputs))


TOKEN_RULES = [
    rules.TokenRule("missing full stop", ".", True),
    rules.TokenRule("missing the", "the", True),
    rules.TokenRule("missing en", "en", True),
    rules.TokenRule("forbidden license", "icense", False),
    rules.TokenRule("forbidden address", "@", False),
    rules.TokenRule("forbidden link", "http", False),
]


def _token_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, '{rule.name}' AS rule FROM {{documents}} WHERE "
        f"{'NOT ' if rule.required else ''}contains(text, '{rule.token}')"
        for rule in TOKEN_RULES
    )


@query("token_rules", _token_sql())
def token_rules(inputs: Inputs) -> DataFrame:
    return rules.token_rules(inputs.documents, TOKEN_RULES)


@query("token_table_rules", """
    SELECT d.doc_id, t.rule FROM {documents} d JOIN {token_table} t ON contains(d.text, t.token) <> t.required""")
def token_table_rules(inputs: Inputs) -> DataFrame:
    return rules.token_table_rules(inputs.documents, inputs.token_table)


STRUCTURE_SQL = """
    shape AS (SELECT conv_id, count(*) AS n, min_by(role, turn) AS first_role,
        count(*) FILTER (WHERE NOT contains(text, '.')) AS bare FROM {conversations} GROUP BY conv_id),
    broken AS (SELECT conv_id, 'expected 6 items, got ' || CAST(n AS VARCHAR) AS error FROM shape WHERE n <> 6
        UNION ALL SELECT conv_id, 'first item is not user' FROM shape WHERE first_role <> 'user'
        UNION ALL SELECT conv_id, CAST(bare AS VARCHAR) || ' items lack the key' FROM shape WHERE bare > 0)"""


def _structure_errors(inputs: Inputs) -> DataFrame:
    has_key = F.col("text").contains(".")
    return rules.structure_rules(inputs.conversations, "conv_id", "turn", "role", has_key, "user", 6)


@query("structure_rules", f"WITH {STRUCTURE_SQL} SELECT conv_id, error FROM broken")
def structure_rules(inputs: Inputs) -> DataFrame:
    return _structure_errors(inputs)


@query("first_errors", f"""WITH {STRUCTURE_SQL}
    SELECT conv_id, error FROM broken ORDER BY conv_id, error LIMIT 20""")
def first_errors(inputs: Inputs) -> DataFrame:
    return rules.first_errors(_structure_errors(inputs), ["conv_id", "error"])


@query("validation_summary", f"""WITH {STRUCTURE_SQL},
    counted AS (SELECT (SELECT count(*) FROM {{expected_files}}) AS expected,
        (SELECT count(*) FROM {{expected_files}} WHERE partkey IN (SELECT partkey FROM {{found_files}})) AS validated,
        (SELECT count(*) FROM broken) AS structure, (SELECT count(*) FROM ({_token_sql()})) AS tokens)
    SELECT *, structure + tokens AS errors, expected = validated AND structure + tokens = 0 AS passed FROM counted""")
def validation_summary(inputs: Inputs) -> DataFrame:
    errors = {"structure": _structure_errors(inputs), "tokens": rules.token_rules(inputs.documents, TOKEN_RULES)}
    return rules.validation_summary(inputs.expected_files, inputs.found_files, errors, "partkey")


# Attribute keys in sorted order with the columns of the view that hold them.
ATTR_COLUMNS = {
    "Conventions": "conventions",
    "comment": "comment_",
    "history": "history",
    "institution": "institution",
    "references": "references_",
    "source": "source",
    "title": "title",
}
MISSING_SQL = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {column} IS NULL THEN '{key}' END" for key, column in ATTR_COLUMNS.items()
) + ")"
CONTRACT_SQL = f"""
    contract AS (SELECT path, path || ': missing CF attrs [' || {MISSING_SQL} || ']' AS failure FROM {{attrs}}
        WHERE conventions IS DISTINCT FROM 'CF-1.8' OR {MISSING_SQL} <> '')"""


def dataset_attrs(inputs: Inputs) -> DataFrame:
    """Attribute maps of the view's datasets, absent keys left out."""
    pairs = [F.struct(F.lit(key).alias("key"), F.col(column).alias("value")) for key, column in ATTR_COLUMNS.items()]
    given = F.filter(F.array(*pairs), lambda pair: pair["value"].isNotNull())
    return inputs.attrs.select("path", F.map_from_entries(given).alias("attrs"))


@query("missing_attrs", f"SELECT path, {MISSING_SQL} AS missing FROM {{attrs}}")
def missing_attrs(inputs: Inputs) -> DataFrame:
    return dataset_attrs(inputs).select("path", F.array_join(sets.missing_attrs(F.col("attrs")), ", ").alias("missing"))


@query("attr_contract", f"WITH {CONTRACT_SQL} SELECT path, failure FROM contract")
def attr_contract(inputs: Inputs) -> DataFrame:
    return rules.attr_contract(dataset_attrs(inputs))


@query("failure_rollup", f"""WITH {CONTRACT_SQL},
    both_ AS (SELECT 'metadata' AS source, failure AS message FROM contract UNION ALL
        SELECT 'registry', error_message FROM {{registry_rows}} WHERE status = 'FAILED' AND error_message IS NOT NULL)
    SELECT source, message, count(*) AS n FROM both_ GROUP BY source, message""")
def failure_rollup(inputs: Inputs) -> DataFrame:
    return rules.failure_rollup(rules.attr_contract(dataset_attrs(inputs)), filters.failed_messages(inputs.registry_rows))


@query("run_passed", f"""WITH {CONTRACT_SQL},
    failures AS (SELECT (SELECT count(*) FROM contract) + (SELECT count(*) FROM {{registry_rows}}
        WHERE status = 'FAILED' AND error_message IS NOT NULL) AS n)
    SELECT n AS n_failures, n = 0 AS passed FROM failures""")
def run_passed(inputs: Inputs) -> DataFrame:
    return rules.run_passed(failure_rollup(inputs))


def _default_rows(kept: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT path, '{key}' AS key, {value} AS value FROM {{attrs}}" for key, value in kept.items())


@query("attr_defaults", _default_rows({
    "Conventions": "'CF-1.8'",
    "title": "coalesce(title, 'gridded dataset')",
    "institution": "coalesce(institution, 'unspecified')",
    "source": "coalesce(source, 'unspecified')",
    "gee_asset_id": "''",
    "references": "coalesce(references_, 'unspecified')",
    "comment": "coalesce(comment_, 'Values on the common Albers grid; every source band is kept.')",
    "featureType": "'grid'",
    "history": "'2024-01-01T00:00:00+00:00 notebook=unknown revision=unknown'",
}) + " UNION ALL " + _default_rows({
    "v.long_name": "coalesce(title, 'value')",
    "v.units": "coalesce(source, '1')",
    "v._FillValue": "'-9999.0'",
    "v.grid_mapping": "'crs'",
    "v.coordinates": "'lat lon'",
}))
def attr_defaults(inputs: Inputs) -> DataFrame:
    given = F.map_filter("attrs", lambda key, _: key != "Conventions")
    written = F.lit("2024-01-01T00:00:00+00:00")
    datasets = dataset_attrs(inputs).select("path", F.explode(attrs.global_attrs(given, written)).alias("key", "value"))

    def own(key: str, column: str) -> Column:
        return F.struct(F.lit(key).alias("key"), F.col(column).alias("value"))

    chosen = F.filter(F.array(own("long_name", "title"), own("units", "source")), lambda pair: pair["value"].isNotNull())
    merged = attrs.variable_attrs(F.lit("value"), F.map_from_entries(chosen))
    variables = inputs.attrs.select("path", F.explode(merged).alias("key", "value"))
    return datasets.unionByName(variables.withColumn("key", F.concat(F.lit("v."), F.col("key"))))


# --- streaming and steps ---------------------------------------------------------------------------------------


def _event_stream(inputs: Inputs) -> DataFrame:
    """Task events as files of a folder, taken in about three polls."""
    files = inputs.spark.sparkContext.defaultParallelism
    path = fresh_path(inputs.spark, "events")
    inputs.task_events.repartitionByRange(files, "event_id").write.parquet(path)
    return monitor.event_stream(inputs.spark, path, files_per_poll=-(-files // 3))


@query("stream_status_counts", "SELECT state AS status, count(*) AS n FROM {task_events} GROUP BY state")
def stream_status_counts(inputs: Inputs) -> DataFrame:
    return monitor.last_counts(monitor.stream_status_counts(_event_stream(inputs), "state"))


@query("stream_latest_state", LATEST_SQL)
def stream_latest_state(inputs: Inputs) -> DataFrame:
    return monitor.stream_latest_state(_event_stream(inputs), "task_id", ["timestamp_", "event_id"], status="state")


@query("stream_drain", f"""
    SELECT count(*) AS n_tasks, count(*) FILTER (WHERE state IN ('STARTED', 'RUNNING')) AS n_active,
           count(*) FILTER (WHERE state IN ('STARTED', 'RUNNING')) = 0 AS finished FROM ({LATEST_SQL})""")
def stream_drain(inputs: Inputs) -> DataFrame:
    latest = monitor.stream_latest_state(_event_stream(inputs), "task_id", ["timestamp_", "event_id"], status="state")
    return monitor.drain_report(latest, "state")


@query("audited_step", """
    SELECT 'count_states' AS task_id_or_file, 'COMPLETED' AS status, count(DISTINCT state) AS n_rows FROM {task_events}
    UNION ALL SELECT 'broken_step', 'FAILED', 0""")
def audited_step(inputs: Inputs) -> DataFrame:
    path = fresh_path(inputs.spark, "audit")

    def count_states() -> DataFrame:
        return tasks.status_counts(inputs.task_events, "state")

    def broken_step() -> DataFrame:
        return inputs.task_events.select(F.raise_error(F.col("state")).cast("string").alias("status"), F.lit(1).alias("n"))

    audited = [
        steps.audited_step(inputs.spark, step, path, "01a", "states", "status STRING, n BIGINT")
        for step in (count_states, broken_step)
    ]
    sizes = [
        result.agg(F.count("*").alias("n_rows")).withColumn("task_id_or_file", F.lit(step.__name__))
        for result, step in zip(audited, (count_states, broken_step))
    ]
    events = registry.registry(inputs.spark, path).select("task_id_or_file", "status")
    return events.join(sizes[0].unionByName(sizes[1]), "task_id_or_file")
