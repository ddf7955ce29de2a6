"""Checks of catalogs, documents and dataset attributes, and their roll-ups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.attrs import CONVENTIONS, REQUIRED_ATTRS
from gridloom.operators.sets import missing_attrs
from gridloom.operators.skew import row_number_by
from gridloom.shared import materialise

# Expected items per document, reported errors, and the texts of the checks.
EXPECTED_ITEMS = 12
REPORTED_ERRORS = 20
NO_ASSET = "dataset missing asset_id"
NO_NAME = "independent dataset missing name"
WRONG_COUNT = "expected {} items, got %d"
MISSING_ATTRS = ": missing CF attrs ["


@dataclass(frozen=True)
class TokenRule:
    """A token every document must hold, or must not."""

    name: str
    token: str
    required: bool


def _violations(checks: list[tuple[Column, Column]]) -> Column:
    """Texts of the failed checks, as an array; each check is (failed, text)."""
    return F.filter(F.array(*[F.when(failed, text) for failed, text in checks]), lambda text: text.isNotNull())


def catalog_checks(catalog: DataFrame) -> DataFrame:
    """Raster records without an asset and external records without a name."""
    raster, external = F.col("family") == "raster", F.col("family") == "external"
    checks = [
        (raster & (F.size("assets") == 0), F.lit(NO_ASSET)),
        (external & (F.coalesce(F.col("name"), F.lit("")) == ""), F.lit(NO_NAME)),
    ]
    return catalog.select("dataset_id", F.explode(_violations(checks)).alias("error"))


def token_rules(documents: DataFrame, rules: list[TokenRule], text: str = "text") -> DataFrame:
    """One row per document and violated rule, from a single pass over each whole text; a NULL text holds no token."""
    checks = []
    for rule in rules:
        held = F.coalesce(F.col(text).contains(rule.token), F.lit(False))
        checks.append((~held if rule.required else held, F.lit(rule.name)))
    return documents.select("doc_id", F.explode(_violations(checks)).alias("rule"))


def _matched(tokens: list[str], required: list[bool], text: str):
    """Task function: numbers of the rules each text violates, from one pass over it."""

    def work(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        by_token: dict[str, list[int]] = {}
        for number, token in enumerate(tokens):
            by_token.setdefault(token, []).append(number)
        for token, numbers in by_token.items():
            if token:
                machine.add_word(token, numbers)
        machine.make_automaton()
        # Every text that is there holds the empty token.
        always = by_token.get("", [])
        needed = {number for number, must in enumerate(required) if must}
        for batch in batches:
            rows, found = [], []
            for row, value in enumerate(batch.column(text).to_pylist()):
                held = set(always if value is not None else ())
                if value and len(machine):
                    for _, numbers in machine.iter(value):
                        held.update(numbers)
                violated = sorted((needed - held) | (held - needed))
                rows += [row] * len(violated)
                found += violated
            at = pa.array(rows, pa.int64())
            kept = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in kept], pa.array(found, pa.int32())], [*kept, "_rule"])

    return work


def token_table_rules(documents: DataFrame, rules: DataFrame, text: str = "text", at_once: int = 100_000) -> DataFrame:
    """One row per document and violated rule of a table ``rules(rule, token, required)``, however many these are.

    The tokens of up to ``at_once`` rules become an automaton that finds all of them in one pass over each whole text, so
    5000 rules cost about what five do; more rules take several passes. A NULL text holds no token, any other the empty
    one; rules with a NULL token or ``required`` are left out. The rows of one automaton are what reaches the driver at a time.
    """
    listed = rules.where("token IS NOT NULL AND required IS NOT NULL").select("rule", F.col("token").cast("string").alias("token"), F.col("required").cast("boolean").alias("required"))
    placed = materialise(row_number_by(listed, [], ["rule", "token", "required"], "_number"), "token-rules")
    passes = -(-placed.count() // at_once)
    narrow = documents.select("doc_id", F.col(text).cast("string").alias("_text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = None
    for n in range(max(passes, 1)):
        own = placed.where(F.col("_number").between(n * at_once + 1, (n + 1) * at_once))
        part = sorted(own.collect(), key=lambda r: r["_number"])
        hits = narrow.mapInArrow(_matched([r["token"] for r in part], [r["required"] for r in part], "_text"), f"doc_id {kind}, _rule int")
        named = hits.join(own.select("rule", (F.col("_number") - 1 - n * at_once).cast("int").alias("_rule")), "_rule").select("doc_id", "rule")
        found = named if found is None else found.unionByName(named)
    return found


def structure_rules(
    items: DataFrame, document: str, position: str, kind: str, has_key: Column, first_kind: str, n_items: int = EXPECTED_ITEMS
) -> DataFrame:
    """One row per document and violation: item count, kind of the first item, items without the key."""
    shape = items.groupBy(document).agg(
        F.count("*").alias("n_items"),
        F.min_by(kind, position).alias("first_kind"),
        F.count_if(~F.coalesce(has_key, F.lit(False))).alias("n_bare"),
    )
    counted = F.format_string(WRONG_COUNT.format(n_items), F.col("n_items"))
    bare = F.format_string("%d items lack the key", F.col("n_bare"))
    checks = [
        (F.col("n_items") != n_items, counted),
        (F.coalesce(F.col("first_kind") != first_kind, F.lit(True)), F.lit(f"first item is not {first_kind}")),
        (F.col("n_bare") > 0, bare),
    ]
    return shape.select(document, F.explode(_violations(checks)).alias("error"))


def attr_contract(datasets: DataFrame, required: tuple[str, ...] = REQUIRED_ATTRS) -> DataFrame:
    """Failure text of each dataset whose convention is wrong or that lacks required attributes."""
    missing = missing_attrs(F.col("attrs"), required)
    convention = F.try_element_at(F.col("attrs"), F.lit("Conventions"))
    wrong = ~convention.eqNullSafe(F.lit(CONVENTIONS)) | (F.size(missing) > 0)
    text = F.concat(F.col("path"), F.lit(MISSING_ATTRS), F.array_join(missing, ", "), F.lit("]"))
    return datasets.where(wrong).select("path", text.alias("failure"))


def first_errors(errors: DataFrame, order: list[str], n: int = REPORTED_ERRORS) -> DataFrame:
    """The first ``n`` errors in rule order, as reported to the user."""
    return errors.orderBy(*order).limit(n)


def validation_summary(expected: DataFrame, found: DataFrame, errors: dict[str, DataFrame], key: str) -> DataFrame:
    """One row: expected, validated and error counts, and whether all is well. Every part is counted by itself."""
    n_expected = expected.select(key).distinct().agg(F.count("*")).scalar()
    validated = expected.select(key).distinct().join(found.select(key).distinct(), key, "left_semi")
    counted = {name: df.agg(F.count("*")).scalar() for name, df in errors.items()}
    total = reduce(lambda a, b: a + b, counted.values())
    row = validated.agg(F.count("*").alias("validated")).withColumns({"expected": n_expected, **counted})
    passed = (F.col("expected") == F.col("validated")) & (total == 0)
    return row.withColumn("errors", total).withColumn("passed", passed)


def failure_rollup(metadata_failures: DataFrame, registry_failures: DataFrame) -> DataFrame:
    """Failures per source and message with their number, both sources in one list."""
    both = metadata_failures.select(F.lit("metadata").alias("source"), F.col("failure").alias("message")).unionByName(
        registry_failures.select(F.lit("registry").alias("source"), F.col("error_message").alias("message"))
    )
    return both.groupBy("source", "message").agg(F.count("*").alias("n"))


def run_passed(failures: DataFrame) -> DataFrame:
    """One row: number of failures and whether there are none."""
    return failures.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_failures")).withColumn(
        "passed", F.col("n_failures") == 0
    )


def ordered_listing(files: DataFrame, order: list[str]) -> DataFrame:
    """Files with their 1-based place in the order."""
    return row_number_by(files, [], order, "ordinal")
