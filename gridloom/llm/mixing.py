"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget runs down a domain-language-source tree. At every node it is shared among the children by weight; a child
that cannot use its share even with the allowed epochs passes the shortage on to its siblings, and only what a whole
family cannot use has gone to the family's own siblings before. Each leaf then takes whole seeded epochs of its
documents, and of the last one the prefix of a seeded order that fills its quota.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import materialise

LEVELS = ["domain", "lang", "source"]
#: Rows of a piece of a leaf's seeded order, about; only the piece in which its quota ends is sorted.
PIECE_ROWS = 4096


@dataclass(frozen=True)
class Mixture:
    """Integer weights by name on each level, 1 where none is given; tokens wanted in all, and the most epochs."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_percent: int = 100
    max_epochs: int = 4
    seed: int = 1
    missing: str = "(none)"


def default_domain() -> Column:
    """Domain of a source name: its trailing number modulo 4; names without one share a domain."""
    number = F.regexp_extract(F.coalesce(F.col("source").cast("string"), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), number.try_cast("bigint") % 4))


def _weight(level: str, mixture: Mixture) -> Column:
    column = F.lit(1).cast("long")
    for name, weight in sorted(mixture.weights.get(level, {}).items()):
        column = F.when(F.col(level) == name, F.lit(weight).cast("long")).otherwise(column)
    return column


def shared_out(children: DataFrame, family: list[str], name: str, budget: str, capacity: str, weight: str, out: str) -> DataFrame:
    """Share ``budget`` (the family's, on every row) by ``weight`` among children that hold at most ``capacity``.

    Children are filled in the order of capacity per weight: the first ones are those that fall short, and what remains
    after them is dealt by weight, whole tokens, nothing lost to rounding. All columns are whole numbers.
    """
    order = [F.col(capacity) / F.col(weight), F.col(name)]
    line = Window.partitionBy(*family).orderBy(*order)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*family)
    placed = children.withColumns(
        {
            "_used": F.coalesce(F.sum(capacity).over(before), F.lit(0)),
            "_open": F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0)),
        }
    )
    # A child falls short if even an equal deal per weight of what is left exceeds what it holds.
    short = F.col(capacity) * F.col("_open") <= F.col(weight) * (F.col(budget) - F.col("_used"))
    marked = placed.withColumn("_short", short)
    open_weight = F.when(~F.col("_short"), F.col(weight)).otherwise(0)
    dealt = marked.withColumns(
        {
            "_rest": F.col(budget) - F.sum(F.when(F.col("_short"), F.col(capacity)).otherwise(0)).over(whole),
            "_total": F.sum(open_weight).over(whole),
            "_to": F.sum(open_weight).over(line.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).withColumn("_from", F.col("_to") - F.col(weight))
    share = F.expr("(_rest * _to) div _total - (_rest * _from) div _total")
    quota = F.when(F.col("_short"), F.col(capacity)).otherwise(share)
    return dealt.withColumn(out, quota).drop("_used", "_open", "_short", "_rest", "_total", "_to", "_from")


def leaf_quotas(sizes: DataFrame, mixture: Mixture) -> DataFrame:
    """``domain, lang, source, tokens, quota`` from ``domain, lang, source, tokens`` (one row per leaf)."""
    leaves = sizes.withColumn("_held", F.col("tokens") * mixture.max_epochs)
    for level in LEVELS:
        leaves = leaves.withColumn(f"_w_{level}", _weight(level, mixture))
    total = Window.partitionBy(F.lit(0))
    tops = leaves.groupBy("domain", "_w_domain").agg(F.sum("_held").alias("_c"), F.sum("tokens").alias("_t"))
    tops = tops.withColumn("_goal", F.expr(f"sum(_t) over (partition by 0) * {mixture.budget_percent} div 100"))
    tops = tops.withColumn("_budget", F.least("_goal", F.sum("_c").over(total))).withColumn("_family", F.lit(0))
    domains = shared_out(tops, ["_family"], "domain", "_budget", "_c", "_w_domain", "_domain_quota").select("domain", "_domain_quota")
    langs = leaves.groupBy("domain", "lang", "_w_lang").agg(F.sum("_held").alias("_c")).join(domains, "domain")
    langs = shared_out(langs, ["domain"], "lang", "_domain_quota", "_c", "_w_lang", "_lang_quota").select("domain", "lang", "_lang_quota")
    joined = leaves.join(langs, ["domain", "lang"])
    return shared_out(joined, ["domain", "lang"], "source", "_lang_quota", "_held", "_w_source", "quota").select(*LEVELS, "tokens", "quota")


def word_count(text: Column) -> Column:
    """Tokens of a text for the budget: its words."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _places(docs: DataFrame, mixture: Mixture, domain: Column | None, exact: bool) -> list[Column]:
    """What names a row: id, leaf, and hash of its text, or of all its columns if ``exact``."""
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit(mixture.missing)) for c in ("lang", "source")}
    domain = F.coalesce((default_domain() if domain is None else domain).cast("string"), F.lit(mixture.missing))
    told = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    if exact:
        told = F.md5(F.concat(told, F.to_json(F.struct(F.col("text").isNull(), *[F.col(c) for c in docs.columns if c != "text"]))).cast("binary"))
    return [F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"), named["lang"].alias("lang"), named["source"].alias("source"), told.alias("tx")]


def _ordered(rows: DataFrame, plan: DataFrame, mixture: Mixture) -> DataFrame:
    """``rows`` with their leaf's plan and their place, ``_order``, in its last epoch."""
    order = F.concat_ws(":", F.lit(str(mixture.seed)), F.col("_epochs") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tx")
    return rows.join(plan, LEVELS).withColumn("_order", F.md5(order.cast("binary")))


@dataclass(frozen=True)
class _Decided:
    """A leaf's whole epochs and the piece its quota ends in; of that piece, what is taken whole and what is cut."""

    rows: DataFrame
    plan: DataFrame
    whole: DataFrame
    cut: DataFrame

    def taken(self, rows: DataFrame, mixture: Mixture) -> DataFrame:
        """``rows(doc_id, domain, lang, source, tx, ...)`` once per epoch in which they are taken whole."""
        placed = _ordered(rows, self.plan, mixture).join(self.whole.withColumn("_inside", F.lit(True)), [*LEVELS, "_order"], "left")
        last = F.coalesce((F.substring("_order", 1, F.col("_width")) < F.col("_last")) | F.col("_inside"), F.lit(False))
        placed = placed.withColumn("_times", F.col("_epochs") + last.cast("long")).where("_times > 0")
        return placed.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))


def _decided(docs: DataFrame, mixture: Mixture, domain: Column | None, exact: bool) -> _Decided:
    counted = docs.select(*_places(docs, mixture, domain, exact), word_count(F.col("text")).alias("n_tokens"))
    rows = materialise(counted, "token-counts")
    sizes = materialise(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("_rows")), "leaf-sizes")
    quotas = leaf_quotas(sizes.drop("_rows"), mixture).join(sizes.select(*LEVELS, "_rows"), LEVELS)
    filled = F.col("tokens") > 0
    plan = quotas.select(
        *LEVELS, "quota",
        F.when(filled, F.expr("quota div tokens")).otherwise(F.lit(0)).cast("long").alias("_epochs"),
        F.when(filled, F.expr("quota % tokens")).otherwise(F.lit(0)).cast("long").alias("_rest"),
        # Hexadecimal digits of the order that name a piece: some thousand rows each.
        F.greatest(F.lit(1), F.ceil(F.log(16.0, (F.col("_rows") + 1) / PIECE_ROWS))).cast("int").alias("_width"),
    )
    plan = materialise(plan, "quotas")
    partial = _ordered(rows, plan.where("_rest > 0"), mixture).withColumn("_piece", F.substring("_order", 1, F.col("_width")))
    pieces = partial.groupBy(*LEVELS, "_piece", "_rest").agg(F.sum("n_tokens").alias("_size"))
    earlier = Window.partitionBy(*LEVELS).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    run = pieces.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    # One row per leaf: the piece in which the quota ends.
    last = run.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_size") >= F.col("_rest")))
    ends = materialise(last.select(*LEVELS, F.col("_piece").alias("_last"), "_before"), "quota-ends")
    inside = partial.join(ends, LEVELS).where(F.col("_piece") == F.col("_last"))
    # Equal rows are one line with their number, so no run of them meets in a task.
    lines = inside.groupBy(*LEVELS, "_order", "doc_id", "tx", "n_tokens", "quota", "_epochs", "_rest", "_before").agg(F.count("*").alias("_copies"))
    line = Window.partitionBy(*LEVELS).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("_copies") * F.col("n_tokens")
    lines = lines.withColumn("_left", F.col("_rest") - F.col("_before") - F.coalesce(F.sum(size).over(line), F.lit(0))).where("_left > 0")
    lines = materialise(lines, "quota-lines")
    cut = lines.where(size > F.col("_left")).withColumn("epoch", F.col("_epochs") + 1)
    plan = materialise(plan.join(ends.select(*LEVELS, "_last"), LEVELS, "left"), "mixture-plan")
    return _Decided(rows, plan, lines.where(size <= F.col("_left")).select(*LEVELS, "_order"), cut)


def _copies(cut: DataFrame) -> DataFrame:
    """The copies of a line that begin inside the quota, with ``n_taken``; arrays stay short however many there are."""
    number = F.expr("(_left + n_tokens - 1) div n_tokens")
    step = 1 << 16
    blocks = cut.withColumn("_number", number).withColumn("_block", F.explode(F.expr(f"sequence(0, (_number - 1) div {step})")))
    each = blocks.withColumn("_copy", F.explode(F.expr(f"sequence(_block * {step}, least(_number, (_block + 1) * {step}) - 1)")))
    return each.withColumn("n_taken", F.least(F.col("n_tokens"), F.col("_left") - F.col("_copy") * F.col("n_tokens")))


def mixed(docs: DataFrame, mixture: Mixture, domain: Column | None = None) -> DataFrame:
    """Documents picked for the mixture: ``doc_id, domain, lang, source, epoch, n_tokens, n_taken, quota``.

    One row per pick, so a document comes once per epoch. Whole epochs take all documents of the leaf. In the last one
    documents follow the MD5 of seed, epoch, id and text hash, and those that begin before the quota's end are picked;
    ``n_taken`` is the part inside the quota, so the parts of a leaf add up to its quota, whatever ids repeat or are NULL. Rows
    equal in id and text follow each other. A NULL language, source or domain is a name of its own, a NULL id sorts as
    an empty one, a text without words has no tokens and is picked with the documents at its place. Other columns are
    ignored; an empty table gives no picks.
    """
    found = _decided(docs, mixture, domain, exact=False)
    columns = ["doc_id", *LEVELS, "epoch", "n_tokens", "n_taken", "quota"]
    whole = found.taken(found.rows, mixture).withColumn("n_taken", F.col("n_tokens"))
    return whole.select(*columns).unionByName(_copies(found.cut).select(*columns))


def text_prefix(text: Column, words: Column) -> Column:
    """``text`` up to the end of its word number ``words``."""
    pieces = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def mixed_rows(docs: DataFrame, mixture: Mixture, domain: Column | None = None) -> DataFrame:
    """``docs`` as the mixture picks them, all columns kept whatever their names, each row once per epoch it is in.

    Picks are those of ``mixed``, with rows told apart by all their columns; the document in which a leaf's quota ends has
    its ``text`` cut to the words inside the quota. Rows equal in every column are as many as are picked.
    """
    found = _decided(docs, mixture, domain, exact=True)
    tagged = docs.select(*_places(docs, mixture, domain, exact=True), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    whole = found.taken(tagged, mixture).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    # One line per leaf at most, so the texts to be cut are few.
    at = found.cut.select(*[F.col(c).alias(f"_{c}") for c in (*LEVELS, "tx")], F.col("doc_id").alias("_id"), "_left", "n_tokens")
    same = [tagged[c] == at[f"_{c}"] for c in (*LEVELS, "tx")]
    own = tagged.join(at, [*same, tagged["doc_id"].eqNullSafe(at["_id"])]).groupBy(*at.columns).agg(F.first("_row").alias("_row"))
    text = F.col("_row")["text"].cast("string")
    part = F.when(F.col("n_taken") < F.col("n_tokens"), text_prefix(text, F.col("n_taken"))).otherwise(text)
    kinds = {f.name: f.dataType for f in docs.schema}
    cut = _copies(own).select(*[part.cast(kinds[c]).alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
    return whole.unionByName(cut)
