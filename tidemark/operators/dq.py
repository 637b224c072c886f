"""Declarative data-quality rules: all rules of a table are evaluated in one pass, and nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import bar_key, row_json, truncate

# Rule ids, table names, sizes of the quarantine columns, required columns.
COMPLETE, UNIQUE, REFERENTIAL = "DQ-COMPLETE", "DQ-UNIQUE", "DQ-REFERENTIAL"
FACT_ORDERS, FACT_LINES = "fact_orders", "fact_order_lines"
ROW_KEY_SIZE, REASON_SIZE = 255, 512
ORDER_REQUIRED = ("order_id", "store_id", "region", "total_amount_minor", "currency")
LINE_REQUIRED = ("sku_id", "unit_price_minor", "currency")

VIOLATION_COLUMNS = ("rule_id", "table_name", "row_key", "reason", "violating_row_json")


@dataclass(frozen=True)
class Rule:
    """A rule over one table. Subclasses implement `reason_of`; `judged` evaluates all rules of a table in one pass."""

    table_name: str
    pk: tuple[str, ...]
    rule_id: str = ""
    row_columns: tuple[str, ...] | None = field(default=None, kw_only=True)

    def reason_of(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        """The rows, with what a lookup join adds under names that begin with `tag`, and the reason, null if none.

        A lookup has one row per key, so every row of `df` stays exactly once.
        """
        raise NotImplementedError

    def violations(self, df: DataFrame) -> DataFrame:
        return violations(df, [self])


@dataclass(frozen=True)
class PredicateRule(Rule):
    """Rows whose reason expression is not null; pass the expression."""

    reason: Column | None = None

    def reason_of(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        return df, self.reason


@dataclass(frozen=True)
class UniqueRule(Rule):
    """Second and later rows of a key, in the order given (which must be total within a key).

    Keys with more than one row are found by a partially aggregated count over the key and position columns alone; only
    their first position travels to the rows. A key that holds a large share of the rows stays on the streamed side of
    the join, where its partition can be split.
    """

    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def reason_of(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        position = F.struct(*[F.col(c) for c in self.order])
        repeated = (
            df.groupBy(*self.keys).agg(F.min(position).alias(f"{tag}first"), F.count(F.lit(1)).alias(f"{tag}n"))
            .where(F.col(f"{tag}n") > 1)
            .select(*[F.col(k).alias(f"{tag}{k}") for k in self.keys], f"{tag}first")
        )
        same_key = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{tag}{k}")) for k in self.keys])
        names = ", ".join(self.keys)
        values = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in self.keys])
        reason = F.concat(F.lit(f"duplicate key [{names}] = ["), values,
                          F.lit("] (first occurrence kept, later occurrences quarantined)"))
        return df.join(repeated, same_key, "left"), F.when(position > F.col(f"{tag}first"), reason)


@dataclass(frozen=True)
class ReferentialRule(Rule):
    """Rows whose foreign key is null or absent from the parent.

    A null key has no parent to find; such rows are spread over the join by their own key.
    """

    fk: str = ""
    parent_name: str = ""
    parent: DataFrame | None = None
    parent_key: str = ""

    def reason_of(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        known = self.parent.select(F.col(self.parent_key).cast("string").alias(f"{tag}known")).where(
            F.col(f"{tag}known").isNotNull()).distinct()
        spread = F.concat(F.lit("\u0000"), bar_key(*[F.col(c) for c in self.pk]))
        value = F.coalesce(F.col(self.fk).cast("string"), F.lit("null"))
        reason = F.concat(F.lit(f"{self.fk}="), value, F.lit(f" has no matching row in {self.parent_name}"))
        keyed = df.withColumn(f"{tag}key", F.coalesce(F.col(self.fk).cast("string"), spread))
        joined = keyed.join(known, F.col(f"{tag}key") == F.col(f"{tag}known"), "left")
        return joined, F.when(F.col(f"{tag}known").isNull(), reason)


#: The array of violations (rule_id, reason) that `judged` adds to every row, in the order of the rules.
FOUND = "_found"


def judged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every row of a table once, with the violations of all its rules.

    Expressions cost nothing more, repeated keys and parents are each joined once, and violations, counters and the
    rows that pass all come from this one result.
    """
    rows, found = df, []
    for i, rule in enumerate(rules):
        rows, reason = rule.reason_of(rows, f"_r{i}_")
        found.append(F.when(reason.isNotNull(), F.struct(F.lit(rule.rule_id).alias("rule_id"), reason.alias("reason"))))
    hits = F.filter(F.array(*found), lambda v: v.isNotNull())
    return rows.select(*df.columns, hits.alias(FOUND))


def violations_of(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The violations of judged rows, one row each."""
    first = rules[0]
    columns = list(first.row_columns or [c for c in rows.columns if c != FOUND])
    return rows.where(F.size(FOUND) > 0).select("*", F.inline(FOUND)).select(
        F.col("rule_id"), F.lit(first.table_name).alias("table_name"),
        bar_key(*[F.col(c) for c in first.pk]).alias("row_key"), F.col("reason"),
        row_json(rows, columns).alias("violating_row_json"))


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All violations of one table."""
    return violations_of(judged(df, rules), rules)


def order_complete() -> Rule:
    """Required order columns are not null; the reason lists the missing ones in declared order."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ORDER_REQUIRED]),
                       lambda x: x.isNotNull())
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing required field(s): ["),
                                                  F.array_join(missing, ", "), F.lit("]")))
    return PredicateRule(FACT_ORDERS, ("order_id",), COMPLETE, reason)


def line_complete() -> Rule:
    """Required line columns are not null and the quantity is positive; all problems are listed."""
    quantity = F.col("quantity")
    problems = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in LINE_REQUIRED]
    problems.append(F.when(quantity.isNull(), F.lit("quantity is null"))
                    .when(quantity <= 0, F.concat(F.lit("quantity must be > 0, got "), quantity.cast("string"))))
    listed = F.concat_ws("; ", *problems)
    return PredicateRule(FACT_LINES, ("order_id", "line_no"), COMPLETE, F.when(listed != "", listed))


def order_rules(order: Sequence[str], stores: DataFrame) -> list[Rule]:
    """The three order rules; `stores` holds the known `store_id` values."""
    return [
        order_complete(),
        UniqueRule(FACT_ORDERS, ("order_id",), UNIQUE, ("order_id",), tuple(order)),
        ReferentialRule(FACT_ORDERS, ("order_id",), REFERENTIAL, "store_id", "dim_store", stores, "store_id"),
    ]


def line_rules(order: Sequence[str], orders: DataFrame) -> list[Rule]:
    """The three line rules; `orders` holds the orders that passed."""
    pk = ("order_id", "line_no")
    return [
        line_complete(),
        UniqueRule(FACT_LINES, pk, UNIQUE, pk, tuple(order)),
        ReferentialRule(FACT_LINES, pk, REFERENTIAL, "order_id", FACT_ORDERS, orders, "order_id"),
    ]


def measures(rules: Sequence[Rule]) -> list[Column]:
    """Checked rows and violations of every rule over judged rows, as one row of counters."""
    hit = lambda rule: F.exists(F.col(FOUND), lambda v: v["rule_id"] == rule.rule_id)
    return [F.count(F.lit(1)).alias("checked"), *[F.count_if(hit(r)).alias(r.rule_id) for r in rules]]


def results(tables: Sequence[tuple[DataFrame, Sequence[Rule]]]) -> DataFrame:
    """Checked rows, violations and PASS/FAIL of every rule of judged tables, also of rules that found nothing."""
    parts = []
    for rows, rules in tables:
        counted = rows.agg(*measures(rules))
        per_rule = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(r.rule_id).alias("violations"))
                             for r in rules])
        parts.append(counted.select("checked", F.inline(per_rule)).withColumn(
            "table_name", F.lit(rules[0].table_name)))
    return _with_status(reduce(DataFrame.unionByName, parts))


def results_of_counts(spark: SparkSession, counts: Sequence[tuple[dict[str, int], Sequence[Rule]]]) -> DataFrame:
    """As `results`, from counters that were taken while the judged rows were written."""
    rows = [(seen["checked"], r.rule_id, seen[r.rule_id], rules[0].table_name) for seen, rules in counts for r in rules]
    return _with_status(spark.createDataFrame(
        rows, "checked bigint, rule_id string, violations bigint, table_name string"))


def _with_status(counted: DataFrame) -> DataFrame:
    return counted.select("rule_id", "table_name", "checked", "violations",
                          F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"))


def quarantine_rows(found: DataFrame, run_id: str) -> DataFrame:
    """Violations in the shape of the quarantine table, with their whole keys and reasons."""
    return found.select(F.lit(run_id).alias("run_id"), "rule_id", "table_name", "row_key", "reason",
                        "violating_row_json")


def database_sizes(rows: DataFrame) -> DataFrame:
    """Quarantine rows as a database with fixed column sizes takes them: key and reason are cut."""
    return rows.withColumns({"row_key": truncate(F.col("row_key"), ROW_KEY_SIZE),
                             "reason": truncate(F.col("reason"), REASON_SIZE)})


def passing_judged(rows: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The judged rows whose key has no violation in any of its rows, without the array."""
    bad = rows.where(F.size(FOUND) > 0).select(bar_key(*[F.col(c) for c in pk]).alias("row_key"))
    return passing(rows.drop(FOUND), pk, bad)


def passing(df: DataFrame, pk: Sequence[str], found: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Rows whose key is not quarantined.

    Every row of a quarantined key is excluded, the first occurrence too, and so are rows with a null
    key column. `key` names the columns that form the quarantine key when they differ from `pk`.
    """
    bad = found.select(F.col("row_key").alias("_bad")).distinct()
    kept = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in pk]))
    return kept.join(bad, bar_key(*[F.col(c) for c in (key or pk)]) == F.col("_bad"), "left_anti")


def passing_unique(df: DataFrame, pk: Sequence[str], complete: PredicateRule, ref: ReferentialRule) -> DataFrame:
    """As `passing` for a table whose keys are unique by construction (silver after the latest-row step).

    A key then has one row, so the row rules are plain filters and the reference is a semi-join: one
    pass over the table, no second look at its keys.
    """
    kept = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in pk]) & complete.reason.isNull())
    known = ref.parent.select(F.col(ref.parent_key).alias("_known")).where("_known is not null")
    return kept.join(known, F.col(ref.fk) == F.col("_known"), "left_semi")


def passing_keep_first(df: DataFrame, rule: UniqueRule, found_other: DataFrame) -> DataFrame:
    """As `passing`, but a duplicated key keeps its first row when no other rule hits the key."""
    position = F.struct(*[F.col(c) for c in rule.order])
    firsts = df.groupBy(*rule.keys).agg(F.min_by(F.struct(*df.columns), position).alias("_row")).select("_row.*")
    return passing(firsts, rule.pk, found_other)
