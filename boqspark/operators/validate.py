"""Validation rules as data: each rule adds a violation, violations are counted per rule and level."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept


@dataclass(frozen=True)
class Rule:
    """kind: required, range, regex, enum, formula or unique; level: error, warning or info."""

    name: str
    kind: str
    column: str
    level: str = "error"
    args: dict = field(default_factory=dict)


def violated(rule: Rule) -> Column:
    """Whether a row breaks a rule. Blank values break `required` only; numbers in texts are read as such."""
    c, a = F.col(rule.column), rule.args
    text = F.trim(c.cast("string"))
    some = F.coalesce(text != "", F.lit(False))
    if rule.kind == "required":
        return ~some
    if rule.kind == "range":
        v, out = c.try_cast("double"), F.lit(False)
        if "min" in a:
            out = out | (v <= a["min"] if a.get("exclusive", a.get("exclusive_min")) else v < a["min"])
        if "max" in a:
            out = out | (v >= a["max"] if a.get("exclusive", a.get("exclusive_max")) else v > a["max"])
        return F.coalesce(out, F.lit(False))
    if rule.kind == "regex":
        return some & ~c.cast("string").rlike(f"^(?:{a['pattern']})")
    if rule.kind == "enum":
        return some & ~text.isin(*[str(v) for v in a["values"]])
    if rule.kind == "formula":
        product = F.col(a["a"]).try_cast("double") * F.col(a["b"]).try_cast("double")
        return F.coalesce(F.try_divide(F.abs(c.try_cast("double") - product), F.abs(product)) > a.get("tolerance", 0.01), F.lit(False))
    raise ValueError(f"no such rule: {rule.kind}")


def violations(df: DataFrame, rules: list[Rule], key: str = "id") -> DataFrame:
    """key, rule, level: a row per broken rule."""
    plain = [r for r in rules if r.kind != "unique"]
    marks = F.array_compact(F.array(*[F.when(violated(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.level).alias("level"))) for r in plain]))
    out = df.select(F.col(key), F.inline(marks))
    for r in rules:
        if r.kind == "unique":
            many = df.filter(F.col(r.column).isNotNull()).groupBy(r.column).count().filter("count > 1").select(r.column)
            out = out.unionByName(df.join(many, r.column, "left_semi").select(key, F.lit(r.name).alias("rule"), F.lit(r.level).alias("level")))
    return out


def report(df: DataFrame, rules: list[Rule], key: str = "id") -> DataFrame:
    """rule, level, n, n_rows: broken rules and the rows that break them. Counts of repeated values need no way back to the rows."""
    plain = violations(df, [r for r in rules if r.kind != "unique"], key).groupBy("rule", "level").agg(F.count("*").alias("n"))
    for r in rules:
        if r.kind == "unique":
            many = df.filter(F.col(r.column).isNotNull()).groupBy(r.column).agg(F.count("*").alias("c")).filter("c > 1").agg(F.sum("c").alias("n")).filter("n > 0")
            plain = plain.unionByName(many.select(F.lit(r.name).alias("rule"), F.lit(r.level).alias("level"), "n"))
    return plain.withColumn("n_rows", F.col("n"))  # a rule marks a row once


def summary(df: DataFrame, rules: list[Rule], key: str = "id") -> DataFrame:
    """One row: rows, rows without an error, errors, warnings, infos, and whether the rows may be imported (no errors)."""
    levels, once = ("error", "warning", "info"), [r for r in rules if r.kind == "unique"]
    broken = lambda x: sum((violated(r).cast("int") for r in rules if r.kind != "unique" and r.level == x), F.lit(0)).alias(f"_{x}")
    # a narrow row for each, written once: key, broken rules by level, and the columns whose values may not repeat
    rows = kept(df.select(F.col(key).alias("_key"), *[broken(x) for x in levels], *[F.col(r.column).alias(f"_u{i}") for i, r in enumerate(once)]), "judged")
    bad = rows.filter("_error > 0").select("_key")
    out = rows.agg(F.count("*").alias("total_rows"), *[F.coalesce(F.sum(f"_{x}"), F.lit(0)).cast("long").alias(f"{x}s") for x in levels])
    for i, r in enumerate(once):
        many = rows.filter(f"_u{i} IS NOT NULL").groupBy(f"_u{i}").agg(F.count("*").alias("_c")).filter("_c > 1")
        out = out.join(F.broadcast(many.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_more")))).withColumn(f"{r.level}s", F.col(f"{r.level}s") + F.col("_more")).drop("_more")
        if r.level == "error":  # only these need the way back to the rows
            bad = bad.unionByName(rows.join(many, f"_u{i}", "left_semi").select("_key"))
    out = out.join(F.broadcast(bad.agg(F.countDistinct("_key").alias("_bad"))))  # one row each
    return out.select("total_rows", (F.col("total_rows") - F.col("_bad")).alias("valid_rows"), "errors", "warnings", "infos", (F.col("errors") == 0).alias("can_import"))


def can_import(df: DataFrame, rules: list[Rule], key: str = "id") -> DataFrame:
    return summary(df, rules, key)


# Rule templates of a bill, and which of them count unless others are chosen.
TEMPLATES = {
    "required_item_name": Rule("required_item_name", "required", "item_name", "error"),
    "quantity_positive": Rule("quantity_positive", "range", "quantity", "warning", {"min": 0, "exclusive_min": True}),
    "unit_rate_nonnegative": Rule("unit_rate_nonnegative", "range", "unit_rate", "warning", {"min": 0}),
    "gb_code_format": Rule("gb_code_format", "regex", "item_code", "warning", {"pattern": r"\d{9,12}$"}),
    "total_consistency": Rule("total_consistency", "formula", "total", "warning", {"a": "quantity", "b": "unit_rate", "tolerance": 0.01}),
    "no_duplicate_item": Rule("no_duplicate_item", "unique", "item_name", "info"),
    "unit_standard": Rule("unit_standard", "enum", "unit", "info", {"values": ["m", "m2", "m3", "kg", "t", "个", "套", "组", "台", "樘", "m²", "m³", "吨", "米", "平方米", "立方米"]}),
}
ENABLED = ("required_item_name", "quantity_positive", "unit_rate_nonnegative")


def rules_from(table: DataFrame) -> list[Rule]:
    """Rules kept as a table (name, kind, column, level, args as JSON), a few rows that people write."""
    import json

    return [Rule(r["name"], r["kind"], r["column"], r["level"] or "warning", json.loads(r["args"] or "{}")) for r in table.collect()]


BILL_RULES = [
    Rule("name_required", "required", "item_name"),
    Rule("code_required", "required", "item_code", "warning"),
    Rule("rate_positive", "range", "unit_rate_cents", "error", {"min": 0, "exclusive": True}),
    Rule("quantity_range", "range", "quantity", "warning", {"min": 1, "max": 48}),
    Rule("code_digits", "regex", "item_code", "warning", {"pattern": "[0-9]{9}"}),
    Rule("source_known", "enum", "data_source_type", "error", {"values": ["completed", "control_price"]}),
    Rule("total_formula", "formula", "total_cents", "error", {"a": "quantity", "b": "unit_rate_cents", "tolerance": 0.00001}),
    Rule("code_unique", "unique", "item_code", "info"),
]
