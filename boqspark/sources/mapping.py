"""Mapping of file headers to canonical fields: scored proposals, templates, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ALIASES, squeezed

LEAST_SCORE, LEAST_TEMPLATE = 0.5, 0.3


def header_score(header: Column, alias: Column, equal: Column) -> Column:
    """`equal` (1 for a field's label, 0.95 for an alias) for the same text, else 0.7 times the length ratio if one holds the other."""
    h, a = squeezed(header), squeezed(alias)
    ratio = F.least(F.length(h), F.length(a)) / F.greatest(F.length(h), F.length(a))
    return F.when(h == a, equal).when((h != "") & (a != "") & (F.contains(h, a) | F.contains(a, h)), 0.7 * ratio).otherwise(0.0)


def propose(headers: DataFrame) -> DataFrame:
    """path, at, header -> path, at, header, field, score: each field once per file, headers in their order, best score first.

    The headers of one file are a few dozen, so the one-to-one choice runs per file in a small group.
    """
    spark = headers.sparkSession
    alias = spark.createDataFrame([(f, a, 1.0 if i == 0 else 0.95) for f, names in ALIASES.items() for i, a in enumerate(names)], "field string, alias string, top double")
    score = header_score(F.col("header"), F.col("alias"), F.col("top"))
    pairs = headers.join(F.broadcast(alias), score > 0)
    scored = pairs.groupBy("path", "at", "header", "field").agg(F.max(score).alias("score")).filter(F.col("score") >= LEAST_SCORE)

    def choose(pdf):
        used, rows = set(), []
        for _, own in pdf.sort_values(["at", "score", "field"], ascending=[True, False, True]).groupby("at", sort=True):
            free = own[~own["field"].isin(used)]
            if len(free):
                used.add(free.iloc[0]["field"])
                rows.append(free.iloc[0])
        return pdf.iloc[:0] if not rows else pdf.__class__(rows)

    return scored.groupBy("path").applyInPandas(choose, scored.schema)


def recommend_template(files: DataFrame, templates: DataFrame) -> DataFrame:
    """files: path, headers (array); templates: template, headers (array), pattern. The best template of each file over the threshold."""
    j = files.join(F.broadcast(templates.select("template", F.col("headers").alias("_h"), "pattern")), F.arrays_overlap("headers", "_h"))
    alike = F.size(F.array_intersect("headers", "_h")) / F.size(F.array_union("headers", "_h"))
    named = F.when(F.expr("path RLIKE pattern"), 1.0).otherwise(0.0)
    scored = j.withColumn("score", 0.7 * alike + 0.3 * named).filter(F.col("score") >= LEAST_TEMPLATE)
    best = scored.groupBy("path").agg(F.max(F.struct("score", "template")).alias("b"))
    return best.select("path", F.col("b.template").alias("template"), F.col("b.score").alias("score"))


def mapping_problems(mapping: DataFrame, required: tuple[str, ...] = ("item_name",)) -> DataFrame:
    """mapping: path, header, field. Rows problem, path, name: unknown fields, fields mapped twice, required fields missing, headers without a field (unmapped)."""
    spark = mapping.sparkSession
    known = spark.createDataFrame([(f,) for f in ALIASES], "field string")
    need = spark.createDataFrame([(f,) for f in required], "name string")
    unknown = mapping.filter("field IS NOT NULL").join(known, "field", "left_anti").select(F.lit("unknown").alias("problem"), "path", F.col("field").alias("name"))
    twice = mapping.filter("field IS NOT NULL").groupBy("path", "field").count().filter("count > 1").select(F.lit("duplicate").alias("problem"), "path", F.col("field").alias("name"))
    wanted = mapping.select("path").distinct().join(F.broadcast(need), F.lit(True))
    have = mapping.select("path", F.col("field").alias("name"))
    missing = wanted.join(have, ["path", "name"], "left_anti").select(F.lit("missing").alias("problem"), "path", "name")
    unmapped = mapping.filter("field IS NULL AND trim(coalesce(header, '')) <> ''").select(F.lit("unmapped").alias("problem"), "path", F.col("header").alias("name"))
    return unknown.unionByName(twice).unionByName(missing).unionByName(unmapped)
