r"""Quality rules: fixed base rules and a learned decision list, in DataFrame functions only.

Features come from whole texts with array functions. The list is learned by sequential covering: each rule grows one
threshold condition at a time by information gain over counts that Spark aggregates from all labelled rows (a fixed
grid of thresholds, so that an answer has a few hundred rows at any size), is pruned back on a held-out third, and is
kept only while it rejects precisely. The list becomes one ordered conditional expression.

Defined results: null text = no words; words `[^\x20\x09-\x0D]+`; documents without labels, empty label tables and
labels of one class give an empty list (only the base rules reject); several labels of a document: their mean, from a
half on good; repeated document rows are judged one by one; extra columns are dropped by `judge` and kept by the stage.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Steps of the threshold grid of each feature.
GRID = {
    "word_mean": 0.25,
    "symbol_rate": 0.02,
    "upper_rate": 0.02,
    "bang_rate": 0.02,
    "dup_line_rate": 0.02,
    "repeat_rate": 0.02,
    "log_words": 0.25,
}


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts and rates of every document."""
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("w", F.filter(F.split("t", f"[{SPACES}]+"), lambda x: x != ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACES}]")))
    d = d.withColumn("n", F.size("w"))
    windows = F.transform(
        F.slice("w", F.lit(1), F.greatest(F.col("n") - 2, F.lit(0))),
        lambda x, i: F.struct(F.concat_ws(" ", x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)).alias("g"), i.alias("i")),
    )
    d = d.withColumn("s", F.sort_array(windows))
    same = lambda x, i: (F.get(F.col("s"), i + 1)["g"] == x["g"]) | ((i > 0) & (F.get(F.col("s"), i - 1)["g"] == x["g"]))
    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"])))
    covered = F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(3))))
    d = d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"!")).cast("long").alias("n_bangs"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def rates() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "word_mean": per("word_chars", "n_words"),
        "symbol_rate": per("n_symbols", "n_words"),
        "upper_rate": per("n_upper", "word_chars"),
        "bang_rate": per("n_bangs", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "log_words": F.log2(F.col("n_words") + 1.0),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    step: int
    above: bool

    def column(self) -> Column:
        bucket = F.col(self.feature)
        return bucket >= self.step if self.above else bucket < self.step

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.step * GRID[self.feature]:g}"


def buckets(counts: DataFrame) -> DataFrame:
    """Counts with each rate replaced by its place on the grid."""
    return counts.withColumns({k: F.floor(v / GRID[k]).cast("int") for k, v in rates().items()})


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _best(rows: DataFrame) -> tuple[Condition | None, float]:
    """The condition of highest gain on the rows, from one grouped count per feature and grid place; midway to the next lower place that has rows."""
    pairs = ", ".join(f"'{f}', {f}" for f in GRID)
    long = rows.select("bad", F.expr(f"stack({len(GRID)}, {pairs}) AS (feature, step)"))
    stats = long.groupBy("feature", "step").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    below = Window.partitionBy("feature").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("feature")
    table_ = stats.select(
        "feature", "step", ((F.coalesce(F.lag("step").over(Window.partitionBy("feature").orderBy("step")), F.col("step")) + F.col("step") + 1) / 2).cast("int").alias("middle"),
        F.coalesce(F.sum("p").over(below), F.lit(0)).alias("pb"), F.coalesce(F.sum("n").over(below), F.lit(0)).alias("nb"),
        F.sum("p").over(every).alias("pa"), F.sum("n").over(every).alias("na"),
    )
    found: tuple[float, int, str, int, bool] | None = None
    for r in table_.collect():  # at most the grid's places: rates are bounded by the grid, not by the rows
        for p, n, above in ((r.pa - r.pb, r.na - r.nb, True), (r.pb, r.nb, False)):
            g = _gain(p, n, r.pa, r.na)
            one = (g, -n, r.feature, r.middle, above)
            if g > 0 and (found is None or one > found):
                found = one
    return (Condition(found[2], found[3], found[4]), found[0]) if found else (None, 0.0)


def learn(labelled: DataFrame, max_rules: int = 6, max_conditions: int = 3, precision: float = 0.9, least: int = 8) -> list[list[Condition]]:
    """Rules that reject, in order. labelled: `buckets` columns, bad (0/1), prune (boolean). Every labelled row counts."""
    rules: list[list[Condition]] = []
    left = labelled
    for _ in range(max_rules):
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            c, _ = _best(left.filter(~F.col("prune")).filter(_all(rule)))
            if c is None or c in rule:
                break
            rule.append(c)
        if not rule:
            break
        parts = []
        for k in range(1, len(rule) + 1):
            hit = _all(rule[:k])
            for split in ("prune", "not prune"):
                own = hit & F.expr(split)
                parts += [F.count_if(own & (F.col("bad") == 1)), F.count_if(own & (F.col("bad") == 0))]
        v = list(left.agg(*[x.alias(f"c{i}") for i, x in enumerate(parts)]).first())
        options = []
        for k in range(len(rule)):
            pp, pn, gp, gn = v[4 * k : 4 * k + 4]
            options.append(((pp - pn + 1) / (pp + pn + 2), -k, pp + gp, pn + gn, pp, pn))
        _, minus, p, n, pp, pn = max(options)
        if p < least or p < precision * (p + n) or pp < precision * (pp + pn):
            break
        rules.append(rule[: 1 - minus])
        left = left.filter(~_all(rules[-1]))
    return rules


def decision(rules: list[list[Condition]]) -> Column:
    """The ordered list as one conditional expression over `buckets` columns: the number of the first rule that rejects, else null."""
    out = F.lit(None).cast("int")
    for i in range(len(rules) - 1, -1, -1):
        out = F.when(_all(rules[i]), F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed, rule (the learned rule that rejects, else null) and kept of every document."""
    counts = cut(features(docs))
    good = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") < 0.5).cast("long").alias("bad"))
    placed = buckets(counts.filter(~F.col("base_failed")))
    rows = placed.join(good, "doc_id").select(*GRID, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"))
    rules = learn(cut(rows))
    out = buckets(counts).withColumn("rule", decision(rules))
    return out.select(*counts.columns, "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with the columns of documents. Ids are taken as unique, as in documents."""
    kept = judge(docs, table(spark, sf_dir, "labels")).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
