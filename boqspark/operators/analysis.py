"""The price analysis of the material families, as one job: pool, window, families, KPIs, trend, histogram, groups, gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import with_family
from ..shared import cut, kept
from . import pricing, quality

# Families of the analysis; lines of the sixth count with the first.
FAMILIES = ("电线电缆", "管道", "钢筋", "水泥", "混凝土")
CONDUIT, CABLE = "配管配线", "电线电缆"


@dataclass
class PriceAnalysis:
    """Each part a DataFrame: pool (lines), kpis, trend, histogram, quantiles, groups, gate."""

    pool: DataFrame
    kpis: DataFrame
    trend: DataFrame
    histogram: DataFrame
    quantiles: DataFrame
    groups: DataFrame
    gate: DataFrame


def newest(rows: DataFrame, n: int | None) -> DataFrame:
    """The n lines of the newest periods; all without a number, which is the default everywhere."""
    return rows if n is None else rows.orderBy(F.desc_nulls_last("price_period"), "id").limit(n)


def pool(lines: DataFrame, today: Column, months: int = 24, least: int = 3, fall_back: bool = True) -> DataFrame:
    """Priced lines with family and group, of the last months; if these are fewer than `least`, of all time.

    A line's own standard name counts as its family where it is one; else the classifier's. group_id: family and spec.
    """
    rows = with_family(pricing.priced(lines))
    kind = F.when(F.col("std_name").isin(*FAMILIES, CONDUIT), F.col("std_name")).otherwise(F.col("family"))
    rows = rows.withColumn("family", kind).filter("family IS NOT NULL").withColumn("group_id", F.concat_ws(":", F.lit("regex"), "family", F.coalesce("spec", F.lit(""))))
    rows = kept(rows, "pool")  # read twice: for the number of new lines, and for the lines
    new = F.coalesce(F.col("price_period") >= F.date_sub(F.trunc(today, "month"), int(months * 30.5)), F.lit(False))
    if not fall_back:
        return rows.filter(new)
    # One row: how many lines the window has.
    return rows.join(F.broadcast(rows.agg(F.count_if(new).alias("_recent"))), new | (F.col("_recent") < least)).drop("_recent")


def of_family(rows: DataFrame, family: str) -> DataFrame:
    if family == "all":
        return rows
    return rows.filter(F.col("family").isin(CABLE, CONDUIT) if family == CABLE else F.col("family") == family)


def samples(rows: DataFrame, family: str, spec: str) -> DataFrame:
    """The lines of one group as they are, no price left out: what a shown group is made of."""
    return rows.filter((F.col("family") == family) & (F.col("spec") == spec))


def price_groups(rows: DataFrame, overall: DataFrame) -> DataFrame:
    """Groups of lines with statistics of their distinct rates, how many lines they come from, and the deviation of their
    average from that of `overall` (one row) in percent."""
    distinct = pricing.group_prices(pricing.newest_first(rows, "group_id"), "group_id")
    raw = rows.groupBy(F.col("group_id").alias("_g")).agg(F.count("*").alias("n_lines"))
    g = distinct.join(raw, F.col("group_id") == F.col("_g")).join(F.broadcast(overall.select(F.col("avg_rate").alias("_all"))))
    return g.withColumn("deviation", F.round(pricing.deviation_pct(F.col("avg_rate"), F.col("_all")), 1)).drop("_g", "_all")


def top_groups(groups: DataFrame, k: int = 20) -> DataFrame:
    return groups.orderBy(F.desc(F.abs("deviation")), "group_id").limit(k)


def price_analysis(lines: DataFrame, today: Column, months: int = 24, family: str = "all", least: int = 3, group: str = "") -> PriceAnalysis:
    """All parts of the analysis over a bill with keys. `group` narrows all but the groups to one group_id.

    One rate of a group counts once, whatever the number of projects that repeat it. The lines are classified once and written.
    """
    rows = pool(lines, today, months, least)
    chosen = of_family(rows, family)
    distinct = cut(pricing.newest_first(chosen, "group_id"))
    own = distinct.filter(F.col("group_id") == group) if group else distinct
    share = pricing.THRESHOLDS.get(family, pricing.DEFAULT_THRESHOLD)
    spread = cut(pricing.summary_rows(own))
    # spread over all distinct rates, average without outliers; one row
    kpis = pricing.kpis(own, share=share).join(F.broadcast(spread.select("stddev")))
    kpis = cut(kpis.withColumn("cv_pct", F.round(F.try_divide(100 * F.col("stddev"), F.col("avg_rate")), 1)).withColumn("threshold", F.lit(share)))
    return PriceAnalysis(
        pool=rows, kpis=kpis, trend=pricing.group_prices(own, "price_period", share=share), histogram=pricing.histogram(own.withColumn(pricing.RATE, F.col(pricing.RATE).cast("double"))),
        quantiles=spread, groups=price_groups(chosen, kpis), gate=quality.gate(quality.metrics(rows)),
    )
