"""Price statistics over bills: rates in whole cents, one final division.

Statistics of a group come from the counts of its distinct rates: rows are first added up by key and rate, so that a key
with a large share of all rows is spread over its rates. Sums of a key are added up before they are shuffled. Order statistics
go two ways down: the rates of a key fall into ranges that depend on the rate alone, the counts of these few thousand ranges
tell which of them holds a place, and only there the rates are ranked. So no task sees all rates of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

# Share of deviation from the average from which a price is an anomaly.
THRESHOLDS = {"电线电缆": 0.90, "钢筋": 0.50, "水泥": 0.30, "混凝土": 0.30, "管道": 0.50, "配管配线": 0.50}
DEFAULT_THRESHOLD, LEAST_SAMPLES, TRIM_FROM = 0.30, 3, 8
DIMENSIONS = ["aggregate_id", "match_key_source", "province", "price_period"]
RATE = "unit_rate_cents"


def priced(df: DataFrame) -> DataFrame:
    """Lines that enter price history: active, completed, with a rate."""
    return df.filter(F.col("active") & (F.col("data_source_type") == "completed") & F.col(RATE).isNotNull())


def threshold(category: Column) -> Column:
    """Share of deviation of a family; the default for others."""
    out = F.lit(DEFAULT_THRESHOLD)
    for name, share in THRESHOLDS.items():
        out = F.when(category == name, share).otherwise(out)
    return out


def weight() -> Column:
    return F.when(F.coalesce(F.col("quantity"), F.lit(0)) == 0, 1).otherwise(F.col("quantity"))


def weighted_average() -> Column:
    return F.coalesce(F.try_divide(F.sum(F.col(RATE) * weight()), F.sum(weight())), F.avg(RATE))


def deviation_pct(rate: Column, average: Column) -> Column:
    return F.when(average == 0, 0.0).otherwise((rate - average) / average * 100)


def is_anomaly(rate: Column, average: Column, n: Column, share: float | Column = DEFAULT_THRESHOLD) -> Column:
    return (n >= LEAST_SAMPLES) & (average != 0) & (F.abs(rate - average) > share * F.abs(average))


def rate_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows (c) and weights (w) of each key and rate; a null rate has c = 0 and keeps its key."""
    return df.groupBy(*keys, RATE).agg(F.count(RATE).alias("c"), F.sum(F.when(F.col(RATE).isNotNull(), weight())).alias("w"))


def _with(df: DataFrame, own: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """df with the columns of `own`, a row (or some) per key; null is a key. Without keys `own` is one row."""
    if not keys:
        return df.join(F.broadcast(own))
    other = own.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in own.columns if c not in keys])
    return df.join(other, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], how).drop(*[f"_k_{k}" for k in keys])


def _average(kept: Column) -> Column:
    """Weighted average of the kept rates of a key; the plain one where the weights add up to nothing."""
    total = lambda x: F.sum(F.when(kept, x))
    return F.coalesce(F.try_divide(total(F.col(RATE) * F.col("w")), total(F.col("w"))), F.try_divide(total(F.col(RATE) * F.col("c")), total(F.col("c"))))


def _anomalies(counts: DataFrame, own: DataFrame, keys: tuple[str, ...], share: float | Column, kept: Column | None = None) -> DataFrame:
    """`own` (avg_rate and n of each key, and what `kept` needs) with n_anomalies."""
    odd = is_anomaly(F.col(RATE), F.col("avg_rate"), F.col("n"), share)
    rows = _with(counts.filter("c > 0"), own, keys).filter(odd if kept is None else odd & kept)
    found = rows.groupBy(*keys).agg(F.sum("c").alias("n_anomalies"))
    return _with(own, found, keys, "left").withColumn("n_anomalies", F.coalesce("n_anomalies", F.lit(0)))


def group_prices(df: DataFrame, *keys: str, share: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Weighted average, least, greatest, count and anomalies against the own average, a row per key (null is a key; no rates: zeros)."""
    c = rate_counts(df, *keys)
    zero = lambda x: F.coalesce(x, F.lit(0))
    own = c.groupBy(*keys).agg(zero(_average(F.col("c") > 0)).alias("avg_rate"), zero(F.min(RATE)).alias("min_rate"), zero(F.max(RATE)).alias("max_rate"), F.sum("c").alias("n"))
    return _anomalies(c, own, keys, share)


def four_dimensions(df: DataFrame) -> DataFrame:
    """group_prices by each of four keys at once; dim names the key, key its value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in DIMENSIONS])).alias("d"), RATE, "quantity")
    return group_prices(long.select("d.dim", "d.key", RATE, "quantity"), "dim", "key")


def _range(rate: Column) -> Column:
    """Number of the range of a rate: its leading eight bits and their place. Rising with the rate, below a hundredth of it wide."""
    size = F.abs(rate.cast("long"))
    bits = F.length(F.bin(size))
    own = F.when(size < 256, size).otherwise(bits * 256 + F.call_function("shiftright", size, F.greatest(bits - 8, F.lit(0))))
    return F.when(rate < 0, -own).otherwise(own)


def _ranges(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, _range, before (rows of the key in lower ranges), size (rows in it), n (rows of the key): some thousand rows a key at most."""
    own = Window.partitionBy(*keys)
    r = counts.filter(F.col(RATE).isNotNull()).groupBy(*keys, _range(F.col(RATE)).alias("_range")).agg(F.sum("c").alias("size"))
    upto = F.sum("size").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumns({"before": upto - F.col("size"), "n": F.sum("size").over(own)})


def _rates_at(counts: DataFrame, ranges: DataFrame, places: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row per key with, for each other column of `places` (places from 0 among the sorted rows of the key), the rate there."""
    names = [c for c in places.columns if c not in keys]
    each = places.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("long").alias("_place")) for c in names])))
    hit = _with(ranges, each, keys).filter((F.col("before") <= F.col("_place")) & (F.col("_place") < F.col("before") + F.col("size")))
    hit = hit.select(*keys, "_range", "_name", (F.col("_place") - F.col("before")).alias("_place"))
    inside = _with(counts.filter(F.col(RATE).isNotNull()).withColumn("_range", _range(F.col(RATE))), hit, (*keys, "_range"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "_range", "_name").orderBy(RATE).rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).filter((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("c") <= F.col("_place")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col(RATE))).alias(c) for c in names])


def _totals(ranges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return ranges.groupBy(*keys).agg(F.max("n").alias("n")).filter("n IS NOT NULL")


def _quarter(i: int, n: Column) -> Column:
    return F.floor(i * n / 4)


def index_quantiles(df: DataFrame, *keys: str) -> DataFrame:
    """q1, q2, q3 at places n//4, n//2, 3n//4 of the sorted rates; groups under four rows have none."""
    c = cut(rate_counts(df, *keys))
    ranges = _ranges(c, keys)
    n = _totals(ranges, keys)
    at = _rates_at(c, ranges, n.filter("n >= 4").select(*keys, *[_quarter(i, F.col("n")).alias(f"q{i}") for i in (1, 2, 3)]), keys)
    return _with(n, at, keys, "left") if keys else n.join(F.broadcast(at), F.lit(True), "left")


def _inside(q1: Column, q3: Column, n: Column) -> Column:
    return (n < TRIM_FROM) | F.col(RATE).between(q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1))


def trimmed(df: DataFrame, *keys: str) -> DataFrame:
    """Without outliers: from 8 rows on, rates within three interquartile ranges of the quartiles stay."""
    out = _with(df, index_quantiles(df, *keys).select(*keys, F.col("n").alias("_n"), F.col("q1").alias("_q1"), F.col("q3").alias("_q3")), keys)
    return out.filter(_inside(F.col("_q1"), F.col("_q3"), F.col("_n"))).select(*df.columns)


def kpis(df: DataFrame, *keys: str, share: float | Column = DEFAULT_THRESHOLD) -> DataFrame:
    """Per group (without keys: of all), outliers taken away first: rows, weighted average, least, greatest, index quartiles (the
    average under four rows), anomalies against the average; and the number of outliers. The counts of the rates are written once."""
    c = cut(rate_counts(df, *keys)).filter("c > 0")
    ranges = cut(_ranges(c, keys))
    n = _totals(ranges, keys)
    ends = _rates_at(c, ranges, n.select(*keys, _quarter(1, F.col("n")).alias("o1"), _quarter(3, F.col("n")).alias("o3")), keys)
    ends = _with(n.withColumnRenamed("n", "_all"), ends, keys)
    kept = _inside(F.col("o1"), F.col("o3"), F.col("_all"))
    own = _with(c, ends, keys).groupBy(*keys).agg(
        F.sum(F.when(kept, F.col("c"))).alias("n"), _average(kept).alias("avg_rate"), F.min(F.when(kept, F.col(RATE))).alias("min_rate"), F.max(F.when(kept, F.col(RATE))).alias("max_rate"),
        F.first("_all").alias("_all"), F.coalesce(F.sum(F.when(~kept & (F.col(RATE) < F.col("o1")), F.col("c"))), F.lit(0)).alias("_below"),
    )
    own = cut(own)
    at = _rates_at(c, ranges, own.select(*keys, *[(F.col("_below") + _quarter(i, F.col("n"))).alias(f"q{i}") for i in (1, 2, 3)]), keys)
    out = _with(_anomalies(c, own, keys, share, F.col(RATE).between(F.col("min_rate"), F.col("max_rate"))), at, keys)
    quart = [F.when(F.col("n") >= 4, F.col(f"q{i}").cast("double")).otherwise(F.col("avg_rate")).alias(f"q{i}") for i in (1, 2, 3)]
    return out.select(*keys, "n", (F.col("_all") - F.col("n")).alias("n_outliers"), "avg_rate", "min_rate", "max_rate", *quart, "n_anomalies")


def newest_first(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key and rate, newest period first."""
    w = Window.partitionBy(*keys, RATE).orderBy(F.col("price_period").desc_nulls_last(), "id")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def recent(df: DataFrame, today: Column, months: int, least: int, *keys: str) -> DataFrame:
    """Rows of the last months; groups with fewer than `least` of them keep all their rows."""
    new = F.col("price_period") >= F.add_months(F.trunc(today, "month"), -months)
    counts = df.groupBy(*keys).agg(F.count_if(new).alias("_recent")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_recent")
    return df.join(counts, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).filter(new | (F.col("_recent") < least)).select(*df.columns)


def histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins over all rates with their share; one bin when all are equal. Empty bins count 0."""
    ends = df.agg(F.min(RATE).alias("lo"), F.max(RATE).alias("hi"), F.count(RATE).alias("all"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") <= F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(RATE) - F.col("lo")) / width)))
    counts = df.filter(F.col(RATE).isNotNull()).join(F.broadcast(ends)).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    spine = ends.filter("lo IS NOT NULL").select("lo", "hi", "all", F.explode(F.sequence(F.lit(0), F.when(F.col("hi") <= F.col("lo"), 0).otherwise(bins - 1))).alias("bin"))
    out = spine.join(F.broadcast(counts), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_low"), "n", F.round(100 * F.col("n") / F.col("all"), 1).alias("pct"))


def summary_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Least, quartiles at round(p (n - 1)) with halves to the even place, greatest, and population deviation (without keys: of all)."""
    c = cut(rate_counts(df, *keys)).filter("c > 0")
    ranges = _ranges(c, keys)
    place = lambda p: F.bround(F.lit(p) * (F.col("n") - 1))
    at = _rates_at(c, ranges, _totals(ranges, keys).select(*keys, place(0.25).alias("q1"), place(0.5).alias("median"), place(0.75).alias("q3")), keys)
    whole = lambda x: F.sum(x.cast("decimal(38,0)"))
    one, two = whole(F.col(RATE) * F.col("c")), whole(F.col(RATE).cast("decimal(18,0)") * F.col(RATE).cast("decimal(18,0)") * F.col("c"))
    n = F.sum("c")
    spread = F.round(F.sqrt((n.cast("decimal(38,0)") * two - one * one).cast("double")) / n, 4)
    own = c.groupBy(*keys).agg(n.alias("n"), F.min(RATE).alias("min_rate"), F.max(RATE).alias("max_rate"), spread.alias("stddev"))
    return _with(own, at, keys).select(*keys, "n", "min_rate", "q1", "median", "q3", "max_rate", "stddev")


def monthly(df: DataFrame, last: Column, months: int = 12) -> DataFrame:
    """Counts of the last months with zeros for months without rows. last: one-row aggregate of the newest period."""
    end = df.agg(last.alias("_end"))
    spine = end.filter("_end IS NOT NULL").select(F.explode(F.sequence(F.add_months("_end", 1 - months), F.col("_end"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    counts = df.groupBy(F.trunc("price_period", "month").alias("month")).agg(F.count("*").alias("n"))
    return spine.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def baseline_difference(pairs: DataFrame, *keys: str) -> DataFrame:
    """pairs: price, base and the keys -> n, mean and median of the difference from the base price in percent."""
    off = F.abs(F.col("price") - F.col("base")) / F.col("base") * 100
    return pairs.filter("base > 0").groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(off), 3).alias("mean_diff"), F.round(F.median(off), 3).alias("median_diff"))


def complete_periods(df: DataFrame, key: str) -> DataFrame:
    """df with `period`: per period, over the keys that have a price in every period, how many they are, mean and median of their rates."""
    k = df.agg(F.countDistinct("period").alias("_k"))
    whole = df.groupBy(key).agg(F.countDistinct("period").alias("_n")).join(F.broadcast(k), F.col("_n") == F.col("_k"), "left_semi")  # one row
    rows = df.join(whole.select(key), key, "left_semi").withColumn(RATE, F.col(RATE).cast("long"))
    c = cut(rows.groupBy("period", RATE).agg(F.count("*").alias("c")))
    ranges = _ranges(c, ("period",))
    middle = _rates_at(c, ranges, _totals(ranges, ("period",)).select("period", F.floor((F.col("n") - 1) / 2).alias("lo"), F.floor(F.col("n") / 2).alias("hi")), ("period",))
    mean = c.groupBy("period").agg(F.round(F.sum(F.col(RATE) * F.col("c")) / F.sum("c"), 4).alias("mean_rate"))
    n = rows.groupBy("period").agg(F.countDistinct(key).alias("n_items"))
    return n.join(mean, "period").join(middle, "period").select("period", "n_items", "mean_rate", ((F.col("lo") + F.col("hi")) / 2).alias("median_rate"))
