"""Profiles of the bill, the mapping and the dictionary; each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codes import with_keys
from ..operators import matching, pricing, tree
from ..shared import cut
from ..sources import ingest
from .flow_queries import _LEAVES, _MAPPING, match_mapping
from .proxy import WITH_BOQ, WITH_KEYS, boq
from .work_queries import dictionary

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(f"""{WITH_KEYS}, l AS (SELECT unnest([{{'of': 'match_key_source', 'value': match_key_source}}, {{'of': 'item_code_version', 'value': item_code_version}}, {{'of': 'data_source_type', 'value': data_source_type}}, {{'of': 'match_key', 'value': match_key}}], recursive := true) FROM keyed)
SELECT "of", value, count(*) AS n, row_number() OVER (PARTITION BY "of" ORDER BY count(*) DESC, value)::INTEGER AS rank FROM l GROUP BY "of", value QUALIFY rank <= 20""")
def bill_profile(spark, sf):
    """Sources of keys, editions, types of data, and the twenty keys with most lines."""
    return tree.top_values(with_keys(boq(spark, sf)), ("match_key_source", "item_code_version", "data_source_type", "match_key"), 20)


@query(f"""{WITH_KEYS}, {_MAPPING} SELECT DISTINCT item_code_version AS version, code9 FROM keyed WHERE code9 <> '' AND (item_code_version, code9) NOT IN (SELECT (version, code9) FROM mapping)""")
def unmapped_codes(spark, sf):
    # a row per code from one pass over the bill: the codes in use and the mapping both come from it
    keyed = cut(with_keys(boq(spark, sf)).groupBy("item_code_version", "code9").agg(F.min("item_name").alias("item_name"))).filter("code9 <> ''")
    return ingest.unmapped_codes(keyed.select(F.col("item_code_version").alias("version"), "code9"), match_mapping(keyed))


@query("""WITH m AS (SELECT p_brand AS specialty, p_size % 6 AS t FROM part)
SELECT specialty, count(*) FILTER (WHERE t = 0) AS exact, count(*) FILTER (WHERE t = 1) AS synonym, count(*) FILTER (WHERE t = 2) AS contained, count(*) FILTER (WHERE t = 3) AS fuzzy, count(*) FILTER (WHERE t = 4) AS feature, count(*) FILTER (WHERE t = 5) AS "none",
 count(*) AS n, round(100.0 * count(*) FILTER (WHERE t <> 5) / count(*), 2) AS pct_matched FROM m GROUP BY 1""")
def match_rates_by_specialty(spark, sf):
    types = F.array(*[F.lit(t) for t in matching.MATCH_TYPES])
    m = read(spark, sf, "part").select(F.col("p_brand").alias("specialty"), F.get(types, F.col("p_size") % 6).alias("how"))
    return matching.match_pivot(m, "specialty")


@query(f"""{_LEAVES} SELECT a AS root_name, count(*) AS n_leaves, count(DISTINCT d) AS n_names FROM p GROUP BY a""")
def tree_roots(spark, sf):
    """Leaves and names below every root."""
    return tree.root_profile(dictionary(spark, sf)).select("root_name", "n_leaves", "n_names")


@query("""WITH l AS (SELECT unnest([{'of': 'unit', 'value': p_brand}, {'of': 'material', 'value': p_type}], recursive := true) FROM part)
SELECT "of", value, count(*) AS n, row_number() OVER (PARTITION BY "of" ORDER BY count(*) DESC, value)::INTEGER AS rank FROM l GROUP BY "of", value QUALIFY rank <= 15""")
def tree_values(spark, sf):
    """The fifteen most frequent units and materials (brands and types stand for them)."""
    nodes = read(spark, sf, "part").select(F.col("p_brand").alias("unit"), F.col("p_type").alias("material"))
    return tree.top_values(nodes)


_PRICED = "active AND data_source_type = 'completed' AND unit_rate_cents IS NOT NULL"


@query(f"""{WITH_BOQ}, p AS (SELECT item_name, CAST(date_trunc('year', price_period) AS DATE) AS period, unit_rate_cents FROM boq WHERE {_PRICED}),
k AS (SELECT item_name FROM p GROUP BY 1 HAVING count(DISTINCT period) = (SELECT count(DISTINCT period) FROM p))
SELECT period, count(DISTINCT item_name) AS n_items, round(avg(unit_rate_cents), 4) AS mean_rate, CAST(median(unit_rate_cents) AS DOUBLE) AS median_rate FROM p SEMI JOIN k USING (item_name) GROUP BY period""")
def complete_period_prices(spark, sf):
    """Mean and median of each year over the items that have a price in every year."""
    return pricing.complete_periods(pricing.priced(boq(spark, sf)).withColumn("period", F.trunc("price_period", "year")), "item_name")
