"""Queries over the flows: import, match and confirm, price analysis, search pages, dictionary upkeep; each with its DuckDB form."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import cables, codes, text
from ..operators import analysis, learning, matching, merge, pricing, quality, search, tree, validate
from ..shared import cut, kept
from ..sources import imports, ingest
from .price_queries import PRICED, _by_text
from .proxy import BOQ, WITH_BOQ, WITH_KEYS, boq
from .work_queries import _FOLD, confirmations, dictionary

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


# --- labels and single-row functions over the bill ---


@query(f"""{WITH_BOQ} SELECT CASE substr(item_code, 1, 2) WHEN '03' THEN '安装工程' WHEN '04' THEN '市政工程' WHEN '01' THEN '房屋建筑' WHEN '05' THEN '园林绿化' ELSE '其他' END AS major, count(*) AS n FROM boq GROUP BY 1""")
def major_labels(spark, sf):
    return boq(spark, sf).groupBy(codes.major(F.col("item_code")).alias("major")).agg(F.count("*").alias("n"))


@query(f"""{WITH_BOQ} SELECT item_code_version AS version, CASE WHEN (item_code_version IN ('2024', 'unknown') AND substr(item_code, 1, 6) IN ('030409')) OR (item_code_version IN ('2013', 'unknown') AND substr(item_code, 1, 6) = '030408') THEN '电线电缆'
 WHEN substr(item_code, 1, 6) = '031001' THEN '管道' END AS family, count(*) AS n FROM boq GROUP BY ALL""")
def big_family(spark, sf):
    b = boq(spark, sf)
    return b.groupBy(F.col("item_code_version").alias("version"), codes.big_family(F.col("item_code"), F.col("item_code_version")).alias("family")).agg(F.count("*").alias("n"))


@query(f"""{WITH_BOQ} SELECT unit, CASE unit WHEN '米' THEN 'm' WHEN '立方米' THEN 'm³' ELSE unit END AS symbol, CASE unit WHEN 'm2' THEN '平方米' ELSE unit END AS word, count(*) AS n FROM boq GROUP BY ALL""")
def unit_symbols(spark, sf):
    return boq(spark, sf).groupBy("unit", text.unit_symbol(F.col("unit")).alias("symbol"), text.clean_unit(F.col("unit")).alias("word")).agg(F.count("*").alias("n"))


@query(f"""{WITH_KEYS} SELECT CASE WHEN std_name IS NOT NULL THEN '已标准化' WHEN match_key_source IN ('code', 'raw') THEN '编码待核' ELSE '未标准化' END AS status, strftime(price_period, '%Y-%m') AS month, count(*) AS n FROM keyed GROUP BY ALL""")
def row_status(spark, sf):
    k = codes.with_keys(boq(spark, sf))
    return k.groupBy(text.status_label(F.col("std_name"), F.col("match_key_source")).alias("status"), text.month(F.col("price_period")).alias("month")).agg(F.count("*").alias("n"))


@query(f"""{WITH_BOQ}, l AS (SELECT id, unnest(['item_name', 'quantity', 'std_name', 'anomaly_flag', 'data_source_type', 'active', 'province']) AS field FROM boq)
SELECT CASE WHEN field IN ('item_name', 'quantity') THEN 'A' WHEN field IN ('std_name', 'anomaly_flag', 'data_source_type') THEN 'B' WHEN field = 'active' THEN 'C' ELSE 'unknown' END AS layer, count(*) AS n FROM l GROUP BY 1""")
def field_layers(spark, sf):
    names = F.array(*[F.lit(f) for f in ("item_name", "quantity", "std_name", "anomaly_flag", "data_source_type", "active", "province")])
    return boq(spark, sf).select(F.explode(names).alias("field")).groupBy(merge.layer(F.col("field")).alias("layer")).agg(F.count("*").alias("n"))


@query("""SELECT event_id AS id, CASE WHEN v >= 90 THEN 'A' WHEN v >= 75 THEN 'B' WHEN v >= 60 THEN 'C' ELSE 'D' END AS band FROM (SELECT event_id, value % 100 AS v FROM events)""")
def confidence_bands(spark, sf):
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), matching.confidence(F.col("value") % 100).alias("band"))


@query("""SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_attributes(spark, sf):
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), F.element_at(text.attributes(F.col("props")), "k").cast("long").alias("k"))


_CABLE = "(CASE l_partkey % 4 WHEN 0 THEN 'WDZA-YJY ' WHEN 1 THEN 'zr-yjv22 ' WHEN 2 THEN 'NH-YJV ' ELSE 'BVR ' END || CAST(l_suppkey % 5 + 1 AS VARCHAR) || '×' || CAST(CAST(l_quantity AS BIGINT) * 2 AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '+1x16' ELSE '' END)"
_CABLE_SQL = f"""WITH c AS (SELECT {_CABLE} AS spec, count(*) AS n FROM lineitem GROUP BY 1), u AS (SELECT *, replace(replace(upper(spec), '×', '*'), ' ', '') AS s0 FROM c), t AS (SELECT *, replace(s0, 'X', '*') AS s FROM u)"""


@query(f"""{_CABLE_SQL}, p AS (SELECT *, CAST(regexp_extract(s, '(\\d+)\\*(\\d+)', 1) AS DOUBLE) AS a, CAST(regexp_extract(s, '(\\d+)\\*(\\d+)', 2) AS DOUBLE) AS b, contains(s, '+1*16') AS two FROM t)
SELECT spec, n, CASE WHEN contains(s, 'WDZA') THEN 'A级' WHEN contains(s, 'ZR') THEN 'C级' END AS grade, contains(s, 'NH') AS fire, contains(s, 'WDZ') AS halogen_free, contains(s, '22') OR contains(s, '23') AS armoured,
 CASE WHEN contains(s, 'YJ') THEN '交联聚乙烯(XLPE)' ELSE '聚氯乙烯(PVC)' END AS insulation, b AS section, a * b + CASE WHEN two THEN 16 ELSE 0 END AS total_section, CASE WHEN b <= 10 THEN '<=10' WHEN b <= 50 THEN '16-50' WHEN b <= 120 THEN '70-120' ELSE '>=150' END AS bucket FROM p""")
def cable_features(spark, sf):
    """Features of the cable specs that the lines' numbers make."""
    specs = read(spark, sf, "lineitem").groupBy(F.expr(_CABLE.replace("VARCHAR", "STRING")).alias("spec")).agg(F.count("*").alias("n"))
    f = specs.withColumn("f", cables.cable_features(F.col("spec")))
    return f.select("spec", "n", *[f"f.{c}" for c in ("grade", "fire", "halogen_free", "armoured", "insulation", "section", "total_section")], cables.section_bucket(F.col("f.section")).alias("bucket"))


@query(f"""WITH l AS (SELECT {_CABLE} AS spec, l_extendedprice, l_quantity, l_orderkey FROM lineitem), t AS (SELECT spec, replace(replace(replace(upper(spec), '×', '*'), ' ', ''), 'X', '*') AS s, round(avg(l_extendedprice / l_quantity), 4) AS price FROM l GROUP BY ALL),
p AS (SELECT *, CAST(regexp_extract(s, '(\\d+)\\*(\\d+)', 2) AS DOUBLE) AS section FROM t),
g AS (SELECT *, CASE WHEN section <= 10 THEN '<=10' WHEN section <= 50 THEN '16-50' WHEN section <= 120 THEN '70-120' ELSE '>=150' END AS bucket FROM p),
d AS (SELECT a.bucket, abs(a.price - b.price) / b.price * 100 AS diff FROM g a JOIN g b ON regexp_extract(a.s, '(\\d+\\*\\d+)', 1) = regexp_extract(b.s, '(\\d+\\*\\d+)', 1) AND a.s <> b.s AND b.s LIKE 'BVR%')
SELECT bucket, count(*) AS n, round(avg(diff), 3) AS mean_diff, round(median(diff), 3) AS median_diff FROM d GROUP BY bucket""")
def baseline_difference(spark, sf):
    """How far prices of other models of the same cores are from those of the plain wire, by section group."""
    li = read(spark, sf, "lineitem")
    p = li.groupBy(F.expr(_CABLE.replace("VARCHAR", "STRING")).alias("spec")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("price"))
    p = cut(p.select("price", text.canonical_spec(F.col("spec")).alias("s"), cables.cable_features(F.col("spec"))["section"].alias("section")).withColumn("core", F.regexp_extract("s", r"(\d+\*\d+)", 1)))
    base = p.filter(F.col("s").startswith("BVR")).select("core", F.col("s").alias("base_s"), F.col("price").alias("base"))
    return pricing.baseline_difference(p.join(base, "core").filter("s <> base_s").withColumn("bucket", cables.section_bucket(F.col("section"))), "bucket")


# --- price analysis ---

_TODAY = datetime.date(1998, 9, 15)
_POOL = f"""{WITH_KEYS}, f AS (SELECT *, CASE WHEN std_name IN ('电线电缆', '管道', '钢筋', '水泥', '混凝土', '配管配线') THEN std_name WHEN item_code_version IN ('2013', '2024') THEN coalesce(
 CASE WHEN item_code_version = '2013' AND substr(item_code,1,6) = '030408' AND substr(item_code,1,9) NOT IN ('030408006','030408007') THEN '电线电缆'
 WHEN item_code_version = '2013' AND substr(item_code,1,6) = '010515' THEN '钢筋' WHEN substr(item_code,1,6) = '010502' THEN '混凝土'
 WHEN item_code_version = '2024' AND substr(item_code,1,6) = '030409' AND substr(item_code,1,9) NOT IN ('030409003','030409004','030409005') THEN '电线电缆'
 WHEN item_code_version = '2024' AND substr(item_code,1,6) = '031001' AND substr(item_code,1,9) <> '031001010' THEN '管道' END, {_by_text("item_name", "(item_name || ' ' || item_feature)")}) END AS family FROM keyed WHERE {PRICED}),
g AS (SELECT *, 'regex:' || family || ':' || CASE family WHEN '电线电缆' THEN '电线电缆(未识别)' WHEN '钢筋' THEN '钢筋_未识别' WHEN '管道' THEN '管道(未识别)' ELSE family END AS group_id FROM f WHERE family IS NOT NULL),
p AS (SELECT * FROM g WHERE price_period >= DATE '1998-09-01' - 183 OR (SELECT count(*) FROM g WHERE price_period >= DATE '1998-09-01' - 183) < 3),
d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY group_id, unit_rate_cents ORDER BY price_period DESC NULLS LAST, id) = 1),
r AS (SELECT *, row_number() OVER (ORDER BY unit_rate_cents, id) AS rn, count(*) OVER () AS n FROM d), q AS (SELECT max(CASE WHEN rn = n // 4 + 1 THEN unit_rate_cents END) AS q1, max(CASE WHEN rn = 3 * n // 4 + 1 THEN unit_rate_cents END) AS q3 FROM r),
t AS (SELECT r.* FROM r, q WHERE n < 8 OR unit_rate_cents BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)),
k AS (SELECT CAST(sum(unit_rate_cents * quantity) AS DOUBLE) / sum(quantity) AS a, count(*) AS n FROM t)"""


def _analysis(spark, sf):
    return analysis.price_analysis(codes.with_keys(boq(spark, sf)), F.lit(_TODAY), months=6)


@query(f"""{_POOL} SELECT (SELECT n FROM k) AS n, (SELECT count(*) FROM d) - (SELECT n FROM k) AS n_outliers, (SELECT a FROM k) AS avg_rate, (SELECT min(unit_rate_cents) FROM t) AS min_rate, (SELECT max(unit_rate_cents) FROM t) AS max_rate,
 (SELECT count(*) FROM t, k WHERE abs(t.unit_rate_cents - a) > 0.3 * abs(a)) AS n_anomalies, (SELECT round(100 * stddev_pop(unit_rate_cents) / (SELECT a FROM k), 1) FROM d) AS cv_pct""")
def price_analysis_kpis(spark, sf):
    return _analysis(spark, sf).kpis.select("n", "n_outliers", "avg_rate", "min_rate", "max_rate", "n_anomalies", "cv_pct")


@query(f"""{_POOL}, w AS (SELECT group_id, unit_rate_cents, count(*) OVER x AS c, CAST(sum(unit_rate_cents * quantity) OVER x AS DOUBLE) / sum(quantity) OVER x AS avg_rate FROM d WINDOW x AS (PARTITION BY group_id))
SELECT group_id, max(avg_rate) AS avg_rate, min(unit_rate_cents) AS min_rate, max(unit_rate_cents) AS max_rate, count(*) AS n, count(*) FILTER (WHERE c >= 3 AND abs(unit_rate_cents - avg_rate) > 0.3 * abs(avg_rate)) AS n_anomalies,
 (SELECT count(*) FROM p WHERE p.group_id = w.group_id) AS n_lines, round((max(avg_rate) - (SELECT a FROM k)) / (SELECT a FROM k) * 100, 1) AS deviation FROM w GROUP BY group_id""")
def price_analysis_groups(spark, sf):
    return _analysis(spark, sf).groups


@query(f"""{_POOL} SELECT price_period, CAST(sum(unit_rate_cents * quantity) AS DOUBLE) / sum(quantity) AS avg_rate, min(unit_rate_cents) AS min_rate, max(unit_rate_cents) AS max_rate, count(*) AS n FROM d GROUP BY price_period""")
def price_analysis_trend(spark, sf):
    return _analysis(spark, sf).trend.select("price_period", "avg_rate", "min_rate", "max_rate", "n")


@query(f"{_POOL} SELECT id, unit_rate_cents, price_period FROM p WHERE family = '管道' AND group_id = 'regex:管道:管道(未识别)'")
def price_samples(spark, sf):
    """The lines behind one shown group, none left out."""
    return analysis.samples(_analysis(spark, sf).pool, "管道", "管道(未识别)").select("id", "unit_rate_cents", "price_period")


@query(f"""{_POOL}, m AS (SELECT count(*) AS n, avg(CASE WHEN material_dict_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN anomaly_flag <> 'normal' THEN 1.0 ELSE 0.0 END) AS anomaly_rate FROM p)
SELECT n, round(coverage, 6) AS coverage, round(anomaly_rate, 6) AS anomaly_rate, coverage >= 0.8 AND anomaly_rate < 0.1 AS passes FROM m""")
def price_analysis_gate(spark, sf):
    return _analysis(spark, sf).gate.select("n", F.round("coverage", 6).alias("coverage"), F.round("anomaly_rate", 6).alias("anomaly_rate"), "passes")


@query("""WITH e AS (SELECT event_id AS id, event_type AS category, value FROM events) SELECT id, CAST(CASE category WHEN 'click' THEN 0.9 WHEN 'view' THEN 0.5 ELSE 0.3 END AS DOUBLE) AS share FROM e""")
def category_thresholds(spark, sf):
    kinds = F.when(F.col("event_type") == "click", "电线电缆").when(F.col("event_type") == "view", "钢筋").otherwise("门窗")
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), pricing.threshold(kinds).alias("share"))


# --- search pages ---


@query(f"""{WITH_BOQ}, s AS (SELECT *, row_number() OVER (PARTITION BY import_batch_id ORDER BY id) AS sequence FROM boq), f AS (SELECT * FROM s WHERE active AND province >= 'C') SELECT id, import_batch_id, sequence, 3 AS page, (SELECT count(*) FROM f) AS total FROM f ORDER BY import_batch_id DESC, sequence, id LIMIT 40 OFFSET 80""")
def search_page(spark, sf):
    """The third page of forty rows of a filtered bill."""
    rows = boq(spark, sf, sequence=True).filter(search.domain([("province", ">=", "C")]))
    return search.page(rows, 3, 40).select("id", "import_batch_id", "sequence", "page", F.col("total"))


@query(f"""{WITH_BOQ}, f AS (SELECT * FROM boq WHERE item_code LIKE '03%' AND contains(item_name, 'rod') AND data_source_type = 'completed' AND anomaly_flag = 'normal' AND std_name IS NULL)
SELECT count(*) AS total, count(std_name) AS n_standard, count(*) - count(std_name) AS n_pending, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM f""")
def search_counts(spark, sf):
    return search.counts(search.narrowed(boq(spark, sf), major="03", name="rod", source="completed", anomaly="normal", state="pending"), 50)


@query(f"""{WITH_BOQ}, f AS (SELECT * FROM boq WHERE contains(item_code, '0502') AND std_name IS NOT NULL) SELECT id, item_name FROM f ORDER BY item_name, id DESC LIMIT 100""")
def search_by_name(spark, sf):
    """The first page in the order of names."""
    return search.page(search.narrowed(boq(spark, sf), code="0502", only_std=True), 0, 100, "name").select("id", "item_name")


@query(f"""{WITH_KEYS}, p AS (SELECT * FROM keyed WHERE {PRICED}), c AS (SELECT match_key, count(*) AS n FROM p GROUP BY 1), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY price_period DESC, id DESC) = 1)
SELECT c.match_key, n FROM c JOIN l ON c.match_key = l.match_key WHERE contains(lower(item_name), 'bolt') OR contains(lower(c.match_key), 'bolt') ORDER BY c.match_key DESC LIMIT 50 OFFSET 50""")
def catalog_search(spark, sf):
    catalog = quality.catalog(pricing.priced(codes.with_keys(boq(spark, sf))))
    return search.catalog_page(catalog, "bolt", 2, 50).select("match_key", "n")


def batches(spark, sf):
    """A batch per residue of the orders: name, archive path, period, source type, whether it is active."""
    b = read(spark, sf, "orders").groupBy((F.col("o_orderkey") % 50).alias("import_batch_id")).agg(F.min("o_orderdate").cast("date").alias("first"))
    k = F.col("import_batch_id").cast("string")
    return b.select(
        "import_batch_id", F.concat(F.lit("batch "), k).alias("name"), F.concat(F.lit("/archive/"), k).alias("archive_path"), F.trunc("first", "month").alias("price_period"),
        F.when(F.col("import_batch_id") % 3 == 0, "pending_review").otherwise("completed").alias("data_source_type"), (F.col("import_batch_id") % 7 != 0).alias("active"),
    )


_BATCHES = "batches AS (SELECT o_orderkey % 50 AS import_batch_id, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS price_period FROM orders GROUP BY 1)"


@query(f"{WITH_BOQ}, {_BATCHES} SELECT 'batch ' || CAST(import_batch_id AS VARCHAR) AS batch_name, '/archive/' || CAST(import_batch_id AS VARCHAR) AS archive_path, count(*) AS n FROM boq GROUP BY ALL")
def provenance(spark, sf):
    return search.with_source(boq(spark, sf), batches(spark, sf)).groupBy("batch_name", "archive_path").agg(F.count("*").alias("n"))


@query(f"""{WITH_BOQ}, {_BATCHES}, p AS (SELECT * FROM batches ORDER BY import_batch_id DESC LIMIT 20) SELECT p.import_batch_id, count(id) FILTER (WHERE active) AS n_items, count(id) FILTER (WHERE active AND anomaly_flag <> 'normal') AS n_anomalies FROM p LEFT JOIN boq USING (import_batch_id) GROUP BY 1""")
def batch_list(spark, sf):
    return search.batch_list(batches(spark, sf), boq(spark, sf)).select("import_batch_id", "n_items", "n_anomalies")


@query(f"""{WITH_BOQ}, {_BATCHES} SELECT (SELECT count(*) FROM batches WHERE import_batch_id % 7 <> 0) AS n_batches, (SELECT count(*) FROM batches WHERE import_batch_id % 7 = 0) AS n_recycled, count(*) AS n_items,
 count(*) FILTER (WHERE anomaly_flag <> 'normal') AS n_anomalies, round(count(*) FILTER (WHERE anomaly_flag <> 'normal') / count(*), 6) AS anomaly_rate FROM boq WHERE active""")
def batch_kpis(spark, sf):
    return quality.batch_kpis(boq(spark, sf), batches(spark, sf)).withColumn("anomaly_rate", F.round("anomaly_rate", 6))


@query(f"""{WITH_BOQ} SELECT count(*) AS n, round(100 * count(std_name) / count(*), 1) AS pct_standard, round(100 * count(unit_rate_cents) / count(*), 1) AS pct_priced, round(100 * count(material_dict_id) / count(*), 1) AS pct_linked,
 count(*) - count(std_name) AS todo_standard, count(*) - count(material_dict_id) AS todo_linked, count(*) FILTER (WHERE anomaly_flag <> 'normal') AS todo_anomalies FROM boq WHERE active""")
def progress(spark, sf):
    return quality.progress(boq(spark, sf)).select("n", "pct_standard", "pct_priced", "pct_linked", "todo_standard", "todo_linked", "todo_anomalies")


@query(f"""{WITH_BOQ}, {_BATCHES} SELECT (SELECT count(*) FROM batches WHERE import_batch_id % 7 <> 0 AND import_batch_id % 3 = 0) AS n_batches, count(*) AS n_items, count(DISTINCT item_name) AS n_names FROM boq WHERE active AND material_dict_id IS NULL""")
def nav_badges(spark, sf):
    return search.badges(boq(spark, sf), batches(spark, sf))


@query(f"""{WITH_BOQ}, l AS (SELECT * FROM boq) SELECT 'std_name' AS field, count(*) AS n, round(count(std_name) / count(*), 6) AS share FROM l UNION ALL SELECT 'material_dict_id', count(*), round(count(material_dict_id) / count(*), 6) FROM l UNION ALL SELECT 'anomaly_flag', count(*), 1.0 FROM l""")
def filled_share(spark, sf):
    return quality.filled_share(boq(spark, sf), ["std_name", "material_dict_id", "anomaly_flag"]).withColumn("share", F.round("share", 6))


@query(f"""{WITH_BOQ}, {_BATCHES} SELECT import_batch_id, CASE WHEN import_batch_id % 4 = 0 THEN DATE '2020-05-01' ELSE price_period END AS price_period, count(*) AS n FROM (SELECT b.import_batch_id, batches.price_period FROM boq b JOIN batches USING (import_batch_id)) GROUP BY ALL""")
def batch_changes(spark, sf):
    """New periods for some batches, carried over to their items."""
    b = batches(spark, sf)
    period = F.when(F.col("import_batch_id") % 4 == 0, F.when(F.col("import_batch_id") % 8 == 0, "2020-05").otherwise("2020-05-17")).otherwise("soon")
    changes = b.select("import_batch_id", F.lit(None).cast("string").alias("name"), period.alias("period"), F.lit(None).cast("string").alias("data_source_type"))
    return merge.cascade(boq(spark, sf), merge.change_batches(b, changes)).groupBy("import_batch_id", "price_period").agg(F.count("*").alias("n"))


_TAGGED = "t AS (SELECT user_id, event_id % 7 AS tag_id, event_id AS item, ts FROM events WHERE event_type = 'click'), c AS (SELECT c_custkey FROM customer)"


@query(f"WITH {_TAGGED} SELECT c_custkey AS id, 'tag ' || CAST(tag_id AS VARCHAR) AS tag, ts AS tagged_at FROM t JOIN c ON item % (SELECT count(*) FROM c) = c_custkey WHERE user_id = 12")
def tagged_items(spark, sf):
    """Rows that a user has tagged (customers stand for items, clicks for tags)."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    n = read(spark, sf, "customer").count()
    e = read(spark, sf, "events").filter("event_type = 'click'")
    links = e.select((F.col("event_id") % n).alias("item_id"), (F.col("user_id") * 10 + F.col("event_id") % 7).alias("tag_id"), F.col("ts").alias("tagged_at"))
    tags = e.select("user_id", (F.col("user_id") * 10 + F.col("event_id") % 7).alias("tag_id"), F.concat(F.lit("tag "), (F.col("event_id") % 7).cast("string")).alias("name")).distinct()
    return search.tagged(c, links, tags, 12).select("id", "tag", "tagged_at")


# --- import ---


@query(f"""WITH l AS (SELECT l_orderkey % 50 AS batch, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
k AS (SELECT *, CASE WHEN l_partkey % 41 = 0 THEN 'blank' WHEN l_partkey % 37 = 0 THEN 'summary' WHEN l_partkey % 31 = 0 THEN 'structure' ELSE 'line' END AS kind FROM l)
SELECT 'batch ' || CAST(batch AS VARCHAR) AS path, count(*) FILTER (WHERE kind = 'line') AS n_lines, count(*) FILTER (WHERE kind IN ('blank', 'structure')) AS n_skipped, count(*) FILTER (WHERE kind = 'line' AND (l_suppkey % 6 = 5 OR l_partkey % 29 = 0)) AS n_warnings,
 sum(CASE WHEN kind = 'line' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END)::BIGINT AS total_cents FROM k GROUP BY batch""")
def import_report(spark, sf):
    """Files made of the lines, with summary, structure and blank rows among them: what the import finds."""
    li = read(spark, sf, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    line = ~((p % 41 == 0) | (p % 37 == 0) | (p % 31 == 0))
    name = F.when(p % 41 == 0, " ").when(p % 37 == 0, "本页小计").otherwise(F.concat(F.lit("part "), p.cast("string")))
    number = lambda c: F.when(line | (p % 37 == 0), F.concat(F.lit(" ￥"), F.format_number(c, 2)))
    records = li.select(
        F.concat(F.lit("batch "), (F.col("l_orderkey") % 50).cast("string")).alias("path"), F.expr("xxhash64(l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("row"), name.alias("item_name"),
        F.when(line, F.lpad(p.cast("string"), 9, "0")).alias("item_code"), F.when(line, F.when(s % 6 == 5, "樘").otherwise("Ｍ2")).alias("unit"),
        F.when(line, F.when(p % 29 == 0, "many").otherwise(F.col("l_quantity").cast("string"))).alias("quantity"), number(F.col("l_extendedprice")).alias("total"),
    )
    return imports.report(imports.judged(records)).select("path", "n_lines", "n_skipped", "n_warnings", "total_cents")


@query(f"""{WITH_BOQ}, v AS (SELECT id, unit_rate_cents <= 0 OR data_source_type = 'pending_review' OR abs(total_cents - quantity * unit_rate_cents) / CAST(quantity * unit_rate_cents AS DOUBLE) > 0.00001 AS bad FROM boq)
SELECT (SELECT count(*) FROM boq) AS total_rows, (SELECT count(*) FROM boq) - count(DISTINCT id) FILTER (WHERE bad) AS valid_rows, NOT bool_or(coalesce(bad, false)) AS can_import FROM v""")
def import_gate(spark, sf):
    """Whether the bill may be imported, and how many of its rows break no rule of level error."""
    return validate.summary(boq(spark, sf), validate.BILL_RULES).select("total_rows", "valid_rows", "can_import")


@query(f"""{WITH_BOQ}, s AS (SELECT import_batch_id, sum(total_cents)::BIGINT AS total_cents FROM boq GROUP BY 1), t AS (SELECT *, CASE WHEN import_batch_id % 5 <> 0 THEN CAST(round(total_cents * CASE WHEN import_batch_id % 2 = 0 THEN 1.0005 ELSE 1.01 END) AS BIGINT) END AS stated FROM s)
SELECT import_batch_id, total_cents, stated AS stated_cents, abs(total_cents - stated) <= 1 OR abs(total_cents - stated) <= 0.001 * abs(stated) AS agrees FROM t""")
def batch_reconcile(spark, sf):
    s = boq(spark, sf).groupBy("import_batch_id").agg(F.sum("total_cents").alias("total_cents"))
    stated = s.filter("import_batch_id % 5 <> 0").select("import_batch_id", F.round(F.col("total_cents") * F.when(F.col("import_batch_id") % 2 == 0, 1.0005).otherwise(1.01)).cast("long").alias("total_cents"))
    return quality.reconciled(s, stated).select("import_batch_id", "total_cents", "stated_cents", "agrees")


@query(f"""WITH {BOQ}, c AS (SELECT DISTINCT item_code_version AS version, substr(item_code, 1, 9) AS code9 FROM boq WHERE item_code_version <> 'unknown' AND item_code LIKE '0%')
SELECT version, code9, CASE WHEN code9 LIKE '%3' THEN '水泥' WHEN (version = '2024' AND code9 LIKE '030409%') OR (version = '2013' AND code9 LIKE '030408%') THEN '电线电缆' ELSE '管道' END AS name, CASE WHEN code9 LIKE '%3' THEN 'human' ELSE 'class' END AS match_type
FROM c WHERE code9 LIKE '%3' OR (version = '2024' AND code9 LIKE '030409%') OR (version = '2013' AND code9 LIKE '030408%') OR code9 LIKE '031001%'""")
def mapping_rebuild(spark, sf):
    """The mapping derived from the sections of the standard, with names that people set for some codes."""
    v = F.col("item_code_version")
    c = boq(spark, sf).filter("item_code_version <> 'unknown' AND item_code LIKE '0%'").select(v.alias("version"), F.substring("item_code", 1, 9).alias("code")).distinct()
    classes = c.withColumn("section", codes.section_of(F.col("code"), F.col("version")))
    people = c.filter("code LIKE '%3'").select("version", F.col("code").alias("code9"), F.lit("水泥").alias("name"))
    return ingest.rebuild_mapping(classes, people).select("version", "code9", "name", "match_type")


# --- match and confirm ---


def pool_nodes(spark, sf):
    """The dictionary down to level four, as deep as pools go, with paths and, for level four, the size as spec."""
    nodes = cut(dictionary(spark, sf, 4))
    c = tree.chains(nodes, ["name"], 4)
    size = F.when(F.col("level") == "l4", F.element_at(F.split(F.element_at("name", -1), " "), -1)).otherwise(F.lit(""))
    return cut(c.select("id", "level", F.array_join("name", "/").alias("path"), F.element_at("name", -1).alias("node"), size.alias("spec")).withColumnRenamed("node", "name"))


def match_items(spark, sf):
    return _named(codes.with_keys(boq(spark, sf)))


def _named(b):
    return b.withColumns({"name": F.col("item_name"), "spec": F.regexp_extract("item_feature", "规格:(.*)$", 1)})


def match_mapping(keyed):
    """Codes of an even number with the name of their family, for each edition.

    The least of texts is found by sorting, so that equal lines are counted into one first (a plain distinct is optimised away).
    """
    rows = keyed.groupBy("item_code_version", "code9", "item_name").agg(F.count("*").alias("_n")).filter("_n > 0").filter("code9 RLIKE '^[0-9]{9}$' AND CAST(substring(code9, 7, 3) AS INT) % 2 = 0")
    return rows.groupBy(F.col("item_code_version").alias("version"), "code9").agg(F.min("item_name").alias("name")).withColumn("id", F.xxhash64("version", "code9"))


_MAPPING = "mapping AS (SELECT item_code_version AS version, code9, min(item_name) AS name FROM keyed WHERE regexp_matches(code9, '^[0-9]{9}$') AND CAST(substr(code9, 7, 3) AS INTEGER) % 2 = 0 GROUP BY ALL)"

@query()
def prematch_top5(spark, sf):
    """The five best nodes of the dictionary for every unlinked line, or the category of its code; tested against brute force on a small bill."""
    bill = codes.with_keys(boq(spark, sf)).select("id", "active", "material_dict_id", "item_code_version", "item_name", "item_feature", "code9")
    items = _named(kept(bill, "items"))  # specs are taken out of the lines that ask for them only
    out = matching.prematch(items, matching.candidate_pool(pool_nodes(spark, sf)), match_mapping(items))
    return out.select("id", F.size("candidates").alias("n"), F.array_join(F.transform("candidates", lambda c: c["name"]), ";").alias("names"), "top_score")


@query(f"""{WITH_KEYS}, {_MAPPING}, n AS (SELECT DISTINCT p_name FROM part)
SELECT k.id, m.name AS std_name FROM keyed k JOIN mapping m ON k.item_code_version = m.version AND k.code9 = m.code9 JOIN n ON n.p_name = m.name WHERE k.active AND k.material_dict_id IS NULL""")
def auto_confirm(spark, sf):
    """Lines that are linked without asking: the code maps to the exact name of a node."""
    items = cut(match_items(spark, sf).select("id", "active", "material_dict_id", "item_code_version", "item_name", "code9"))
    sure = matching.auto_confirmed(items, match_mapping(items), pool_nodes(spark, sf))
    return sure.select("id", F.col("name").alias("std_name"))


@query(f"""{WITH_KEYS}, {_MAPPING}, o AS (SELECT * FROM keyed WHERE active AND material_dict_id IS NULL)
SELECT o.id, o.part % 3 = 0 AS from_cache, CASE WHEN o.part % 3 = 0 THEN 2 WHEN m.name IS NULL THEN 0 ELSE 1 END AS n, CASE WHEN o.part % 3 = 0 THEN 'a;b' ELSE coalesce(m.name, '') END AS names FROM o LEFT JOIN mapping m ON o.item_code_version = m.version AND o.code9 = m.code9""")
def pending_matches(spark, sf):
    """What is shown for unlinked lines: stored matches of the last day (two names, one twice), else the category of the code."""
    items = cut(match_items(spark, sf).select("id", "active", "material_dict_id", "item_code_version", "item_name", "code9", "part"))
    now = F.lit("2026-01-02 12:00:00").cast("timestamp")
    one = lambda n, s: F.struct(F.lit(1).cast("long"), F.lit(n), F.lit(""), F.lit(s), F.lit(n), F.lit("match"))
    stored = F.array(one("a", 90.0), one("a ", 80.0), one("b", 70.0)).cast(f"array<{matching._CANDIDATE}>")
    at = F.when(F.col("part") % 3 == 0, F.lit("2026-01-02 00:00:00")).otherwise("2025-12-31 00:00:00").cast("timestamp")
    cache = items.filter("part % 3 <> 1").select("id", stored.alias("candidates"), at.alias("computed_at"))
    out = matching.pending(items, cache, match_mapping(items), now)
    return out.select("id", "from_cache", F.size("candidates").alias("n"), F.array_join(F.transform("candidates", lambda c: F.trim(c["name"])), ";").alias("names"))


@query(f"""{WITH_KEYS} SELECT id, 'dict:' || CAST(part + 1 AS VARCHAR) || '|' || unit_std AS match_key, coalesce(std_name, item_name) AS std_name FROM keyed WHERE material_dict_id IS NULL AND part % 10 = 0""")
def confirmed_matches(spark, sf):
    """Lines that were linked by hand: human fields filled where they are empty, keys worked out again."""
    b = codes.with_keys(boq(spark, sf))
    confirmed = b.filter("material_dict_id IS NULL AND part % 10 = 0").select("id", (F.col("part") + 1).alias("dict_id"), F.col("item_name").alias("name"), F.lit("s").alias("spec"))
    return merge.confirm_matches(b, confirmed).join(confirmed.select("id"), "id", "left_semi").select("id", "match_key", "std_name")


@query(f"""{WITH_KEYS} SELECT id, CASE WHEN part % 10 = 1 THEN NULL ELSE material_dict_id END AS material_dict_id, match_key_source FROM (SELECT id, part, material_dict_id, CASE WHEN part % 10 <> 1 THEN match_key_source WHEN std_name IS NOT NULL THEN 'std' WHEN code9 <> '' THEN 'code' ELSE 'raw' END AS match_key_source FROM keyed WHERE part % 10 = 1 AND material_dict_id IS NOT NULL)""")
def rekeyed(spark, sf):
    """Lines linked to nodes that are gone lose the link and get a new key."""
    b = codes.with_keys(boq(spark, sf))
    nodes = read(spark, sf, "part").filter("p_partkey % 10 <> 1").select(F.col("p_partkey").alias("id"))
    return merge.rekeyed(b, nodes).select("id", "material_dict_id", "match_key_source")


@query(f"""WITH t AS (SELECT event_id AS id, event_id % 5 = 0 AS exact, value % 100 AS s, event_id % 3 = 0 AS f FROM events), m AS (SELECT CASE WHEN exact THEN 'exact_name' WHEN s >= 85 THEN 'fuzzy_name' WHEN f THEN 'feature_match' WHEN s >= 75 THEN 'fuzzy_low' ELSE 'no_match' END AS how FROM t)
SELECT how, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM m), 2) AS pct FROM m GROUP BY how""")
def match_types(spark, sf):
    n = F.col("event_id")
    e = read(spark, sf, "events").select(matching.match_type(n % 5 == 0, F.col("value") % 100, n % 3 == 0).alias("how"))
    return matching.match_rates(e)


@query("""WITH d AS (SELECT dict_name, min(id) AS dict_id FROM (SELECT p_name AS dict_name, p_partkey AS id FROM part UNION ALL SELECT p_type, p_partkey FROM part) GROUP BY 1)
SELECT p_partkey AS item, dict_id, dict_name FROM part, d WHERE contains('of ' || p_brand || ', ' || lower(p_type) || ' ' || p_name || p_type, dict_name)""")
def feature_names(spark, sf):
    """Dictionary names inside feature texts, by equality with substrings."""
    part = read(spark, sf, "part")
    d = part.select(F.explode(F.array("p_name", "p_type")).alias("dict_name"), F.col("p_partkey").alias("dict_id"))
    texts = part.select(F.col("p_partkey").alias("item"), F.concat(F.lit("of "), "p_brand", F.lit(", "), F.lower("p_type"), F.lit(" "), "p_name", "p_type").alias("text"))
    return matching.contained_names(texts, d, "item", "text")


@query("""WITH u AS (SELECT DISTINCT p_name AS name, p_type FROM part) SELECT 'p_type' AS "of", p_type AS value, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT 'name_length', CAST(length(name) AS VARCHAR), count(*) FROM u GROUP BY ALL
UNION ALL SELECT 'word', w, count(*) FROM (SELECT name, unnest(['red', 'bolt', 'rod', 'zzz']) AS w FROM u) WHERE contains(name, w) GROUP BY ALL""")
def unmatched_profile(spark, sf):
    items = read(spark, sf, "part").select(F.col("p_name").alias("name"), "p_type").distinct()
    return matching.unmatched_profile(items, ["red", "bolt", "rod", "zzz"], "p_type")


@query(f"""{_FOLD}, l AS (SELECT category, n, w1, w2, w3 FROM s QUALIFY row_number() OVER (PARTITION BY category ORDER BY k DESC) = 1),
p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'purchase' ELSE p_type || '/' || p_brand END AS path FROM part)
SELECT p_partkey, round(coalesce(w1, 0.3), 3) AS w_edit, round(coalesce(w2, 0.35), 3) AS w_tfidf, round(coalesce(w3, 0.35), 3) AS w_vector FROM p LEFT JOIN l ON p.path = l.category""")
def weights_lookup(spark, sf):
    """Weights of categories with confirmations, and the overall ones for paths without."""
    p = F.col("p_partkey")
    path = F.when(p % 3 == 0, "click").when(p % 3 == 1, "purchase").otherwise(F.concat_ws("/", "p_type", "p_brand", F.lit("x")))
    out = learning.weights_for(read(spark, sf, "part").select("p_partkey", path.alias("path")), learning.replay(confirmations(spark, sf)))
    return out.select("p_partkey", *[F.round(f"w_{a}", 3).alias(f"w_{a}") for a in learning.ALGORITHMS])


# --- dictionary upkeep ---

_LEAVES = "WITH p AS (SELECT p_type AS a, p_brand AS b, p_name AS c, p_name || ' ' || CAST(p_size AS VARCHAR) AS d, CAST(p_partkey AS VARCHAR) AS e FROM part)"


@query(f"""{_LEAVES}, n AS (SELECT DISTINCT 'l1' AS level, a AS path, a AS name FROM p UNION ALL SELECT DISTINCT 'l2', a || b, b FROM p UNION ALL SELECT DISTINCT 'l3', a || b || c, c FROM p UNION ALL SELECT DISTINCT 'l4', a || b || c || d, d FROM p UNION ALL SELECT DISTINCT 'l5', a || b || c || d || e, e FROM p)
SELECT level, count(*) AS n, count(DISTINCT name) AS n_names FROM n GROUP BY level""")
def tree_profile(spark, sf):
    return tree.profile(dictionary(spark, sf))


@query(f"""{_LEAVES}, n AS (SELECT DISTINCT a, b, c FROM p) SELECT c AS name, count(*) AS n, count(DISTINCT a || '/' || b) AS n_parents FROM n GROUP BY c HAVING count(*) > 1""")
def tree_duplicates(spark, sf):
    """Names of level three that stand below several parents."""
    nodes = dictionary(spark, sf).filter("level = 'l3'")
    return tree.duplicates(nodes, ("name",)).filter("across").select("name", "n", "n_parents")


@query(f"""{_LEAVES}, n AS (SELECT DISTINCT a, b, c, d FROM p) SELECT 'l5' AS new_level, count(DISTINCT e) AS n FROM p UNION ALL SELECT 'l4', count(*) FROM n UNION ALL SELECT 'l3', count(*) FROM (SELECT DISTINCT a, b, c FROM n) UNION ALL SELECT 'l2', count(*) FROM (SELECT DISTINCT a, b FROM n) UNION ALL SELECT 'l1', count(DISTINCT a) FROM n""")
def tree_levels(spark, sf):
    """Levels found again from the roots after all of them were lost."""
    nodes = cut(dictionary(spark, sf).withColumn("level", F.lit("l9")))
    return tree.relevelled(nodes).groupBy("new_level").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 13 END AS old FROM part), r AS (SELECT old, row_number() OVER (ORDER BY old) AS level FROM (SELECT DISTINCT old FROM s)) SELECT id, r.level FROM s JOIN r USING (old)""")
def dense_levels(spark, sf):
    level = F.when(F.col("p_size") % 4 == 0, 2).when(F.col("p_size") % 4 == 1, 5).when(F.col("p_size") % 4 == 2, 7).otherwise(13)
    return tree.dense_levels(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), level.alias("level")))


@query(f"""{_LEAVES}, n AS (SELECT DISTINCT a, b, c, d FROM p) SELECT a || '/' || b || '/' || c || '/' || d AS path, count(*) AS n_leaves FROM p GROUP BY a, b, c, d""")
def tree_rebuild(spark, sf):
    """A tree of six levels brought to five: the leaves gather below their names."""
    part = read(spark, sf, "part")
    c = F.col
    deep = tree.build(part, [c("p_type"), c("p_brand"), c("p_name"), F.concat(F.lit("kind "), c("p_size").cast("string")), c("p_partkey").cast("string"), F.concat("p_name", F.lit(" "), c("p_size").cast("string"))])
    nodes = cut(tree.rebuilt(cut(deep)))
    return tree.descendants(nodes).join(nodes.filter("level = 'l4'").select("id"), "id", "left_semi").select("path", "n_leaves")


@query("""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'K-' || CAST(p_size AS VARCHAR) WHEN 1 THEN 'K' || CAST(p_partkey AS VARCHAR) ELSE 'K' || CAST(p_partkey AS VARCHAR) || '*' END AS code FROM part),
b AS (SELECT *, regexp_matches(code, '[^A-Za-z0-9]') AS dirty, regexp_replace(code, '[^A-Za-z0-9]', '', 'g') AS base FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY dirty, id) - 1 AS turn FROM b), n AS (SELECT id, code, CASE WHEN dirty AND turn > 0 THEN base || CAST(turn AS VARCHAR) ELSE base END AS try, dirty AND turn > 0 AS numbered FROM t)
SELECT id, CASE WHEN numbered AND try IN (SELECT code FROM c) THEN try || 'x' || CAST(id AS VARCHAR) ELSE try END AS new_code FROM n""")
def clean_codes(spark, sf):
    p = F.col("p_partkey")
    code = F.when(p % 3 == 0, F.concat(F.lit("K-"), F.col("p_size").cast("string"))).when(p % 3 == 1, F.concat(F.lit("K"), p.cast("string"))).otherwise(F.concat(F.lit("K"), p.cast("string"), F.lit("*")))
    return tree.clean_codes(read(spark, sf, "part").select(p.alias("id"), code.alias("code"), F.lit(None).cast("string").alias("parent_code"))).select("id", "new_code")


@query(f"""{_LEAVES}, k AS (SELECT DISTINCT a, b FROM p), r AS (SELECT a, row_number() OVER (ORDER BY a) AS i FROM (SELECT DISTINCT a FROM k)), o AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS j FROM k),
m AS (SELECT a, max(j) AS last FROM o GROUP BY a) SELECT 'I' || lpad(CAST(i AS VARCHAR), 3, '0') || lpad(CAST(last + 1 AS VARCHAR), 2, '0') AS code, m.a AS parent FROM m JOIN r USING (a)""")
def next_codes(spark, sf):
    """The next code of level two below every root."""
    codes_ = tree.recode(cut(dictionary(spark, sf)))
    have = cut(codes_.filter("level IN ('l1', 'l2')").select("level", "path", F.col("new_code").alias("code")))
    new = have.filter("level = 'l1'").select(F.col("code").alias("parent_code"), F.lit("new").alias("name"), F.col("path").alias("parent"))
    return tree.next_codes(new, have.filter("level = 'l2'"), 2).select("code", "parent")


@query(f"""{_LEAVES}, n AS (SELECT DISTINCT a, b, c FROM p WHERE contains(lower(c), 'rod')) SELECT a || '/' || b || '/' || c AS path FROM n UNION ALL SELECT a || '/' || b || '/' || c || '/' || d FROM (SELECT DISTINCT a, b, c, d FROM p WHERE contains(lower(d), 'rod'))""")
def tree_search(spark, sf):
    return tree.search_names(cut(dictionary(spark, sf)), "rod").select("path")


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, p_brand AS parent FROM part), c AS (SELECT event_id AS change_id, CASE event_id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS action, event_id % (SELECT 2 * count(*) FROM part) AS id FROM events)
SELECT 'no_node' AS problem, change_id FROM c WHERE action <> 'create' AND id NOT IN (SELECT id FROM n) UNION ALL SELECT 'no_parent', change_id FROM c WHERE action = 'create' UNION ALL SELECT 'in_use', change_id FROM c WHERE action = 'delete' AND id IN (SELECT DISTINCT l_partkey FROM lineitem)""")
def change_problems(spark, sf):
    """A change set against a flat dictionary: what may not be made."""
    part = read(spark, sf, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("l1").alias("level"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    n = F.col("event_id")
    changes = read(spark, sf, "events").select(
        n.alias("change_id"), F.when(n % 3 == 0, "create").when(n % 3 == 1, "update").otherwise("delete").alias("action"), (n % (2 * part.count())).alias("id"),
        F.lit(-1).cast("long").alias("parent_id"), F.lit("l2").alias("level"), F.concat(F.lit("new"), n.cast("string")).alias("name"),
    )
    return tree.change_problems(changes, nodes, read(spark, sf, "lineitem").select(F.col("l_partkey").alias("dict_id")))


@query("""SELECT CASE p_size % 5 WHEN 0 THEN '卷' WHEN 1 THEN '块' WHEN 2 THEN '吨' WHEN 3 THEN '' ELSE '台' END AS unit, count(*) AS n, p_size % 5 IN (0, 4) AS odd FROM part WHERE contains(p_name, 'bolt') GROUP BY ALL""")
def unit_outliers(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("卷", "块", "吨", " ", "台")]), (F.col("p_size") % 5 + 1).cast("int"))
    nodes = read(spark, sf, "part").select(F.col("p_name").alias("name"), unit.alias("unit"))
    return tree.unit_outliers(nodes, F.contains("name", F.lit("bolt")), ["块", "千块", "立方米", "平方米", "吨"])


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, p_brand AS parent, CASE p_size % 3 WHEN 0 THEN '卷' ELSE '块' END AS unit FROM part)
SELECT id, CASE WHEN unit = '卷' AND contains(name, 'bolt') THEN '个' WHEN unit = '卷' AND contains(name, 'rod') THEN '根' ELSE unit END AS unit FROM n WHERE id % 9 <> 0""")
def corrected_units(spark, sf):
    part = read(spark, sf, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("long").alias("parent_id"), F.lit("l5").alias("level"), F.when(F.col("p_size") % 3 == 0, "卷").otherwise("块").alias("unit"))
    rules = spark.createDataFrame([("bolt", "卷", "个"), ("rod", "卷", "根")], "word string, wrong_unit string, right_unit string")
    return tree.corrected(nodes, rules, nodes.filter("id % 9 = 0")).select("id", "unit")
