"""Queries over prices, keys, quality and classification, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..functions.codes import code_full, with_keys
from ..functions.text import unit_std, unit_unknown
from ..operators import pricing, quality, validate
from ..shared import cut
from .proxy import BOQ, KEYED, UNIT_STD, WITH_BOQ, WITH_KEYS, boq

QUERIES, ORACLE = {}, {}
PRICED = "active AND data_source_type = 'completed' AND unit_rate_cents IS NOT NULL"
AVG = "CAST(sum(unit_rate_cents * quantity) AS DOUBLE) / sum(quantity)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""{WITH_KEYS}, p AS (SELECT * FROM keyed WHERE {PRICED}),
g AS (SELECT match_key, {AVG} AS avg_rate, min(unit_rate_cents) AS min_rate, max(unit_rate_cents) AS max_rate, count(*) AS n FROM p GROUP BY match_key)
SELECT g.match_key, avg_rate, min_rate, max_rate, n,
 count(*) FILTER (WHERE n >= 3 AND avg_rate <> 0 AND abs(p.unit_rate_cents - avg_rate) > 0.3 * avg_rate) AS n_anomalies
FROM g JOIN p ON g.match_key = p.match_key GROUP BY ALL""")
def price_by_key(spark, sf):
    """What did this item cost before: every key."""
    return pricing.group_prices(pricing.priced(with_keys(boq(spark, sf))), "match_key")


@query(f"""{WITH_BOQ} SELECT unit, {UNIT_STD} AS unit_std, unit = '樘' AS unit_unknown, count(*) AS n FROM boq GROUP BY ALL""")
def unit_normalise(spark, sf):
    return boq(spark, sf).groupBy("unit", unit_std(F.col("unit")).alias("unit_std"), unit_unknown(F.col("unit")).alias("unit_unknown")).agg(F.count("*").alias("n"))


@query(f"""{WITH_KEYS} SELECT item_code, code9, CASE WHEN item_code IS NULL THEN '' WHEN item_code LIKE 'z%' THEN 'Z' || upper(substr(item_code, 2)) ELSE item_code END AS full_code,
 count(*) AS n FROM keyed GROUP BY ALL""")
def code_parse(spark, sf):
    return with_keys(boq(spark, sf)).groupBy("item_code", "code9", code_full(F.col("item_code")).alias("full_code")).agg(F.count("*").alias("n"))


@query(f"""{WITH_KEYS} SELECT match_key_source, count(*) AS n, count(DISTINCT match_key) AS n_keys FROM keyed GROUP BY ALL""")
def match_key_dist(spark, sf):
    return with_keys(boq(spark, sf)).groupBy("match_key_source").agg(F.count("*").alias("n"), F.countDistinct("match_key").alias("n_keys"))


@query(f"""{WITH_BOQ} SELECT id, item_code, province, price_period FROM boq
WHERE active AND province >= 'C' AND item_code LIKE '0304%' AND quantity > 25 AND data_source_type <> 'pending_review'""")
def domain_filter(spark, sf):
    from ..operators.search import domain

    where = [("province", ">=", "C"), ("item_code", "like", "0304%"), ("quantity", ">", 25), ("data_source_type", "!=", "pending_review"), ("no_such_field", "=", 1)]
    return boq(spark, sf).filter(domain(where)).select("id", "item_code", "province", "price_period")


_SORTED = """row_number() OVER (PARTITION BY province ORDER BY unit_rate_cents, id) AS rn, count(*) OVER (PARTITION BY province) AS n"""
# Outliers go first (from eight rows on); everything else comes from what is left.
_TRIMMED = f"""{WITH_KEYS}, p AS (SELECT * FROM keyed WHERE {PRICED}), r AS (SELECT province, unit_rate_cents, {_SORTED} FROM p),
q AS (SELECT province, max(n) AS n, max(CASE WHEN rn = n // 4 + 1 THEN unit_rate_cents END) AS q1, max(CASE WHEN rn = 3 * n // 4 + 1 THEN unit_rate_cents END) AS q3 FROM r GROUP BY province),
t AS (SELECT p.id, p.province, unit_rate_cents, quantity, q.n AS before FROM p JOIN q ON p.province = q.province WHERE q.n < 8 OR unit_rate_cents BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1))"""


@query(f"""{_TRIMMED}, s AS (SELECT *, {_SORTED}, CAST(sum(unit_rate_cents * quantity) OVER (PARTITION BY province) AS DOUBLE) / sum(quantity) OVER (PARTITION BY province) AS a FROM t)
SELECT province, max(n) AS n, max(before) - max(n) AS n_outliers, max(a) AS avg_rate, min(unit_rate_cents) AS min_rate, max(unit_rate_cents) AS max_rate,
 CASE WHEN max(n) < 4 THEN max(a) ELSE max(CASE WHEN rn = n // 4 + 1 THEN unit_rate_cents END) END AS q1, CASE WHEN max(n) < 4 THEN max(a) ELSE max(CASE WHEN rn = n // 2 + 1 THEN unit_rate_cents END) END AS q2,
 CASE WHEN max(n) < 4 THEN max(a) ELSE max(CASE WHEN rn = 3 * n // 4 + 1 THEN unit_rate_cents END) END AS q3, count(*) FILTER (WHERE n >= 3 AND a <> 0 AND abs(unit_rate_cents - a) > 0.3 * abs(a)) AS n_anomalies FROM s GROUP BY province""")
def price_kpis(spark, sf):
    return pricing.kpis(pricing.priced(boq(spark, sf)), "province")


@query(f"""{_TRIMMED} SELECT province, count(*) AS kept, sum(unit_rate_cents) AS sum_rate FROM t GROUP BY province""")
def price_iqr_trim(spark, sf):
    return pricing.trimmed(pricing.priced(boq(spark, sf)), "province").groupBy("province").agg(F.count("*").alias("kept"), F.sum("unit_rate_cents").alias("sum_rate"))


_DIM = lambda d: f"""SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS key, max(a) AS avg_rate, min(unit_rate_cents) AS min_rate, max(unit_rate_cents) AS max_rate, count(*) AS n, count(*) FILTER (WHERE c >= 3 AND a <> 0 AND abs(unit_rate_cents - a) > 0.3 * abs(a)) AS n_anomalies
 FROM (SELECT {d}, unit_rate_cents, count(*) OVER w AS c, CAST(sum(unit_rate_cents * quantity) OVER w AS DOUBLE) / sum(quantity) OVER w AS a FROM p WINDOW w AS (PARTITION BY {d})) GROUP BY {d}"""  # noqa: E731


@query(f"""{WITH_KEYS}, p AS (SELECT *, CASE WHEN match_key_source = 'dict' THEN match_key || '|' || coalesce(std_spec, p_spec) ELSE match_key END AS aggregate_id
 FROM (SELECT *, substr(item_feature, 4, strpos(item_feature, ';') - 4) || '|' || substr(item_feature, strpos(item_feature, ';') + 4) AS p_spec FROM keyed) WHERE {PRICED})
{_DIM('aggregate_id')} UNION ALL {_DIM('match_key_source')} UNION ALL {_DIM('province')} UNION ALL {_DIM('price_period')}""")
def price_4dims(spark, sf):
    return pricing.four_dimensions(pricing.priced(with_keys(boq(spark, sf))))


@query(f"""{WITH_BOQ}, p AS (SELECT * FROM boq WHERE {PRICED}), e AS (SELECT min(unit_rate_cents) AS lo, max(unit_rate_cents) AS hi FROM p),
c AS (SELECT CAST(least(9, floor((unit_rate_cents - lo) / ((hi - lo) / 10.0))) AS INTEGER) AS bin, count(*) AS n FROM p, e GROUP BY 1)
SELECT CAST(s.i AS INTEGER) AS bin, lo + s.i * ((hi - lo) / 10.0) AS bin_low, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM p), 1) AS pct FROM e, (SELECT unnest(range(10)) AS i) s LEFT JOIN c ON c.bin = s.i""")
def price_hist(spark, sf):
    return pricing.histogram(pricing.priced(boq(spark, sf)).withColumn("unit_rate_cents", F.col("unit_rate_cents").cast("double"))).select("bin", "bin_low", "n", "pct")


@query(f"""{WITH_BOQ}, p AS (SELECT * FROM boq WHERE {PRICED}),
r AS (SELECT *, row_number() OVER (PARTITION BY province ORDER BY unit_rate_cents, id) AS rn, count(*) OVER (PARTITION BY province) AS n FROM p)
SELECT province, max(n) AS n, min(unit_rate_cents) AS min_rate, max(CASE WHEN rn = round_even(0.25 * (n - 1), 0) + 1 THEN unit_rate_cents END) AS q1,
 max(CASE WHEN rn = round_even(0.5 * (n - 1), 0) + 1 THEN unit_rate_cents END) AS median, max(CASE WHEN rn = round_even(0.75 * (n - 1), 0) + 1 THEN unit_rate_cents END) AS q3,
 max(unit_rate_cents) AS max_rate, round(stddev_pop(unit_rate_cents), 2) AS stddev FROM r GROUP BY province""")
def price_quantiles(spark, sf):
    return pricing.summary_rows(pricing.priced(boq(spark, sf)), "province").withColumn("stddev", F.round("stddev", 2))


@query(f"""{WITH_BOQ} SELECT price_period, {AVG} AS avg_rate, count(*) AS n FROM boq WHERE {PRICED} GROUP BY price_period""")
def price_trend(spark, sf):
    return pricing.priced(boq(spark, sf)).groupBy("price_period").agg(pricing.weighted_average().alias("avg_rate"), F.count("*").alias("n")).orderBy("price_period")


@query(f"""{WITH_BOQ} SELECT id, province, unit_rate_cents, price_period, row_number() OVER (PARTITION BY province, unit_rate_cents ORDER BY price_period DESC NULLS LAST, id) AS rn FROM boq WHERE {PRICED} QUALIFY rn = 1""")
def price_dedup(spark, sf):
    return pricing.newest_first(pricing.priced(boq(spark, sf)), "province").select("id", "province", "unit_rate_cents", "price_period", F.lit(1).alias("rn"))


@query(f"""{WITH_BOQ}, p AS (SELECT * FROM boq WHERE {PRICED}), c AS (SELECT item_name, count(*) FILTER (WHERE price_period >= DATE '1998-02-01') AS recent FROM p GROUP BY item_name)
SELECT p.item_name, count(*) AS n, {AVG} AS avg_rate FROM p JOIN c ON p.item_name = c.item_name WHERE price_period >= DATE '1998-02-01' OR recent < 3 GROUP BY p.item_name""")
def price_recent_window(spark, sf):
    new = pricing.recent(pricing.priced(boq(spark, sf)), F.to_date(F.lit("1998-08-15")), 6, 3, "item_name")
    return new.groupBy("item_name").agg(F.count("*").alias("n"), pricing.weighted_average().alias("avg_rate"))


@query(f"""{WITH_BOQ} SELECT count(*) AS n_items, count(*) FILTER (WHERE std_name IS NOT NULL) AS n_standard, count(*) FILTER (WHERE unit_rate_cents IS NOT NULL) AS n_priced,
 count(*) FILTER (WHERE data_source_type = 'pending_review') AS n_pending, count(DISTINCT project_name) AS n_projects, count(DISTINCT import_batch_id) AS n_batches FROM boq WHERE active""")
def dashboard_kpis(spark, sf):
    return boq(spark, sf).filter("active").agg(
        F.count("*").alias("n_items"), F.count("std_name").alias("n_standard"), F.count("unit_rate_cents").alias("n_priced"),
        F.count_if(F.col("data_source_type") == "pending_review").alias("n_pending"), F.countDistinct("project_name").alias("n_projects"), F.countDistinct("import_batch_id").alias("n_batches"),
    )


@query(f"""{WITH_BOQ}, e AS (SELECT max(price_period) AS hi FROM boq), s AS (SELECT CAST(hi - to_months(CAST(i AS INTEGER)) AS DATE) AS month FROM e, (SELECT unnest(range(12)) AS i))
SELECT month, count(id) AS n FROM s LEFT JOIN boq ON price_period = month GROUP BY month""")
def monthly_12(spark, sf):
    return pricing.monthly(boq(spark, sf), F.max("price_period"))


@query(f"""{WITH_BOQ} SELECT substr(item_code, 1, 2) AS major, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM boq WHERE item_code IS NOT NULL), 4) AS pct
FROM boq WHERE item_code IS NOT NULL GROUP BY 1""")
def major_share(spark, sf):
    rows = boq(spark, sf).filter("item_code IS NOT NULL").groupBy(F.substring("item_code", 1, 2).alias("major")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return rows.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # over the few majors


@query(f"""{WITH_KEYS}, m AS (SELECT province, count(*) AS n, avg(CASE WHEN material_dict_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage,
 avg(CASE WHEN match_key_source IN ('dict', 'std') THEN 1.0 ELSE 0.0 END) AS key_quality, avg(CASE WHEN anomaly_flag = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate,
 avg(CASE WHEN anomaly_flag <> 'normal' THEN 1.0 ELSE 0.0 END) AS anomaly_rate FROM keyed WHERE active GROUP BY province)
SELECT province, n, round(coverage, 6) AS coverage, round(key_quality, 6) AS key_quality, round(error_rate, 6) AS error_rate, round(anomaly_rate, 6) AS anomaly_rate,
 coverage >= 0.8 AND anomaly_rate < 0.1 AS passes,
 CASE WHEN coverage < 0.8 AND anomaly_rate >= 0.1 THEN 'coverage;anomaly' WHEN coverage < 0.8 THEN 'coverage' WHEN anomaly_rate >= 0.1 THEN 'anomaly' ELSE '' END AS blockers FROM m""")
def quality_gate(spark, sf):
    g = quality.gate(quality.metrics(with_keys(boq(spark, sf)).filter("active"), "province"))
    return g.select("province", "n", *[F.round(c, 6).alias(c) for c in ("coverage", "key_quality", "error_rate", "anomaly_rate")], "passes", "blockers")


@query(f"""{WITH_BOQ}, s AS (SELECT *, row_number() OVER (PARTITION BY import_batch_id ORDER BY id) AS sequence FROM boq)
SELECT import_batch_id, count(*) AS n, sum(total_cents)::BIGINT AS total_cents,
 sha256(string_agg(CAST(sequence AS VARCHAR) || ':' || coalesce(item_code, '') || ':' || item_name || ':' || CAST(total_cents AS VARCHAR), '|' ORDER BY sequence)) AS checksum
FROM s WHERE active GROUP BY import_batch_id""")
def batch_checksum(spark, sf):
    return quality.batch_checksum(boq(spark, sf, sequence=True))


_CATALOG = f"""{WITH_KEYS}, p AS (SELECT * FROM keyed WHERE {PRICED}), c AS (
SELECT match_key, CAST(sum(unit_rate_cents) AS DOUBLE) / count(*) AS avg_rate, min(unit_rate_cents) AS min_rate, max(unit_rate_cents) AS max_rate, count(*) AS n FROM p GROUP BY match_key),
l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY price_period DESC, id DESC) = 1)"""


@query(f"""{_CATALOG} SELECT c.*, l.price_period AS latest_period, l.item_name, l.unit_std, l.province AS latest_province, l.unit_rate_cents AS latest_rate FROM c JOIN l ON c.match_key = l.match_key""")
def cost_catalog(spark, sf):
    return quality.catalog(pricing.priced(with_keys(boq(spark, sf))))


@query(f"""{_CATALOG} SELECT match_key, n, avg_rate, n < 3 AS low_sample FROM c WHERE match_key LIKE 'dict:%'""")
def catalog_preview(spark, sf):
    return quality.catalog_preview(quality.catalog(pricing.priced(with_keys(boq(spark, sf)))), "dict:")


@query(f"""{WITH_BOQ}, v AS (
SELECT id, 'code_required' AS rule, 'warning' AS level FROM boq WHERE item_code IS NULL
UNION ALL SELECT id, 'quantity_range', 'warning' FROM boq WHERE quantity < 1 OR quantity > 48
UNION ALL SELECT id, 'rate_positive', 'error' FROM boq WHERE unit_rate_cents <= 0
UNION ALL SELECT id, 'code_digits', 'warning' FROM boq WHERE NOT regexp_matches(item_code, '^[0-9]{{9}}')
UNION ALL SELECT id, 'source_known', 'error' FROM boq WHERE data_source_type = 'pending_review'
UNION ALL SELECT id, 'total_formula', 'error' FROM boq WHERE abs(total_cents - quantity * unit_rate_cents) / CAST(quantity * unit_rate_cents AS DOUBLE) > 0.00001
UNION ALL SELECT id, 'code_unique', 'info' FROM boq WHERE item_code IN (SELECT item_code FROM boq WHERE item_code IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
SELECT rule, level, count(*) AS n, count(DISTINCT id) AS n_rows FROM v GROUP BY ALL""")
def validation_report(spark, sf):
    return validate.report(boq(spark, sf), validate.BILL_RULES)


_FAMILY = """CASE WHEN v = '2013' AND substr(item_code,1,6) = '030408' AND substr(item_code,1,9) NOT IN ('030408006','030408007') THEN '电线电缆'
 WHEN v = '2013' AND substr(item_code,1,6) = '010515' THEN '钢筋' WHEN v IN ('2013','2024') AND substr(item_code,1,6) = '010502' THEN '混凝土'
 WHEN v = '2024' AND substr(item_code,1,6) = '030409' AND substr(item_code,1,9) NOT IN ('030409003','030409004','030409005') THEN '电线电缆'
 WHEN v = '2024' AND substr(item_code,1,6) = '031001' AND substr(item_code,1,9) <> '031001010' THEN '管道' END"""


@query(f"""{WITH_BOQ}, f AS (SELECT item_code_version AS v, item_code FROM boq) SELECT v AS version, {_FAMILY} AS family, count(*) AS n FROM f WHERE v <> 'unknown' GROUP BY ALL""")
def classify_prefix(spark, sf):
    b = boq(spark, sf).filter("item_code_version <> 'unknown'")
    return b.groupBy(F.col("item_code_version").alias("version"), classify.by_prefix(F.col("item_code"), F.col("item_code_version")).alias("family")).agg(F.count("*").alias("n"))


# The words and patterns of the classifier by text, as the SQL form needs them.
_EDGE = r"[^\p{L}\p{N}_]"
_TRAY, _ANY_CABLE, _NO_CABLE = "桥架|托盘|梯架|线槽", "电缆|电线|配线|布电线", "电缆头|终端头|中间头|接线端子|电缆终端|电力电缆头|控制电缆头"
_NO_PIPE = "截止阀|闸阀|球阀|蝶阀|止回阀|排气阀|安全阀|减压阀|低压螺纹阀门|管件|套管|地漏|法兰|弯头|三通|接头|堵头|栏杆|爬梯|扶手|支架|支吊架|一般填料|防水套管|绝热|凿|预留洞|雨水斗|散流器|风口"
_PIPE = r"(?i)镀锌钢管|焊接钢管|无缝钢管|不锈钢管|螺旋焊管|直缝焊管|PPR[- ]?管?|PVC[- ]?U?管?|CPVC[- ]?管?|HDPE[- ]?管?|PE[- ]?RT?管?|UPVC|PP管|铸铁管|球墨铸铁管|铝塑复合管|铜管|给水管|排水管|雨水管|采暖管|燃气管道|DN\s*\d+|de\s*\d+"
_CEMENT = r"(?i)P\.O\s*\d{3}|P\.C\s*\d{3}|P\.I\s*\d{3}|P\.II\s*\d{3}|硅酸盐水泥|白水泥"
_NO_CEMENT = "砂浆|楼地面|砖基础|块料|石材|擦缝|勾缝|抹灰|找平|垫层|防水|堵漏|混凝土"


def _by_text(name: str, text: str) -> str:
    has = lambda c, p: f"regexp_matches({c}, '{p}')"
    return f"""CASE WHEN ({has(text, f"(^|{_EDGE})C[0-9]{{2}}({_EDGE}|$)")} OR {has(text, f"(^|{_EDGE})(混凝土|砼)({_EDGE}|$)")}) AND NOT {has(name, _TRAY)} THEN '混凝土'
 WHEN {has(text, _CEMENT)} AND NOT {has(text, _NO_CEMENT)} THEN '水泥' WHEN {has(text, "(?i)HRB400|HRB500|HPB300|HRBF400|螺纹钢|圆钢|钢筋")} AND NOT {has(name, _TRAY)} THEN '钢筋'
 WHEN {has(name, _ANY_CABLE)} AND NOT {has(text, _NO_CABLE)} AND NOT {has(name, _TRAY)} THEN '电线电缆' WHEN {has(text, _PIPE)} AND NOT {has(text, _NO_PIPE)} THEN '管道' END"""


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, {_by_text("t", "t")} AS family FROM t""")
def classify_text(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", classify.by_text(F.col("text")).alias("family"))


_LOOKUP = """b AS (SELECT DISTINCT item_code_version AS version, code9, min(item_name) OVER (PARTITION BY item_code_version, code9) AS name FROM keyed
 WHERE item_code_version <> 'unknown' AND regexp_matches(code9, '^[0-9]{9}$') AND NOT (item_code_version = '2013' AND code9 LIKE '%1') AND NOT (item_code_version = '2024' AND code9 LIKE '%2'))"""


def version_lookup(keyed):
    """Codes of each edition with a name: drawn from the bill, with some codes left to one edition."""
    rows = keyed.filter("item_code_version <> 'unknown' AND code9 RLIKE '^[0-9]{9}$' AND NOT (item_code_version = '2013' AND code9 LIKE '%1') AND NOT (item_code_version = '2024' AND code9 LIKE '%2')")
    return rows.groupBy(F.col("item_code_version").alias("version"), "code9").agg(F.min("item_name").alias("name"))


@query(f"""{WITH_KEYS}, {_LOOKUP},
k AS (SELECT code9, max(CASE WHEN version='2013' THEN name END) AS n13, max(CASE WHEN version='2024' THEN name END) AS n24, max((version='2013')::INT) AS i13, max((version='2024')::INT) AS i24 FROM b GROUP BY code9),
o AS (SELECT substr(code9,1,6) AS p6, max(i13) AS p13, max(i24) AS p24 FROM k WHERE i13 + i24 = 1 GROUP BY 1),
j AS (SELECT i.code9, i.item_name, n13, n24, coalesce(i13,0) AS i13, coalesce(i24,0) AS i24, CASE WHEN p13 = 1 THEN '2013' WHEN p24 = 1 THEN '2024' ELSE 'unknown' END AS px
 FROM keyed i LEFT JOIN k ON i.code9 = k.code9 LEFT JOIN o ON substr(i.code9,1,6) = o.p6),
e AS (SELECT *, CASE WHEN length(code9) < 6 THEN 'unknown,unknown,4' WHEN i13 = 1 AND i24 = 0 THEN '2013,high,1' WHEN i24 = 1 AND i13 = 0 THEN '2024,high,1'
 WHEN i13 + i24 > 0 AND item_name = n13 THEN '2013,high,2' WHEN i13 + i24 > 0 AND item_name = n24 THEN '2024,high,2'
 WHEN i13 + i24 > 0 AND contains(item_name, n13) THEN '2013,medium,3' WHEN i13 + i24 > 0 AND contains(item_name, n24) THEN '2024,medium,3'
 WHEN px <> 'unknown' THEN px || ',low,4' ELSE 'unknown,unknown,4' END AS s FROM j),
x AS (SELECT px, split_part(s, ',', 1) AS v, split_part(s, ',', 2) AS c, CAST(split_part(s, ',', 3) AS INTEGER) AS layer FROM e)
SELECT CASE WHEN c = 'low' AND px <> v THEN 'unknown' ELSE v END AS version,
 CASE WHEN c = 'medium' AND px <> v THEN 'low' WHEN c = 'low' AND px <> v THEN 'unknown' ELSE c END AS confidence, layer, count(*) AS n FROM x GROUP BY ALL""")
def version_layers(spark, sf):
    # lines repeat their code and name: these are counted, written, and judged once
    keyed = cut(with_keys(boq(spark, sf)).groupBy("item_code_version", "code9", "item_name").agg(F.count("*").alias("n")))
    items = keyed.groupBy("code9", "item_name").agg(F.sum("n").alias("n"))
    return classify.edition(items, version_lookup(keyed)).groupBy("version", "confidence", "layer").agg(F.sum("n").alias("n"))


_MAPPING = "mapping AS (SELECT DISTINCT item_code_version AS version, code9 FROM keyed WHERE regexp_matches(code9, '^[0-9]{9}$') AND CAST(substr(code9, 7, 3) AS INTEGER) % 2 = 0)"


@query(f"""{WITH_KEYS}, {_MAPPING} SELECT k.item_code_version AS version, count(DISTINCT k.code9) AS n_codes, count(DISTINCT m.code9) AS n_mapped,
 count(*) AS n_rows, count(m.code9) AS n_rows_mapped FROM keyed k LEFT JOIN mapping m ON k.item_code_version = m.version AND k.code9 = m.code9 WHERE k.code9 <> '' GROUP BY 1""")
def mapping_coverage(spark, sf):
    # the rows of each code are counted before codes meet the mapping, from one pass over the bill
    keyed = cut(with_keys(boq(spark, sf)).groupBy("item_code_version", "code9").agg(F.count("*").alias("n"))).filter("code9 <> ''")
    m = keyed.filter("code9 RLIKE '^[0-9]{9}$'").filter("CAST(substring(code9, 7, 3) AS INT) % 2 = 0").select(F.col("item_code_version").alias("version"), F.col("code9").alias("mapped")).distinct()
    j = keyed.join(m, (F.col("item_code_version") == F.col("version")) & (F.col("code9") == F.col("mapped")), "left")
    mapped = F.col("mapped").isNotNull()
    return j.groupBy(F.col("item_code_version").alias("version")).agg(
        F.count("*").alias("n_codes"), F.count_if(mapped).alias("n_mapped"), F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(mapped, F.col("n"))), F.lit(0)).alias("n_rows_mapped")
    )


@query(f"""{WITH_KEYS}, {_LOOKUP}, k AS (SELECT code9, max((version='2013')::INT) AS a, max((version='2024')::INT) AS z FROM b GROUP BY code9)
SELECT CASE WHEN a + z = 2 THEN 'both' WHEN a = 1 THEN 'only_2013' ELSE 'only_2024' END AS part, code9 FROM k""")
def version_sets(spark, sf):
    codes = version_lookup(with_keys(boq(spark, sf)))
    a, z = (codes.filter(F.col("version") == v).select("code9") for v in ("2013", "2024"))
    return (
        a.intersect(z).select(F.lit("both").alias("part"), "code9")
        .unionByName(a.exceptAll(z).select(F.lit("only_2013").alias("part"), "code9"))
        .unionByName(z.exceptAll(a).select(F.lit("only_2024").alias("part"), "code9"))
    )
