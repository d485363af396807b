"""The bill views over the supplied star schema, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREFIXES = ["030408", "030409", "031001", "010515", "010502"]
UNITS = ["米", "M", "ｋｇ", "m2", "立方米", "樘"]


def _pick(values: list[str], at) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def boq(spark: SparkSession, sf_dir: str, sequence: bool = False) -> DataFrame:
    """Priced lines. `sequence` numbers the lines of a batch, which costs a shuffle.

    Orders meet their customers first, so that the lines are shuffled twice and the names of the parts, joined last, not at all.
    """
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    li = read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = (
        read("orders", "o_orderkey", "o_custkey", "o_orderstatus")
        .join(read("customer", "c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    df = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(read("part", "p_partkey", "p_name", "p_type", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    code = F.concat(_pick(PREFIXES, F.col("p_size") % 5), F.lpad((p % 12 + 1).cast("string"), 3, "0"), F.when(F.col("l_linenumber") % 2 == 1, "001").otherwise(""))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    qty = F.col("l_quantity").cast("long")
    df = df.select(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + p) * 10000 + s).alias("id"),
        (F.col("l_orderkey") % 50).alias("import_batch_id"),
        F.when(p % 89 == 0, None).when(p % 97 == 0, F.concat(F.lit("z"), p.cast("string"))).otherwise(code).alias("item_code"),
        _pick(["2013", "2024", "unknown"], s % 3).alias("item_code_version"),
        F.col("p_name").alias("item_name"),
        F.concat(F.lit("型号:"), "p_type", F.lit(";规格:"), F.col("p_size").cast("string")).alias("item_feature"),
        _pick(UNITS, s % 6).alias("unit"),
        qty.alias("quantity"),
        cents.alias("total_cents"),
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.expr("CAST(ROUND(l_extendedprice * 100) AS BIGINT) DIV CAST(l_quantity AS BIGINT)")).alias("unit_rate_cents"),
        F.trunc("l_shipdate", "month").alias("price_period"),
        F.col("n_name").alias("province"),
        F.col("c_name").alias("project_name"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "control_price").otherwise("pending_review").alias("data_source_type"),
        F.when(F.col("l_discount") >= 0.09, "error").when(F.col("l_discount") >= 0.07, "warning").otherwise("normal").alias("anomaly_flag"),
        F.when(p % 5 != 0, p).alias("material_dict_id"),
        F.when(p % 3 == 0, F.col("p_type")).alias("std_name"),
        F.when(p % 3 == 0, F.col("p_brand")).alias("std_spec"),
        (~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))).alias("active"),
        p.alias("part"),
    )
    return df.withColumn("sequence", F.row_number().over(Window.partitionBy("import_batch_id").orderBy("id")).cast("long")) if sequence else df


BOQ = """boq AS (
SELECT ((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey AS id, l_orderkey % 50 AS import_batch_id,
 CASE WHEN l_partkey % 89 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN 'z' || CAST(l_partkey AS VARCHAR)
  ELSE (CASE p_size % 5 WHEN 0 THEN '030408' WHEN 1 THEN '030409' WHEN 2 THEN '031001' WHEN 3 THEN '010515' ELSE '010502' END)
   || lpad(CAST(l_partkey % 12 + 1 AS VARCHAR), 3, '0') || (CASE WHEN l_linenumber % 2 = 1 THEN '001' ELSE '' END) END AS item_code,
 CASE l_suppkey % 3 WHEN 0 THEN '2013' WHEN 1 THEN '2024' ELSE 'unknown' END AS item_code_version,
 p_name AS item_name, '型号:' || p_type || ';规格:' || CAST(p_size AS VARCHAR) AS item_feature,
 CASE l_suppkey % 6 WHEN 0 THEN '米' WHEN 1 THEN 'M' WHEN 2 THEN 'ｋｇ' WHEN 3 THEN 'm2' WHEN 4 THEN '立方米' ELSE '樘' END AS unit,
 CAST(l_quantity AS BIGINT) AS quantity, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS total_cents,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(ROUND(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) END AS unit_rate_cents,
 CAST(date_trunc('month', l_shipdate) AS DATE) AS price_period, n_name AS province, c_name AS project_name,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'control_price' ELSE 'pending_review' END AS data_source_type,
 CASE WHEN l_discount >= 0.09 THEN 'error' WHEN l_discount >= 0.07 THEN 'warning' ELSE 'normal' END AS anomaly_flag,
 CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS material_dict_id,
 CASE WHEN l_partkey % 3 = 0 THEN p_type END AS std_name, CASE WHEN l_partkey % 3 = 0 THEN p_brand END AS std_spec,
 NOT (l_returnflag = 'R' AND l_linestatus = 'F') AS active, l_partkey AS part
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

UNIT_STD = "CASE unit WHEN '米' THEN 'm' WHEN 'M' THEN 'm' WHEN 'ｋｇ' THEN 'kg' WHEN 'm2' THEN '㎡' WHEN '立方米' THEN 'm³' ELSE '樘' END"

KEYED = f"""u AS (SELECT *, {UNIT_STD} AS unit_std,
 CASE WHEN item_code IS NULL THEN '' WHEN item_code LIKE 'z%' THEN 'Z' || upper(substr(item_code, 2)) ELSE substr(item_code, 1, 9) END AS code9 FROM boq),
keyed AS (SELECT *,
 CASE WHEN material_dict_id IS NOT NULL THEN 'dict' WHEN std_name IS NOT NULL AND std_spec IS NOT NULL THEN 'std' WHEN code9 <> '' THEN 'code' ELSE 'raw' END AS match_key_source,
 CASE WHEN material_dict_id IS NOT NULL THEN 'dict:' || CAST(material_dict_id AS VARCHAR) || '|' || unit_std
  WHEN std_name IS NOT NULL AND std_spec IS NOT NULL THEN 'std:' || std_name || '|' || std_spec || '|' || unit_std
  WHEN code9 LIKE 'Z%' THEN 'code:2024:' || code9 || '|' || unit_std
  WHEN code9 <> '' THEN 'code:' || item_code_version || ':' || code9 || '|' || unit_std
  ELSE 'raw:' || item_code_version || ':' || replace(lower(item_name), ' ', '') || '|' || replace(lower(item_feature), ' ', '') || '|' || unit_std END AS match_key FROM u)"""
WITH_BOQ, WITH_KEYS = f"WITH {BOQ}", f"WITH {BOQ}, {KEYED}"


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence in DuckDB, a row of the table per character."""
    cell = f"greatest(acc[-1], row[j + 1], row[j] + CASE WHEN substr({b}, j, 1) = ch THEN 1 ELSE 0 END)"
    inner = f"list_reduce(range(1, CAST(length({b}) AS BIGINT) + 1), lambda acc, j: list_append(acc, {cell}), [CAST(0 AS BIGINT)])"
    return f"list_reduce(string_split({a}, ''), lambda row, ch: {inner}, list_transform(range(0, CAST(length({b}) AS BIGINT) + 1), lambda i: CAST(0 AS BIGINT)))[-1]"


def edit_sql(a: str, b: str) -> str:
    """The greater of the ratio of the whole texts and of the shorter with its best part of the longer."""
    whole = f"200.0 * {lcs_sql(a, b)} / (length({a}) + length({b}))"

    def part(s: str, l: str) -> str:  # noqa: E741
        cut = f"substr({l}, greatest(0, w) + 1, least(length({l}), w + length({s})) - greatest(0, w))"
        return f"list_max(list_transform(range(1 - CAST(length({s}) AS BIGINT), CAST(length({l}) AS BIGINT)), lambda w: 200.0 * {lcs_sql(s, cut)} / (length({s}) + length({cut}))))"

    return f"greatest({whole}, CASE WHEN length({a}) <= length({b}) THEN {part(a, b)} ELSE 0 END, CASE WHEN length({a}) >= length({b}) THEN {part(b, a)} ELSE 0 END)"
