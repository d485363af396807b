"""Queries over merges, the dictionary tree, search, matching and learning, each with its DuckDB form."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import unit_std
from ..operators import learning, matching, merge, pricing, search, similarity, topk, tree
from ..operators.quality import compare_tables
from ..shared import cut, kept, shared_dir
from .proxy import BOQ, UNIT_STD, WITH_BOQ, WITH_KEYS, boq, edit_sql, lcs_sql

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


# --- merges ---


def before_after(spark, sf, *columns):
    """The bill, and all of its batches imported again with changes. Written once, with the columns that are asked for beside those
    that a merge looks at: both sides come from the same lines."""
    bill = boq(spark, sf, sequence=True).withColumn("unit_std", unit_std(F.col("unit")))
    wanted = dict.fromkeys(["id", "import_batch_id", "sequence", *merge.KEY, "active", *columns])
    old = kept(bill.select(*wanted, "part"), "bill")
    changed = {
        "sequence": F.col("sequence") + F.when(F.col("part") % 7 == 0, 1).otherwise(0),
        "quantity": F.col("quantity") + F.when(F.col("part") % 13 == 0, 1).otherwise(0) if "quantity" in wanted else None,
        "item_name": F.concat("item_name", F.when(F.col("part") % 17 == 0, " x").otherwise("")),
        "std_name": F.lit(None).cast("string"),
        "std_spec": F.lit(None).cast("string"),
    }
    new = old.filter("part % 11 <> 0").withColumns({c: v for c, v in changed.items() if c in wanted})
    return old, new


# Rows of the bill are matched by sequence alone; then by code, name and unit with the nearest sequence; then in order.
_SAME = "o.import_batch_id = n.import_batch_id AND coalesce(trim(o.item_code), '') = coalesce(trim(n.item_code), '') AND lower(o.item_name) = lower(n.item_name) AND o.unit_std = n.unit_std"
_NTH = "row_number() OVER (PARTITION BY import_batch_id, coalesce(trim(item_code), ''), lower(item_name), unit_std ORDER BY sequence, id) AS nth"
_NEXT = f"""WITH {BOQ}, o AS MATERIALIZED (SELECT *, {UNIT_STD} AS unit_std, row_number() OVER (PARTITION BY import_batch_id ORDER BY id) AS sequence FROM boq),
n AS MATERIALIZED (SELECT * REPLACE (sequence + CASE WHEN part % 7 = 0 THEN 1 ELSE 0 END AS sequence, quantity + CASE WHEN part % 13 = 0 THEN 1 ELSE 0 END AS quantity, item_name || CASE WHEN part % 17 = 0 THEN ' x' ELSE '' END AS item_name) FROM o WHERE part % 11 <> 0),
m1 AS MATERIALIZED (SELECT o.id AS old_id, n.id AS new_id FROM (SELECT * FROM o WHERE active) o JOIN (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY import_batch_id, sequence ORDER BY id) = 1) n USING (import_batch_id, sequence)),
c AS (SELECT o.id AS old_id, n.id AS new_id, abs(o.sequence - n.sequence) AS gap, o.sequence AS os, n.sequence AS ns FROM (SELECT * FROM o ANTI JOIN m1 ON o.id = m1.old_id WHERE active) o
 JOIN (SELECT * FROM n ANTI JOIN m1 ON n.id = m1.new_id) n ON {_SAME}),
c1 AS MATERIALIZED (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY gap, os, old_id) = 1),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY gap, ns, new_id) = 1),
m2 AS MATERIALIZED (SELECT old_id, new_id FROM m1 UNION ALL SELECT old_id, new_id FROM c2),
m3 AS (SELECT o.id AS old_id, n.id AS new_id FROM (SELECT *, {_NTH} FROM o ANTI JOIN m2 ON o.id = m2.old_id WHERE active) o JOIN (SELECT *, {_NTH} FROM n ANTI JOIN m2 ON n.id = m2.new_id) n ON {_SAME} AND o.nth = n.nth),
m AS MATERIALIZED (SELECT * FROM m2 UNION ALL SELECT * FROM m3),
r AS MATERIALIZED (SELECT o.id, o.import_batch_id, coalesce(n.sequence, o.sequence) AS sequence, coalesce(n.quantity, o.quantity) AS quantity, o.std_name, o.std_spec, o.material_dict_id, n.id IS NOT NULL AND o.active AS active,
  CASE WHEN n.id IS NOT NULL THEN 'updated' WHEN o.active THEN 'orphaned' ELSE 'kept' END AS change FROM o LEFT JOIN m ON o.id = m.old_id LEFT JOIN n ON m.new_id = n.id
 UNION ALL SELECT n.id, n.import_batch_id, n.sequence, n.quantity, NULL, NULL, n.material_dict_id, true, 'created' FROM n ANTI JOIN m ON n.id = m.new_id)"""


@query(f"{_NEXT} SELECT id, sequence, quantity, std_name, active, change FROM r")
def upsert_result(spark, sf):
    return merge.upsert(*before_after(spark, sf, "quantity", "std_name"), columns=["quantity", "std_name"]).select("id", "sequence", "quantity", "std_name", "active", "change")


@query(f"{_NEXT} SELECT change, count(*) AS n FROM r GROUP BY change")
def upsert_counts(spark, sf):
    return merge.upsert_counts(merge.upsert(*before_after(spark, sf), columns=[]))


@query(f"""{_NEXT}, g AS (SELECT p.id AS from_id, p.sequence AS fs, p.std_name, p.std_spec, c.id, row_number() OVER (PARTITION BY p.id ORDER BY abs(c.sequence - p.sequence), c.sequence, c.id) AS k
 FROM (SELECT * FROM r WHERE change = 'orphaned') p JOIN (SELECT * FROM r WHERE change = 'created') c ON c.import_batch_id = p.import_batch_id AND c.material_dict_id = p.material_dict_id),
t AS (SELECT id, arg_min(std_name, (fs, from_id)) FILTER (WHERE std_name IS NOT NULL) AS std_name, arg_min(std_spec, (fs, from_id)) FILTER (WHERE std_spec IS NOT NULL) AS std_spec FROM g WHERE k = 1 GROUP BY id)
SELECT r.id, t.std_name, t.std_spec, t.std_name IS NOT NULL OR t.std_spec IS NOT NULL AS backfilled FROM r LEFT JOIN t ON r.id = t.id WHERE r.change = 'created'""")
def orphan_backfill(spark, sf):
    columns = ["std_name", "std_spec", "material_dict_id"]
    result = merge.upsert(*before_after(spark, sf, *columns), columns=columns)
    result = kept(result.filter("change IN ('orphaned', 'created')"), "changed")
    return merge.backfill_from_orphans(result).select("id", "std_name", "std_spec", "backfilled")


@query(f"""{WITH_BOQ} SELECT id, 'anomaly_flag' AS field, anomaly_flag AS old_value, 'warning' AS new_value, sha256(CAST(id AS VARCHAR) || '|anomaly_flag') AS trace_id
FROM boq WHERE part % 50 = 0 AND anomaly_flag <> 'warning'""")
def audit_changes(spark, sf):
    b = boq(spark, sf)
    after = merge.confirm_anomalies(b, b.filter("part % 50 = 0").select("id"), "warning", confirmed=True)
    return merge.audit(b, after, ["anomaly_flag", "data_source_type"], "tester", "checked").select("id", "field", "old_value", "new_value", "trace_id")


@query(f"{WITH_BOQ} SELECT id, 'control_price' AS data_source_type FROM boq WHERE import_batch_id = 3 AND data_source_type <> 'control_price'")
def batch_switch(spark, sf):
    b = boq(spark, sf)
    return merge.switch_source(b, b.filter("import_batch_id = 3").select("id"), "control_price").select("id", "data_source_type")


@query(f"""{_NEXT}, j AS (SELECT o.id AS a, n.id AS b, o.quantity IS NOT DISTINCT FROM n.quantity AS q, o.sequence IS NOT DISTINCT FROM n.sequence AS s, o.item_code IS NOT DISTINCT FROM n.item_code AS i FROM o FULL JOIN n ON o.id = n.id),
l AS (SELECT 'quantity' AS field, a, b, q AS same FROM j UNION ALL SELECT 'sequence', a, b, s FROM j UNION ALL SELECT 'item_code', a, b, i FROM j)
SELECT field, count(*) FILTER (WHERE b IS NULL) AS only_a, count(*) FILTER (WHERE a IS NULL) AS only_b, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND same) AS equal,
 count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND NOT same) AS different FROM l GROUP BY field""")
def table_compare(spark, sf):
    return compare_tables(*before_after(spark, sf, "quantity"), "id", ["quantity", "sequence", "item_code"])


# --- dictionary tree ---

_PART = ["p_type", "p_brand", "p_name", "p_name || ' ' || CAST(p_size AS VARCHAR)", "CAST(p_partkey AS VARCHAR)"]


def dictionary(spark, sf, depth=5):
    c = F.col
    levels = [c("p_type"), c("p_brand"), c("p_name"), F.concat("p_name", F.lit(" "), c("p_size").cast("string")), c("p_partkey").cast("string")]
    return tree.build(read(spark, sf, "part"), levels[:depth])


def _level_sql(k: int) -> str:
    names = ", ".join(f"{e} AS n{i + 1}" for i, e in enumerate(_PART[:k]))
    return f"t{k} AS (SELECT DISTINCT {names} FROM part)"


_TREE = "WITH " + ", ".join(_level_sql(k) for k in range(1, 6))
_PATH = lambda k: " || '/' || ".join(f"n{i}" for i in range(1, k + 1))


@query(f"{_TREE} " + " UNION ALL ".join(f"SELECT 'l{k}' AS level, {_PATH(k)} AS path FROM t{k}" for k in range(1, 6)))
def tree_paths(spark, sf):
    return tree.paths(cut(dictionary(spark, sf))).select("level", "path")


@query(f"""{_TREE} SELECT 'no_parent' AS "check", count(*) AS n FROM t3 WHERE n3 LIKE 'red%' HAVING count(*) > 0 UNION ALL SELECT 'orphan', count(*) FROM t4 WHERE n4 LIKE 'hot%' HAVING count(*) > 0
UNION ALL SELECT 'level_gap', count(*) FROM t5 WHERE n5 LIKE '%7' HAVING count(*) > 0""")
def tree_checks(spark, sf):
    """The tree with planted faults: categories without a parent, with a missing one, and leaves two levels too high."""
    nodes = cut(dictionary(spark, sf))
    up = nodes.select(F.col("id").alias("_id"), F.col("parent_id").alias("_grand"))
    n = nodes.join(up, F.col("parent_id") == F.col("_id"), "left")
    parent = (
        F.when((F.col("level") == "l3") & F.col("name").startswith("red"), F.lit(None).cast("long"))
        .when((F.col("level") == "l4") & F.col("name").startswith("hot"), F.lit(-1).cast("long"))
        .when((F.col("level") == "l5") & F.col("name").endswith("7"), F.col("_grand"))
        .otherwise(F.col("parent_id"))
    )
    return tree.checks(n.select("id", "level", parent.alias("parent_id"), "name")).groupBy("check").agg(F.count("*").alias("n"))


def _code_sql() -> str:
    widths = [3, 2, 2, 3, 4]
    parts, head = [], _TREE
    for k in range(1, 6):
        over = f"PARTITION BY {', '.join(f't{k}.n{i}' for i in range(1, k))}" if k > 1 else ""
        number = f"CAST(row_number() OVER ({over} ORDER BY t{k}.n{k}) AS VARCHAR)"
        digits = f"repeat('0', greatest(0, {widths[k - 1]} - length({number}))) || {number}"
        up = "'I'" if k == 1 else "u.code"
        join = "" if k == 1 else f" JOIN c{k - 1} u ON " + " AND ".join(f"t{k}.n{i} = u.n{i}" for i in range(1, k))
        head += f", c{k} AS (SELECT t{k}.*, {up} || {digits} AS code FROM t{k}{join})"
        parts.append(f"SELECT 'l{k}' AS level, {_PATH(k)} AS path, code AS new_code FROM c{k}")
    return f"{head} " + " UNION ALL ".join(parts)


@query(_code_sql())
def tree_recode(spark, sf):
    return tree.recode(cut(dictionary(spark, sf))).select("level", "path", "new_code")


@query(f"""{_TREE}, a AS ({" UNION ALL ".join(f"SELECT {_PATH(k)} AS path, 'l{j}' AS level FROM t{j}" for k in range(1, 5) for j in range(k + 1, 6))})
SELECT path, count(*) AS n_below, count(*) FILTER (WHERE level = 'l5') AS n_leaves FROM a GROUP BY path""")
def tree_counts(spark, sf):
    return tree.descendants(cut(dictionary(spark, sf))).select("path", "n_below", "n_leaves")


@query("""SELECT p_name, p_size, min(p_partkey) AS id, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS sources, count(*) AS n_merged FROM part GROUP BY p_name, p_size""")
def leaf_merge(spark, sf):
    leaves = read(spark, sf, "part").select("p_name", "p_size", F.col("p_partkey").alias("id"), F.col("p_brand").alias("source"))
    return tree.merge_leaves(leaves, ["p_name", "p_size"])


# --- search ---

_HAS = lambda c, w: f"contains(lower(coalesce({c}, '')), '{w}')"
_ANY = lambda w: "(" + " OR ".join(_HAS(c, w) for c in ("item_name", "item_feature", "item_code", "std_name")) + ")"


@query(f"{WITH_BOQ} SELECT id, item_name, province FROM boq WHERE {_ANY('red')} AND {_ANY('economy')}")
def search_keyword(spark, sf):
    return search.keyword(boq(spark, sf), "red economy").select("id", "item_name", "province")


@query(f"""{WITH_BOQ}, f AS (SELECT id, price_period, CASE WHEN {_HAS('item_name', 'red')} AND {_HAS('item_name', 'bolt')} THEN 0 WHEN {_HAS('item_name', 'red')} OR {_HAS('item_name', 'bolt')} THEN 1 ELSE 3 END AS relevance
 FROM boq WHERE {_ANY('red')} AND {_ANY('bolt')}) SELECT * FROM f ORDER BY relevance, price_period DESC, id LIMIT 200""")
def search_rank(spark, sf):
    """The two hundred most relevant lines, a page of results."""
    found = search.keyword(boq(spark, sf), "red bolt")
    return found.select("id", "price_period", search.relevance("red bolt").alias("relevance")).orderBy("relevance", F.desc("price_period"), "id").limit(200)


_GRAMS = lambda c: f"list_distinct(list_transform(range(1, CAST(length('  ' || lower({c}) || ' ') AS BIGINT) - 1), lambda i: substr('  ' || lower({c}) || ' ', i, 3)))"


@query(f"""WITH g AS (SELECT p_partkey, p_name, {_GRAMS('p_name')} AS a, {_GRAMS("'red bolts'")} AS b FROM part),
s AS (SELECT p_partkey, p_name, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS similarity FROM g)
SELECT p_partkey, p_name, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.2 AND NOT contains(lower(p_name), 'red bolts')""")
def trigram_search(spark, sf):
    found = search.trigram_search(read(spark, sf, "part").select("p_partkey", "p_name"), "red bolts", "p_name")
    return found.withColumn("similarity", F.round("similarity", 6))


# --- matching ---

_BI = lambda c: f"list_distinct(list_transform(range(1, CAST(length({c}) AS BIGINT)), lambda i: substr(lower({c}), i, 2)))"


def _names(spark, sf):
    """Distinct names of the parts, and of the same with sizes."""
    names = read(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    dict_ = read(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("dict_name")).distinct()
    return names, dict_


@query(f"""WITH a AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT DISTINCT p_name || ' ' || CAST(p_size AS VARCHAR) AS dict_name FROM part),
x AS (SELECT name, unnest({_BI('name')}) AS g FROM a), y AS (SELECT dict_name, unnest({_BI('dict_name')}) AS g FROM b)
SELECT name, dict_name, count(*) AS shared FROM x JOIN y ON x.g = y.g GROUP BY ALL HAVING count(*) >= 6""")
def ngram_candidates(spark, sf):
    names, dict_ = _names(spark, sf)
    return similarity.candidates(names, dict_, "name", "name", "dict_name", "dict_name", least_shared=6)


@query(f"""WITH a AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT DISTINCT p_name || ' ' || CAST(p_size AS VARCHAR) AS dict_name FROM part),
s AS (SELECT name, dict_name, round(200.0 * {lcs_sql("name", "dict_name")} / (length(name) + length(dict_name)), 4) AS score FROM a, b)
SELECT name, rank, dict_name, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, dict_name) AS rank FROM s WHERE score > 0) WHERE rank <= 3""")
def indel_match(spark, sf):
    """The three best dictionary names by edit similarity of every part name."""
    return similarity.best_by_edit(*_names(spark, sf), "name", "dict_name", 3).select("name", "rank", "dict_name", "score")


@query(f"""WITH a AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT DISTINCT p_name AS other FROM part)
SELECT name, other, round({edit_sql("name", "other")}, 4) AS score FROM a, b WHERE name < other""")
def edit_score(spark, sf):
    """Edit similarity with partial alignment of the names of the parts."""
    names = _names(spark, sf)[0]
    pairs = names.join(names.withColumnRenamed("name", "other"), F.col("name") < F.col("other"))  # some dozen names
    return matching.text_pairs(pairs, "name", "other", "score").withColumn("score", F.round("score", 4))


def _described(spark, sf):
    """Distinct descriptions of the parts with the least part key of each."""
    return read(spark, sf, "part").groupBy(F.concat("p_name", F.lit(" "), "p_brand").alias("doc")).agg(F.min("p_partkey").alias("id"))


_TERMS = lambda doc: f"""list_concat(regexp_extract_all(lower({doc}), '[a-z0-9]{{2,}}'), list_transform(range(2, CAST(len(regexp_extract_all(lower({doc}), '[a-z0-9]{{2,}}')) AS BIGINT) + 1),
 lambda i: regexp_extract_all(lower({doc}), '[a-z0-9]{{2,}}')[i - 1] || ' ' || regexp_extract_all(lower({doc}), '[a-z0-9]{{2,}}')[i]))"""  # noqa: E731


def _vectors_sql(features: int, suffix: str = "") -> str:
    x = suffix
    return f"""w{x} AS (SELECT id, unnest({_TERMS("doc")}) AS term FROM d), tf{x} AS (SELECT id, term, count(*) AS tf FROM w{x} GROUP BY ALL),
df{x} AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1.0 + count(*))) + 1 AS idf FROM tf{x} GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {features}),
r{x} AS (SELECT id, term, tf * idf AS raw FROM tf{x} JOIN df{x} USING (term)), v{x} AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM r{x}),
s{x} AS (SELECT a.id AS query, b.id AS other, round(100 * sum(a.w * b.w), 6) AS score FROM v{x} a JOIN v{x} b ON a.term = b.term WHERE a.id % 100 = 0 AND a.id <> b.id GROUP BY ALL)"""


_DOCS = "WITH d AS (SELECT p_name || ' ' || p_brand AS doc, min(p_partkey) AS id FROM part GROUP BY 1)"


@query(f"""{_DOCS}, {_vectors_sql(10_000)}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS rank FROM s) SELECT query, rank, other, round(score, 4) AS score FROM k WHERE rank <= 5""")
def tfidf_topk(spark, sf):
    """Five nearest descriptions, of all, for each whose id is divisible by 100."""
    v = similarity.tfidf(_described(spark, sf), "id", "doc")
    near = topk.cosine_top_k(v.filter("id % 100 = 0").withColumnRenamed("id", "query"), v.withColumnRenamed("id", "other"), "query", "other", 6)
    top = similarity.top_k(near.filter("query <> other"), "query", 5, by="other")
    return top.select("query", "rank", "other", F.round("score", 4).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_inner_product(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def dense_topk(spark, sf):
    """Five vectors of greatest inner product for every hundredth vector: a stated query set against all rows."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    top = similarity.dense_top_k(e.filter("id % 100 = 0"), e, 5)
    return top.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


_SHORT_LIST = lambda x: f"SELECT query, other, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS k FROM s{x}) WHERE k <= 10"


@query(f"""{_DOCS}, {_vectors_sql(10_000)}, {_vectors_sql(512, "x")},
e AS (SELECT a.id AS query, b.id AS other, round(200.0 * {lcs_sql("a.doc", "b.doc")} / (length(a.doc) + length(b.doc)), 6) AS score FROM d a, d b WHERE a.id % 100 = 0 AND a.id <> b.id),
u AS (SELECT query, other, score, 'edit' AS source, 0.3 AS weight FROM e WHERE score >= 60 UNION ALL SELECT *, 'tfidf', 0.35 FROM ({_SHORT_LIST("")}) UNION ALL SELECT *, 'vector', 0.35 FROM ({_SHORT_LIST("x")}))
SELECT query, other, round(sum(score * weight) / sum(weight), 4) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM u GROUP BY query, other""")
def fuse3(spark, sf):
    """Candidates of three scorers joined, weights shared out over those that found one: edit ratio from 60 on, and the ten nearest by 10,000 and by 512 terms."""
    docs = _described(spark, sf)
    queries, others = docs.filter("id % 100 = 0").withColumnRenamed("id", "query"), docs.select(F.col("id").alias("other"), F.col("doc").alias("other_doc"))
    pairs = topk.ratio_pairs(queries, others, "doc", "other_doc", least=60)
    edit = pairs.join(queries, "doc").join(others, "other_doc").filter("query <> other").select("query", "other", F.round("score", 6).alias("score"))

    def near(features: int):
        v = similarity.tfidf(docs, "id", "doc", features)
        found = topk.cosine_top_k(v.filter("id % 100 = 0").withColumnRenamed("id", "query"), v.withColumnRenamed("id", "other"), "query", "other", 11)
        return similarity.top_k(found.filter("query <> other"), "query", 10, by="other").drop("rank")

    found = similarity.fuse({"edit": edit, "tfidf": near(10_000), "vector": near(512)}, "query", by="other")
    return found.withColumn("score", F.round("score", 4)).select("query", "other", "sources", "score")


@query("""WITH i AS (SELECT DISTINCT p_name || ' ' || CAST(p_size AS VARCHAR) AS item FROM part),
d AS (SELECT p_name AS dict_name, min(p_partkey) AS dict_id FROM part GROUP BY 1 UNION ALL SELECT p_name || ' 7', min(p_partkey) FROM part GROUP BY p_name UNION ALL SELECT 'steel ' || p_name || ' 33 set', min(p_partkey) FROM part GROUP BY p_name),
e AS (SELECT item, min(dict_id) AS dict_id FROM i JOIN d ON item = dict_name GROUP BY item),
p AS (SELECT item, dict_id, 80 + 20.0 * length(dict_name) / length(item) AS score FROM i JOIN d ON contains(item, dict_name) UNION ALL SELECT item, dict_id, 75 + 20.0 * length(item) / length(dict_name) FROM i JOIN d ON contains(dict_name, item)),
c AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, dict_id) AS k FROM p WHERE item NOT IN (SELECT item FROM e))
SELECT item, dict_id, 100.0 AS score, 'exact' AS how FROM e UNION ALL SELECT item, dict_id, round(score, 6), 'contained' FROM c WHERE k = 1
UNION ALL SELECT item, NULL, 0.0, 'none' FROM i WHERE item NOT IN (SELECT item FROM e) AND item NOT IN (SELECT item FROM c)""")
def progressive_match(spark, sf):
    part = read(spark, sf, "part")
    items = part.select(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("item")).distinct().withColumn("name", F.col("item"))
    d = None
    for name in (F.col("p_name"), F.concat("p_name", F.lit(" 7")), F.concat(F.lit("steel "), "p_name", F.lit(" 33 set"))):
        one = part.groupBy(name.alias("dict_name")).agg(F.min("p_partkey").alias("dict_id"))
        d = one if d is None else d.unionByName(one)
    return similarity.progressive(items, d).withColumn("score", F.round("score", 6))


# --- periods ---

_PRICED = "active AND data_source_type = 'completed' AND unit_rate_cents IS NOT NULL"


@query(f"""{WITH_KEYS}, p AS (SELECT item_name, CAST(date_trunc('year', price_period) AS DATE) AS period, avg(unit_rate_cents) AS rate, count(*) AS n FROM keyed WHERE {_PRICED} GROUP BY ALL),
b AS (SELECT item_name, rate AS base FROM p WHERE period = DATE '1995-01-01')
SELECT period, count(*) AS n, count(*) FILTER (WHERE abs(rate - base) > 0.1 * base) AS n_anomalies, round(100.0 * count(*) FILTER (WHERE abs(rate - base) > 0.1 * base) / count(*), 4) AS pct FROM p JOIN b USING (item_name) WHERE period <> DATE '1995-01-01' GROUP BY ROLLUP (period)""")
def period_anomaly(spark, sf):
    """Yearly prices of each item against the base year, by year and over all."""
    p = pricing.priced(boq(spark, sf)).groupBy("item_name", F.trunc("price_period", "year").alias("period")).agg(F.avg("unit_rate_cents").alias("rate"))
    base = p.filter("period = DATE '1995-01-01'").select("item_name", F.col("rate").alias("base"))
    odd = F.abs(F.col("rate") - F.col("base")) > 0.1 * F.col("base")
    return p.filter("period <> DATE '1995-01-01'").join(base, "item_name").rollup("period").agg(F.count("*").alias("n"), F.count_if(odd).alias("n_anomalies"), F.round(100 * F.count_if(odd) / F.count("*"), 4).alias("pct"))


@query(f"""{WITH_BOQ}, p AS (SELECT item_name, date_trunc('year', price_period) AS y, unit_rate_cents FROM boq WHERE {_PRICED}), k AS (SELECT count(DISTINCT y) AS k FROM p)
SELECT item_name, count(DISTINCT y) AS n_periods, round(avg(unit_rate_cents), 4) AS mean_rate, CAST(median(unit_rate_cents) AS DOUBLE) AS median_rate FROM p GROUP BY item_name HAVING count(DISTINCT y) = (SELECT k FROM k)""")
def complete_periods(spark, sf):
    """Items with a price in every year."""
    p = pricing.priced(boq(spark, sf)).select("item_name", F.trunc("price_period", "year").alias("y"), "unit_rate_cents")
    k = p.agg(F.countDistinct("y").alias("k"))
    g = p.groupBy("item_name").agg(F.countDistinct("y").alias("n_periods"), F.round(F.avg("unit_rate_cents"), 4).alias("mean_rate"), F.median("unit_rate_cents").alias("median_rate"))
    return g.join(F.broadcast(k), F.col("n_periods") == F.col("k"), "left_semi")


_BASE = """WITH b AS (SELECT p_type AS name, p_brand AS spec, round(avg(p_retailprice), 6) AS base FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), a AS (SELECT p_type AS name, round(avg(p_retailprice), 6) AS base FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
i AS (SELECT p_partkey, p_type, p_brand FROM part WHERE p_partkey % 2 = 1)"""


@query(f"""{_BASE} SELECT p_partkey, CASE WHEN b.base IS NOT NULL THEN 'spec' WHEN a.base IS NOT NULL THEN 'name' ELSE 'none' END AS how, coalesce(b.base, a.base) AS base
FROM i LEFT JOIN b ON p_type = b.name AND p_brand = b.spec AND b.spec <> 'Brand#7' LEFT JOIN a ON p_type = a.name""")
def baseline_cascade(spark, sf):
    """Baseline price by name and spec, else by name: two joins, the second over what the first left."""
    part = read(spark, sf, "part")
    even = part.filter("p_partkey % 2 = 0")
    by_spec = even.filter("p_brand <> 'Brand#7'").groupBy("p_type", "p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("base"))
    by_name = even.groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("base"))
    items = part.filter("p_partkey % 2 = 1").select("p_partkey", "p_type", "p_brand")
    one = items.join(by_spec, ["p_type", "p_brand"]).select("p_partkey", F.lit("spec").alias("how"), "base")
    rest = items.join(by_spec, ["p_type", "p_brand"], "left_anti").join(by_name, "p_type", "left")
    return one.unionByName(rest.select("p_partkey", F.when(F.col("base").isNull(), "none").otherwise("name").alias("how"), "base"))


# --- learning ---


def confirmations(spark, sf):
    """Confirmations and rejections made of the events: an algorithm hit, or had the confirmed one at a place, with a score."""
    e, n = read(spark, sf, "events"), F.col("event_id")
    hit = {"edit": n % 3 != 0, "tfidf": n % 2 != 0, "vector": F.col("value") > 20}
    each = [hit[a].cast("int").alias(f"{a}_hit") for a in hit]
    each += [((n + i) % 5 - 1).cast("int").alias(f"{a}_rank") for i, a in enumerate(hit)]
    each += [(n * m % 101).cast("double").alias(f"{a}_score") for a, m in zip(hit, (7, 13, 29), strict=True)]
    return e.select(
        F.col("event_type").alias("category"), "ts", n.alias("id"), (n % 2).cast("int").alias("hit"), F.col("user_id"), *each,
        (n % 11 / 10).alias("quality"), F.when(n % 17 == 0, (n % 3).cast("int")).alias("rejected"),
    )


_HITS = """WITH r AS (SELECT event_type AS category, event_id AS id, avg(event_id % 2) OVER w AS rate, count(*) OVER w AS seen FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""


@query(f"{_HITS} SELECT category, id, round(rate, 6) AS rate, seen FROM r")
def hit_rate_window(spark, sf):
    return learning.hit_rates(confirmations(spark, sf).select("category", "ts", "id", "hit")).select("category", "id", F.round("rate", 6).alias("rate"), "seen")


@query(f"{_HITS} SELECT category, count(*) AS n, count(*) FILTER (WHERE seen >= 25 AND rate < 0.5) AS n_drift FROM r GROUP BY category")
def drift_flags(spark, sf):
    rated = learning.hit_rates(confirmations(spark, sf).select("category", "ts", "id", "hit"))
    return learning.drift(rated).groupBy("category").agg(F.count("*").alias("n"), F.count_if("drift").alias("n_drift"))


@query("""WITH c AS (SELECT event_id AS id, user_id, event_type AS category, ts, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events),
w AS (SELECT id, list({'c': category, 'n': n}) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS l FROM c),
u AS (SELECT id, len(l) AS n_seen, list_distinct(list_transform(l, lambda x: x.c)) AS kinds, l FROM w)
SELECT *, n_seen >= 25 AND n_new >= 0.5 * n_categories AS surge FROM (SELECT id, n_seen, len(kinds) AS n_categories, len(list_filter(kinds, lambda k: list_max(list_transform(list_filter(l, lambda x: x.c = k), lambda x: x.n)) < 5)) AS n_new FROM u)""")
def category_surge(spark, sf):
    """For every event, how many of the kinds among the last fifty of its user are new to the user."""
    return learning.surges(confirmations(spark, sf), "user_id").select("id", "n_seen", "n_categories", "n_new", "surge")


_IDS = "[event_id % 3, event_id % 5 % 3, event_id % 7 % 3]"
_FIRST = "[CAST(event_id * 7 % 101 AS DOUBLE), event_id * 13 % 101, event_id * 29 % 101]"


def _arrays():
    n = F.col("event_id")
    ids = F.array(n % 3, n % 5 % 3, n % 7 % 3)
    first = F.array(*[(n * m % 101).cast("double") for m in (7, 13, 29)])
    return ids, first, F.transform(first, lambda x: x - n % 20)


@query(f"""WITH q AS (SELECT event_id AS id, event_type AS category, {_IDS} AS ids, {_FIRST} AS a, event_id % 20 AS g, length(props) AS len, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
t AS (SELECT *, list_filter(a, lambda x: x > 0) AS real, list_filter(a, lambda x: x > 0 AND x - g > 0) AS gaps FROM q),
u AS (SELECT *, round(least(1.0, 0.35 * len(list_distinct(ids)) / 3 + CASE WHEN len(real) > 0 THEN 0.25 * greatest(0.0, 1 - list_avg(real) / 90) ELSE 0 END
 + CASE WHEN len(gaps) > 0 THEN 0.25 * greatest(0.0, 1 - g / 15.0) ELSE 0 END + CASE WHEN len(real) < 3 THEN 0.15 * (1 - len(real) / 3.0) ELSE 0 END) + 1e-9, 4) AS u FROM t)
SELECT id, category, u AS uncertainty, round(0.7 * u + CASE WHEN k = 1 THEN 0.2 ELSE 0 END + 0.1 * least(1.0, len / 50.0) + 1e-9, 4) AS priority, CASE WHEN u >= 0.6 THEN 'high' WHEN u >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM u""")
def uncertainty_queue(spark, sf):
    e = read(spark, sf, "events")
    items = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), learning.uncertainty(*_arrays()).alias("uncertainty"), F.length("props").alias("length"))
    return learning.queue(items).select("id", "category", "uncertainty", "priority", learning.uncertainty_level(F.col("uncertainty")).alias("level"))


@query(f"""WITH q AS (SELECT event_id AS id, {_IDS} AS ids, list_filter({_FIRST}, lambda x: x > 0) AS real FROM events),
v AS (SELECT id, len(list_distinct(ids)) AS k, CASE WHEN len(real) >= 2 THEN 1 - least(1.0, list_var_pop(real) / 100) ELSE 0.5 END AS c FROM q)
SELECT id, round(CASE WHEN k = 1 THEN least(0.4, 0.4 * c) ELSE 0.6 * (k - 1) / 2 + 0.4 * c END, 6) AS quality FROM v""")
def info_quality(spark, sf):
    ids, first, _ = _arrays()
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(learning.info_quality(ids, first), 6).alias("quality"))


_STEP = """CASE WHEN {h} THEN lr * (1 + 0.3 * {s} / 100) WHEN {r} >= 0 THEN -lr * (1 - 0.2 * {r}) ELSE -0.5 * lr END"""
_MOVED = lambda i: "0.3 * greatest(0.05, least(0.85, w%d + %s)) + 0.7 * w%d" % (i, _STEP.format(h=f"h{i}", s=f"s{i}", r=f"r{i}"), i)
_LESS = lambda i: f"CASE WHEN rejected = {i - 1} THEN greatest(0.05, w{i} - 0.5 * lr) ELSE w{i} END"
def _fold_sql(n: str) -> str:
    """The replay as a recursion; n: the number of confirmations by which the phase goes."""
    return f"""WITH RECURSIVE e AS (SELECT event_type AS category, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, event_id % 3 <> 0 AS h1, event_id % 2 <> 0 AS h2, value > 20 AS h3,
 event_id % 5 - 1 AS r1, (event_id + 1) % 5 - 1 AS r2, (event_id + 2) % 5 - 1 AS r3, CAST(event_id * 7 % 101 AS DOUBLE) AS s1, CAST(event_id * 13 % 101 AS DOUBLE) AS s2, CAST(event_id * 29 % 101 AS DOUBLE) AS s3,
 event_id % 11 / 10.0 AS q, CASE WHEN event_id % 17 = 0 THEN event_id % 3 END AS rejected, count(*) FILTER (WHERE event_id % 17 <> 0) OVER (ORDER BY ts, event_id) AS overall FROM events),
s AS (SELECT DISTINCT category, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n, CAST(0.3 AS DOUBLE) AS w1, CAST(0.35 AS DOUBLE) AS w2, CAST(0.35 AS DOUBLE) AS w3 FROM e
 UNION ALL SELECT category, k, n, round(a1 / (a1 + a2 + a3), 4), round(a2 / (a1 + a2 + a3), 4), round(a3 / (a1 + a2 + a3), 4) FROM (
  SELECT category, k, n, CASE WHEN rejected IS NULL THEN {_MOVED(1)} ELSE {_LESS(1)} END AS a1, CASE WHEN rejected IS NULL THEN {_MOVED(2)} ELSE {_LESS(2)} END AS a2, CASE WHEN rejected IS NULL THEN {_MOVED(3)} ELSE {_LESS(3)} END AS a3 FROM (
   SELECT e.*, s.w1, s.w2, s.w3, CASE WHEN rejected IS NULL THEN s.n + 1 ELSE s.n END AS n,
    greatest(0.02, least(0.25, 0.1 * CASE WHEN {n} < 100 THEN 1.5 WHEN {n} < 500 THEN 1.0 ELSE 0.5 END * (1 + CASE WHEN rejected IS NULL THEN q ELSE 0.5 END))) AS lr
   FROM s JOIN e ON s.category = e.category AND e.k = s.k + 1)))"""


_FOLD = _fold_sql("CASE WHEN rejected IS NULL THEN s.n + 1 ELSE s.n END")


@query(f"{_fold_sql('overall')} SELECT category, n, round(w1, 3) AS edit, round(w2, 3) AS tfidf, round(w3, 3) AS vector FROM s QUALIFY row_number() OVER (PARTITION BY category ORDER BY k DESC) = 1")
def learned_weights(spark, sf):
    """Weights of each category, its phase by the confirmations of all."""
    out = learning.replay(confirmations(spark, sf), overall=True)
    return out.select("category", "n", *[F.round(a, 3).alias(a) for a in learning.ALGORITHMS])


_PLAIN = lambda i: f"greatest(0.1, least(0.8, w{i} + CASE WHEN h{i} THEN 0.1 ELSE -0.1 END))"


@query(f"""WITH RECURSIVE e AS (SELECT event_type AS category, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, event_id % 3 <> 0 AS h1, event_id % 2 <> 0 AS h2, value > 20 AS h3 FROM events WHERE event_id % 17 <> 0),
s AS (SELECT DISTINCT category, CAST(0 AS BIGINT) AS k, CAST(0.3 AS DOUBLE) AS w1, CAST(0.35 AS DOUBLE) AS w2, CAST(0.35 AS DOUBLE) AS w3 FROM e UNION ALL
 SELECT category, k, round(a1 / (a1 + a2 + a3), 4), round(a2 / (a1 + a2 + a3), 4), round(a3 / (a1 + a2 + a3), 4) FROM (SELECT e.category, e.k, {_PLAIN(1)} AS a1, {_PLAIN(2)} AS a2, {_PLAIN(3)} AS a3 FROM s JOIN e ON s.category = e.category AND e.k = s.k + 1))
SELECT category, k AS n, round(w1, 3) AS edit, round(w2, 3) AS tfidf, round(w3, 3) AS vector FROM s QUALIFY row_number() OVER (PARTITION BY category ORDER BY k DESC) = 1""")
def plain_weights(spark, sf):
    out = learning.replay(confirmations(spark, sf), plain=True)
    return out.select("category", "n", *[F.round(a, 3).alias(a) for a in learning.ALGORITHMS])


@query("""WITH e AS (SELECT event_type AS category, event_id % 17 = 0 AS rj, event_id % 3 AS a, event_id % 3 <> 0 AS h1, event_id % 2 <> 0 AS h2, value > 20 AS h3, event_id % 11 > 6 AS high FROM events)
SELECT category, count(*) FILTER (WHERE NOT rj) AS n_confirmed, count(*) FILTER (WHERE rj) AS n_rejected, count(*) FILTER (WHERE NOT rj AND high) AS n_high,
 round(count(*) FILTER (WHERE NOT rj AND h1) / count(*) FILTER (WHERE (NOT rj AND h1) OR (rj AND a = 0)), 4) AS edit_rate, round(count(*) FILTER (WHERE NOT rj AND h2) / count(*) FILTER (WHERE (NOT rj AND h2) OR (rj AND a = 1)), 4) AS tfidf_rate,
 round(count(*) FILTER (WHERE NOT rj AND h3) / count(*) FILTER (WHERE (NOT rj AND h3) OR (rj AND a = 2)), 4) AS vector_rate FROM e GROUP BY category""")
def learning_stats(spark, sf):
    return learning.stats(confirmations(spark, sf))


# 0.9 to the power of 400 is nothing at six decimals
@query("""WITH e AS (SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) AS k, avg(event_id % 3 // 2) OVER (ORDER BY ts, event_id ROWS 19 PRECEDING) AS rate FROM events),
s AS (SELECT a.k, sum(0.1 * pow(0.9, a.k - b.k) * (0.5 + 0.4 * b.rate)) AS moved FROM e a JOIN e b ON b.k BETWEEN greatest(20, a.k - 400) AND a.k GROUP BY a.k)
SELECT id, round(0.7 * pow(0.9, greatest(0, e.k - 19)) + coalesce(moved, 0), 6) AS fusion FROM e LEFT JOIN s USING (k)""")
def fusion_share(spark, sf):
    """The share of the best strategy after every confirmation, over the one sequence of all confirmations."""
    e = read(spark, sf, "events").select("ts", F.col("event_id").alias("id"), F.expr("event_id % 3 div 2").cast("int").alias("hit"))
    return learning.fusion(e, chunk=1000).select("id", F.round("fusion", 6).alias("fusion"))


@query()
def stream_equals_batch(spark, sf):
    """Weights from a stream of the same confirmations, next to those of the batch replay."""
    from ..streaming import streams

    base, name = shared_dir(spark), f"learn_{uuid.uuid4().hex}"
    made = confirmations(spark, sf)
    made.write.parquet(f"{base}/{name}/in")  # the stream reads what the batch has
    rows = spark.readStream.schema(made.schema).parquet(f"{base}/{name}/in")
    q = streams.learn(rows).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/{name}/out/batch={i}"))
    q.option("checkpointLocation", f"{base}/{name}/state").trigger(availableNow=True).start().awaitTermination()
    last = Window.partitionBy("category").orderBy(F.desc("n"))
    streamed = spark.read.parquet(f"{base}/{name}/out").withColumn("r", F.row_number().over(last)).filter("r = 1")
    numbers = [*learning.ALGORITHMS, *[f"fused_{a}" for a in learning.ALGORITHMS], "fusion"]
    both = streamed.select("category", F.col("n").alias("n_stream"), *[F.col(a).alias(f"s_{a}") for a in numbers]).join(learning.replay(made), "category")
    same = F.lit(True)
    for a in numbers:
        same = same & (F.abs(F.col(a) - F.col(f"s_{a}")) < 1e-9)
    return both.select("category", "n", "n_stream", same.alias("same"))
