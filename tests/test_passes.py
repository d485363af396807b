"""How often a query reads the bill, and where its rows meet: what decides whether it grows with its input."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from boqspark import shared
from boqspark.functions import classify
from boqspark.operators import analysis, matching, merge, pricing, quality, tree
from boqspark.operators import similarity as sim
from boqspark.plans import registry
from boqspark.plans.proxy import boq

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["mapping_coverage", "version_layers", "unmapped_codes", "import_gate"])
def test_the_bill_is_read_once(spark, name):
    """F7, F8, F10, F12: what is left to do starts from counted codes or from narrow rows, not from the lines again."""
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "l_orderkey" not in plan and "l_partkey" not in plan


def test_parts_are_joined_last(spark):
    """F14, F16: the lines are shuffled twice, never with the names of their parts."""
    lines = plan_of(boq(spark, SF)).splitlines()
    assert "p_partkey" in next(x for x in lines if "Join" in x)


def test_equal_texts_are_taken_apart_once(spark, monkeypatch):
    """F5."""
    seen, parts = [], sim.parts
    monkeypatch.setattr(sim, "parts", lambda df, *a, **k: (seen.append(df.count()), parts(df, *a, **k))[1])
    texts = spark.range(40).select(F.col("id").alias("item"), F.when(F.col("id") % 2 == 0, "steel pipe red").otherwise("no").alias("text"))
    names = spark.createDataFrame([("pipe", 3), ("pipe", 2), ("red", 5), ("x", 1)], "dict_name string, dict_id long")
    got = sorted(map(tuple, matching.contained_names(texts, names, "item", "text").collect()))
    assert got == sorted((i, d, n) for i in range(0, 40, 2) for d, n in ((2, "pipe"), (5, "red")))
    assert seen == [2]


def test_ended_chains_do_not_meet_in_one_task(spark):
    """nodes without a parent are spread by their own id."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.range(400).select("id", F.lit("l1").alias("level"), F.lit(None).cast("long").alias("parent_id"), F.lit("a").alias("name"))
        rows = tree.chains(nodes, ["name"]).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in rows) < 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_descendants_count_and_name(spark):
    rows = [(1, "l1", None, "a"), (2, "l2", 1, "b"), (3, "l3", 2, "b"), (4, "l4", 3, "c"), (5, "l5", 4, "d"), (6, "l5", 4, "e")]
    nodes = spark.createDataFrame(rows, "id long, level string, parent_id long, name string")
    got = {r.id: (r.path, r.n_below, r.n_leaves, r.n_names) for r in tree.descendants(nodes).collect()}
    assert got == {1: ("a", 5, 2, 1), 2: ("a/b", 4, 2, 1), 3: ("a/b", 3, 2, 1), 4: ("a/b/c", 2, 2, 0)}


def test_classifier_looks_for_words_without_patterns(spark):
    """F11."""
    assert str(classify.by_text(F.col("t"))).lower().count("rlike") <= 6
    texts = ["C30 x", "砼", "混凝土 桥架", "p.o 325", "白水泥", "白水泥砂浆", "hrb400", "钢筋", "电缆", "电缆头", "ppr", "Upvc", "pp管", "per", "pe-r", "hdpe", "dn 5", "De7", "铜管", "铜管 法兰", "线管 SC 20", "400", "", None]
    want = ["混凝土", "混凝土", "混凝土", "水泥", "水泥", None, "钢筋", "钢筋", "电线电缆", None, "管道", "管道", "管道", "管道", "管道", "管道", "管道", "管道", "管道", None, "管道", None, None, None]
    want[2] = None
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.f for r in df.select("i", classify.by_text(F.col("t")).alias("f")).orderBy("i").collect()] == want


def test_pool_is_written_once(spark):
    """the number of new lines and the lines themselves come from one classification."""
    from boqspark.functions.codes import with_keys

    plan = plan_of(analysis.pool(pricing.priced(with_keys(boq(spark, SF))), F.lit("1998-09-15").cast("date"), 6))
    assert "l_orderkey" not in plan and "l_partkey" not in plan


def test_prematch_writes_what_it_reads(spark, monkeypatch):
    """lines are written with the columns that matching takes, the pool's dictionary without leaves; the mapping sorts no lines."""
    from boqspark.plans import flow_queries, work_queries

    written = {}
    for name in ("cut", "kept"):
        old = getattr(flow_queries, name)
        monkeypatch.setattr(flow_queries, name, lambda df, *at, old=old: written.setdefault(tuple(df.columns), old(df, *at)))
    flow_queries.prematch_top5(spark, SF)
    lines = next(c for c in written if "code9" in c)
    assert len(lines) == 7 and "match_key" not in lines
    nodes = next(df for c, df in written.items() if c == ("id", "level", "parent_id", "name"))
    whole = work_queries.dictionary(spark, SF).filter("level <> 'l5'")
    assert nodes.exceptAll(whole).count() == 0 == whole.exceptAll(nodes).count()
    plan = flow_queries.match_mapping(written[lines])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys?=\[item_code_version[^\]]*item_name", plan)


def test_a_batch_is_whole_in_its_task(spark):
    """a join by batch before the checksum may be split at run time; the checksum's batches are not."""
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "adaptive.advisoryPartitionSizeInBytes": "20k", "adaptive.skewJoin.skewedPartitionFactor": "1", "shuffle.partitions": "32"}
    before = {c: spark.conf.get(f"spark.sql.{c}") for c in conf}
    lines = spark.range(0, 60_000, 1, 8).select((F.col("id") % 3).alias("import_batch_id"), F.col("id").alias("sequence"), "id", F.lit("0304").alias("item_code"), F.sha2(F.col("id").cast("string"), 256).alias("item_name"), F.lit(7).alias("total_cents"), F.lit(True).alias("active"))
    try:
        want = sorted(map(tuple, quality.batch_checksum(lines).collect()))
        for c, v in conf.items():
            spark.conf.set(f"spark.sql.{c}", v)
        touched = spark.range(3).withColumnRenamed("id", "import_batch_id")
        got = sorted(map(tuple, quality.batch_checksum(lines.join(touched, "import_batch_id", "left_semi")).collect()))
    finally:
        for c, v in before.items():
            spark.conf.set(f"spark.sql.{c}", v)
    assert got == want and [x[1] for x in got] == [20_000] * 3


def test_pairs_are_complete_after_one_shuffle(spark, monkeypatch):
    """a pair is one row when the first step is written, with the fields that the result has to have; inactive rows are not in it."""
    seen, keep = [], merge.kept
    monkeypatch.setattr(merge, "kept", lambda df, *a: (seen.append(keep(df, *a)), seen[-1])[1])
    line = lambda i, q: (i, i % 2, i // 2 + 1, f"c{i}", "pipe", "m", q, None)
    schema = "id long, import_batch_id long, sequence long, item_code string, item_name string, unit_std string, quantity long, std_name string"
    old = spark.createDataFrame([line(i, 1) for i in range(40)], schema).withColumn("active", F.col("id") < 30)
    new = spark.createDataFrame([line(i, 2) for i in range(20)], schema).withColumn("active", F.lit(True))
    got = {r.id: (r.change, r.quantity, r.active) for r in merge.upsert(old, new, columns=["quantity"]).collect()}
    assert got == {i: ("updated", 2, True) if i < 20 else ("orphaned", 1, False) if i < 30 else ("kept", 1, False) for i in range(40)}
    assert seen[0].count() == 30 and seen[0].filter("done AND item_code IS NOT NULL").count() == 0


def test_a_written_step_leaves_no_shuffle_files(spark):
    """F2."""
    roots = os.environ.get("SPARK_LOCAL_DIRS", spark.conf.get("spark.local.dir")).split(",")
    held = lambda: {os.path.join(at, x) for root in roots for at, _, names in os.walk(root) for x in names if x.startswith("shuffle_")}
    before = held()
    assert shared.kept(spark.range(200_000).repartition("id")).count() == 200_000
    wait = time.time() + 20
    while (left := {x for x in held() - before if "_0.data" in x and os.path.getsize(x) > 2000}) and time.time() < wait:
        time.sleep(0.2)
    assert not left
