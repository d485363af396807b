import datetime
import random

import pytest
from pyspark.sql import functions as F

from boqspark.operators import learning, merge, pricing, search, similarity, tree, validate


def prices(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, unit_rate_cents long, quantity long, price_period date")


DAY = datetime.date(2026, 3, 1)


def test_weighted_average_and_dedup(spark):
    df = prices(spark, [("a", 5000, 100, DAY), ("a", 5500, 200, DAY)])
    row = pricing.group_prices(df, "k").first()
    assert round(row.avg_rate / 100, 2) == 53.33 and row.n == 2
    df = prices(spark, [("a", 5000, 100, DAY), ("a", 5000, 200, DAY), ("a", 5500, 300, DAY)])
    row = pricing.group_prices(pricing.newest_first(df, "k"), "k").first()
    assert row.n == 2 and row.avg_rate / 100 == 53.75


def test_null_key_is_a_group_and_zero_quantity_counts_as_one(spark):
    rows = {r.k: r for r in pricing.group_prices(prices(spark, [(None, 100, 0, DAY), (None, 300, None, DAY), ("a", 5, 1, DAY)]), "k").collect()}
    assert rows[None].avg_rate == 200 and rows["a"].n == 1


def test_recent_falls_back(spark):
    old = datetime.date(2020, 1, 1)
    five = prices(spark, [("a", 5000, 1, DAY)] * 5 + [("a", 9000, 1, old)] * 5)
    two = prices(spark, [("a", 5000, 1, DAY)] * 2 + [("a", 9000, 1, old)] * 5)
    today = F.lit(datetime.date(2026, 4, 2))
    assert pricing.recent(five, today, 6, 3, "k").count() == 5
    assert pricing.recent(two, today, 6, 3, "k").count() == 7


def test_trim_and_quantiles(spark):
    df = prices(spark, [("a", v, 1, DAY) for v in (10, 11, 12, 13, 14, 15, 16, 1000)])
    k = pricing.kpis(df, "k").first()
    assert (k.n, k.n_outliers, k.q1, k.q2, k.q3, k.max_rate) == (7, 1, 11, 13, 15, 16)  # seven are left: places 1, 3 and 5


def test_histogram_of_equal_rates(spark):
    rows = pricing.histogram(prices(spark, [("a", 7, 1, DAY)] * 3)).collect()
    assert [(r.bin, r.n) for r in rows] == [(0, 3)]


COLUMNS = "id long, import_batch_id long, sequence long, item_code string, item_name string, item_feature string, unit_std string, quantity long, total_cents long, anomaly_flag string, std_name string, std_spec string, material_dict_id long, active boolean"


def bill(spark, rows):
    return spark.createDataFrame([(i, 1, s, c, n, "", "m", q, 1, "normal", std, None, None, True) for i, s, c, n, q, std in rows], COLUMNS)


def test_upsert(spark):
    old = bill(spark, [(1, 1, "a", "x", 1, None), (2, 2, "b", "y", 1, "kept"), (3, 3, "c", "z", 1, None)])
    new = bill(spark, [(11, 1, "a", "x", 5, "new"), (12, 2, "b", "y", 6, "new")])
    out = {r.id: r for r in merge.upsert(old, new).collect()}
    assert {r.change for r in out.values()} == {"updated", "orphaned"} and not out[3].active
    assert out[3].anomaly_flag == "normal"
    assert out[1].quantity == 5 and out[1].std_name == "new" and out[2].std_name == "kept"


def test_upsert_moves_by_key_and_is_idempotent(spark):
    old, new = bill(spark, [(1, 1, "a", "x", 1, None)]), bill(spark, [(9, 5, "a", "x", 2, None)])
    first = merge.upsert(old, new)
    assert [(r.change, r.sequence) for r in first.collect()] == [("updated", 5)]
    again = merge.upsert(first.withColumn("item_feature", F.lit("")), new)
    assert [(r.change, r.quantity) for r in again.collect()] == [("updated", 2)]


def test_upsert_leaves_other_batches_untouched(spark):
    old = bill(spark, [(1, 1, "a", "x", 1, None), (2, 2, "b", "y", 1, None), (3, 1, "a", "x", 1, "kept"), (4, 1, "c", "z", 4, None)])
    old = old.withColumn("import_batch_id", F.when(F.col("id") <= 2, 1).otherwise(F.col("id") - 1)).withColumn("active", F.col("id") != 4)
    new = bill(spark, [(11, 1, "a", "x", 5, None)])
    out = {r.id: r for r in merge.upsert(old, new).collect()}
    assert {i: (r.change, r.active, r.quantity) for i, r in out.items()} == {1: ("updated", True, 5), 2: ("orphaned", False, 1), 3: ("kept", True, 1), 4: ("kept", False, 4)}
    before = {r.id: r for r in old.select(*merge.upsert(old, new).drop("change").columns).collect()}
    assert all(before[i] == tuple(out[i])[:-1] for i in (3, 4))
    emptied = spark.createDataFrame([(1,), (2,)], "import_batch_id long")
    assert {r.id: r.change for r in merge.upsert(old, new, emptied).collect()} == {1: "updated", 2: "orphaned", 3: "orphaned", 4: "kept"}


def test_audit_and_confirmations(spark):
    df = spark.createDataFrame([(1, "error", "completed"), (2, "warning", "completed")], "id long, anomaly_flag string, data_source_type string")
    ids = df.select("id")
    after = merge.confirm_anomalies(df, ids, "warning")
    rows = merge.audit(df, after, ["anomaly_flag"], "me", "seen").collect()
    assert [(r.id, r.old_value, r.new_value) for r in rows] == [(1, "error", "warning")]
    with pytest.raises(ValueError):
        merge.switch_source(df, ids, "completed")


def test_tree(spark):
    rows = spark.createDataFrame([("a", "b", "b", "c", "1"), ("a", "b", "b", "c", "2"), ("z", "y", "x", "w", "3")], "l1 string, l2 string, l3 string, l4 string, l5 string")
    nodes = tree.build(rows, [F.col(f"l{i}") for i in range(1, 6)])
    paths = {r.path for r in tree.paths(nodes).collect()}
    assert "a/b/c/1" in paths and "z/y/x/w/3" in paths
    assert tree.checks(nodes).count() == 0
    codes = {r.new_code for r in tree.recode(nodes).filter("level = 'l5'").collect()}
    assert codes == {"I00101010010001", "I00101010010002", "I00201010010001"}
    loop = spark.createDataFrame([(1, "l1", 2, "a"), (2, "l2", 1, "b")], "id long, level string, parent_id long, name string")
    assert tree.paths(loop).count() == 2


def test_similarity(spark):
    got = spark.range(1).select(similarity.indel_ratio(F.lit("kitten"), F.lit("sitting")).alias("a"), similarity.indel_ratio(F.lit(""), F.lit("")).alias("b"), similarity.indel_ratio(F.lit(""), F.lit("x")).alias("c")).first()
    assert round(got.a, 2) == 61.54 and got.b == 0 and got.c == 0


def best_contained(name, dictionary):
    scored = [(100.0, -i, i, "exact") for i, d in dictionary if d == name]
    scored = scored or [(80 + 20 * len(d) / len(name), -i, i, "contained") for i, d in dictionary if len(d) >= 2 and d in name]
    if not scored or scored[0][3] != "exact":
        scored += [(75 + 20 * len(name) / len(d), -i, i, "contained") for i, d in dictionary if len(name) >= 2 and name in d]
    score, _, i, how = max(scored, default=(0.0, 0, None, "none"))
    return i, round(score, 6), how


def test_containment_in_both_directions(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("电力缆铜 ab") for _ in range(rng.randint(1, n)))
    names = sorted({"铜芯电力电缆", "电力电缆", "阻燃", "x", "电", *(text(6) for _ in range(150))})
    dictionary = list(enumerate(["电力电缆", "阻燃电力电缆", "阻燃电力电缆", "电", "Ab", *(text(8) for _ in range(60))]))
    items = spark.createDataFrame([(n, n) for n in names], "item string, name string")
    rows = similarity.progressive(items, spark.createDataFrame(dictionary, "dict_id long, dict_name string")).collect()
    assert {r.item: (r.dict_id, round(r.score, 6), r.how) for r in rows} == {n: best_contained(n, dictionary) for n in names}
    assert len(rows) == len(names) and best_contained("铜芯电力电缆", dictionary) == (0, 93.333333, "contained")


def test_synonyms_of_all_groups():
    assert len(search.SYNONYMS) == 13
    for word, other in (("配电箱", "开关柜"), ("线槽", "桥架"), ("阀门", "球阀"), ("土方", "回填土"), ("pvc管", "塑料管"), ("混凝土", "砼")):
        assert other in search.variants(word)
    assert search.variants("red") == ["red"]


def indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(max(row[-1], old[j + 1], old[j] + (x == y)))
    return 200.0 * row[-1] / (len(a) + len(b))


def test_best_by_edit_equals_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("电力缆铜Ab") for _ in range(rng.randint(1, n)))
    names = sorted({"电缆", "电", "配电箱", "none", *(text(5) for _ in range(25)), *(text(14) for _ in range(25))})
    dictionary = sorted({"电缆", "电", "配电箱", "电力电缆", *names[::3], *(n + "铜" for n in names[::2]), *(text(7) for _ in range(40))})
    left, right = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(d,) for d in dictionary], "dict_name string")
    near = similarity.near_pairs(left, right, "name", "dict_name").collect()
    assert sorted((r.name, r.dict_name) for r in near) == sorted((n, d) for n in names for d in dictionary if indel(n, d) > 80)
    got = {(r.name, r.rank): (r.dict_name, r.score) for r in similarity.best_by_edit(left, right, "name", "dict_name", 3).collect()}
    want = {}
    for n in names:
        best = sorted((-round(indel(n, d), 4), d) for d in dictionary if indel(n, d) > 0)[:3]
        want |= {(n, i + 1): (d, -score) for i, (score, d) in enumerate(best)}
    assert got == want


def test_validation(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "x", 0), (3, "x", 2)], "id long, name string, q long")
    rules = [validate.Rule("r", "required", "name"), validate.Rule("q", "range", "q", "warning", {"min": 0, "exclusive": True}), validate.Rule("u", "unique", "name", "info")]
    got = {(r.rule, r.n) for r in validate.report(df, rules).collect()}
    assert got == {("r", 1), ("q", 1), ("u", 2)}
    assert not validate.can_import(df, rules).first().can_import


def test_rules_from_a_table_and_their_summary(spark):
    df = spark.createDataFrame([(1, "a", "1"), (2, "", "-1"), (3, "b", "x")], "id long, name string, q string")
    table = spark.createDataFrame([("r", "required", "name", "error", None), ("q", "range", "q", "warning", '{"min": 0}'), ("e", "enum", "q", None, '{"values": ["1", "x"]}')], "name string, kind string, column string, level string, args string")
    s = validate.summary(df, validate.rules_from(table)).first()
    assert (s.total_rows, s.valid_rows, s.errors, s.warnings, s.infos, s.can_import) == (3, 2, 1, 2, 0, False)
    assert validate.summary(df.filter("false"), validate.rules_from(table)).first().can_import and set(validate.ENABLED) <= set(validate.TEMPLATES)


def test_learner_weights_stay_bounded():
    w = learning.Weights()
    for i in range(300):
        w.confirm([True, i % 2 == 0, False])
    assert abs(sum(w.values) - 1) < 1e-9 and w.values[0] > w.values[1] > w.values[2] > 0


def test_replay_equals_any_partitioning(spark):
    rows = [("a" if i % 3 else "b", i, i, i % 2, 1, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "category string, ts long, id long, edit_hit int, tfidf_hit int, vector_hit int")
    one, many = (sorted(map(tuple, learning.replay(df.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_a_sequence_matches_whatever_the_name(spark):
    """The human annotation of a line stays when its name changes: it is the line of that place."""
    old, new = bill(spark, [(1, 1, "a", "x", 1, "by hand")]), bill(spark, [(2, 1, "a", "x2", 3, None)])
    row = merge.upsert(old, new).collect()
    assert [(r.id, r.change, r.item_name, r.std_name, r.quantity) for r in row] == [(1, "updated", "x2", "by hand", 3)]


def test_equal_keys_pair_up_until_one_side_is_empty(spark):
    old = bill(spark, [(1, 10, "a", "X  y", 1, None), (2, 11, "a", "x y", 1, None)])
    new = bill(spark, [(7, 20, "a", "x y", 5, None), (8, 21, "a", "x Y", 6, None), (9, 22, "b", "z", 7, None)])
    got = {r.id: (r.change, r.sequence) for r in merge.upsert(old, new).collect()}
    assert got == {1: ("updated", 21), 2: ("updated", 20), 9: ("created", 22)}
    got = {r.id: (r.change, r.sequence) for r in merge.upsert(old, new.filter("id = 7")).collect()}
    assert got == {1: ("orphaned", 10), 2: ("updated", 20)}


def test_human_fields_and_inactive_rows_in_an_import(spark):
    old = bill(spark, [(1, 1, "a", "x", 1, None), (2, 2, "b", "y", 1, None)]).withColumn("anomaly_flag", F.when(F.col("id") == 1, "error").otherwise("normal")).withColumn("active", F.col("id") == 1)
    new = bill(spark, [(11, 1, "a", "x", 5, None), (12, 2, "b", "y", 6, None)]).withColumn("anomaly_flag", F.lit(None).cast("string"))
    got = {r.id: (r.change, r.active, r.anomaly_flag) for r in merge.upsert(old, new).collect()}
    assert got == {1: ("updated", True, "error"), 2: ("kept", False, "normal"), 12: ("created", True, "normal")}
    counts = {n: {r.change: r.n for r in merge.upsert_counts(merge.upsert(old.repartition(n), new.repartition(n))).collect()} for n in (1, 7)}
    assert counts[1] == counts[7]


def test_orphans_give_their_annotations_to_the_nearest_created_row(spark):
    rows = [(1, 1, 3, "orphaned", "n1", None), (2, 1, 9, "orphaned", "n2", "s2"), (3, 1, 4, "created", None, None), (4, 1, 10, "created", "own", None), (5, 2, 4, "created", None, None)]
    df = spark.createDataFrame([(i, b, s, c, n, p, 7) for i, b, s, c, n, p in rows], "id long, import_batch_id long, sequence long, change string, std_name string, std_spec string, material_dict_id long")
    got = {r.id: (r.std_name, r.std_spec, r.backfilled) for r in merge.backfill_from_orphans(df).collect()}
    assert got == {3: ("n1", None, True), 4: ("own", "s2", True), 5: (None, None, False)}


def test_kpis_of_few_rows_are_the_average_and_anomalies_count(spark):
    k = pricing.kpis(prices(spark, [("a", 100, 1, DAY), ("a", 200, 3, DAY)]), "k").first()
    assert (k.n, k.avg_rate, k.q1, k.q2, k.q3, k.n_anomalies) == (2, 175, 175, 175, 175, 0)
    k = pricing.kpis(prices(spark, [("a", 100, 1, DAY), ("a", 100, 1, DAY), ("a", 100, 1, DAY), ("a", 400, 1, DAY)]), "k").first()
    assert (k.n, k.avg_rate, k.n_anomalies) == (4, 175, 4)
    assert pricing.kpis(prices(spark, [("a", 100, 1, DAY)] * 3 + [("a", 400, 1, DAY)]), "k", share=0.9).first().n_anomalies == 1


def test_more_siblings_than_numbers_are_reported(spark):
    rows = spark.createDataFrame([("a", f"b{i:03d}", "c", "d", str(i)) for i in range(130)], "l1 string, l2 string, l3 string, l4 string, l5 string")
    codes = tree.recode(tree.build(rows, [F.col(f"l{i}") for i in range(1, 6)])).collect()
    second = [r for r in codes if r.level == "l2"]
    assert len({r.new_code for r in codes}) == len(codes) and sum(r.overflow for r in second) == 31
    problems = tree.code_problems(spark.createDataFrame([(r.level, r.new_code) for r in codes], "level string, new_code string")).collect()
    assert {r.problem for r in problems} == {"length"} and len(problems) == 4 * 31


def test_merge_moves_only_what_is_asked_for(spark):
    from boqspark.plans import work_queries as w

    old, new = w.before_after(spark, "/root/testdata/sf0.001")
    assert set(old.columns) == {"id", "import_batch_id", "sequence", "item_code", "item_name", "unit_std", "active", "part"} == set(new.columns)


def test_merge_of_one_large_key_has_no_square_frames(spark):
    """Frames from the row to the end of its group cost the square of the group; a key of all rows is merged and keeps every row."""
    n = 3000
    row = lambda k: f"id + {k} AS id, 1L AS import_batch_id, 2 * id + {k % 2} AS sequence, 'a' AS item_code, 'b' AS item_name, 'm' AS unit_std, 1L AS material_dict_id, 'x' AS std_name, true AS active"
    old, new = spark.range(1, n + 1).selectExpr(*row(0).split(", ")), spark.range(1, n + 1).selectExpr(*row(100_001).split(", "))
    result = merge.upsert(old, new)
    assert {r.change: r.n for r in merge.upsert_counts(result).collect()} == {"updated": n}
    asked = result.select("id", "sequence", "import_batch_id", "material_dict_id")
    near = merge.nearest(asked, asked.withColumn("sequence", F.col("sequence") + 1), ["import_batch_id", "material_dict_id"])
    for df in (result, near):
        plan = df._jdf.queryExecution().toString().lower()
        assert "currentrow$(), unboundedfollowing$()" not in plan
    assert near.filter("near IS NULL").isEmpty() and near.count() == n
