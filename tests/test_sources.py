import csv
import datetime
import io
import random

import pytest
from pyspark.sql import functions as F

from boqspark.operators import merge, quality, stored, tree
from boqspark.sources import ingest


def test_csv_to_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿某工程,,\n序号,项目名称,单位\n1,电缆,米\n2,,t\n", encoding="utf-8")
    rows = ingest.read_csv(spark, str(tmp_path / "a.csv"))
    got = [(r.item_name, r.unit, r.quantity) for r in ingest.records(rows).orderBy("row").collect()]
    assert got == [("电缆", "米", None), (None, "t", None)]


def test_workbook(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"sheets":[{"name":"s","rows":[["a","1"],["b",{"f":"=1+1","v":2}]]}]}')
    got = [(r.sheet, r.row, r.cells) for r in ingest.workbook(spark, str(tmp_path / "w.json")).orderBy("row").collect()]
    assert got == [("s", 1, ["a", "1"]), ("s", 2, ["b", "2"])]


def test_archive(spark, tmp_path):
    for name, text in (("a.csv", "x"), ("b.csv", "x"), ("c.csv", "y")):
        (tmp_path / name).write_text(text)
    found = ingest.files(spark, str(tmp_path))
    manifest = found.filter(F.col("path").endswith("c.csv")).select(F.col("path").alias("archive_path"), "sha256")
    assert ingest.to_archive(found, manifest).count() == 1
    extra = manifest.union(spark.createDataFrame([("file:/gone", "0")], "archive_path string, sha256 string"))
    assert {r.status for r in ingest.integrity(extra, found).collect()} == {"verified", "missing"}


def test_mapping(spark):
    from boqspark.sources import mapping

    heads = spark.createDataFrame([("f", 0, "项目编码"), ("f", 1, "项目名称(必填)"), ("f", 2, "名称"), ("f", 3, "xyz")], "path string, at int, header string")
    got = {r["at"]: r["field"] for r in mapping.propose(heads).collect()}
    assert got == {0: "item_code", 2: "item_name"} or got[0] == "item_code" and "item_name" in got.values()
    files = spark.createDataFrame([("a.csv", ["x", "y"]), ("b.csv", ["q"])], "path string, headers array<string>")
    templates = spark.createDataFrame([("t1", ["x", "y"], "a.*"), ("t2", ["x"], "zzz")], "template string, headers array<string>, pattern string")
    assert [(r.path, r.template) for r in mapping.recommend_template(files, templates).collect()] == [("a.csv", "t1")]
    m = spark.createDataFrame([("f", "h1", "item_code"), ("f", "h2", "item_code"), ("f", "h3", "nope")], "path string, header string, field string")
    assert {(r.problem, r.name) for r in mapping.mapping_problems(m).collect()} == {("unknown", "nope"), ("duplicate", "item_code"), ("missing", "item_name")}


def wild_csv(rng, rows, delimiter=",", end="\n"):
    out = io.StringIO()
    w = csv.writer(out, delimiter=delimiter, lineterminator=end)
    for i in range(rows):
        w.writerow([rng.choice(["电缆", "a", 'say "x"', "two\nlines", "x" * rng.randint(0, 60), "", f"v{delimiter}w", '"', "5\" pipe", "\n\n", "号"]) for _ in range(1 + i % 37)])
    return out.getvalue()


def cells_of(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.row, tuple(r.cells)) for r in df.collect())


def test_large_files_are_read_in_parts(spark, tmp_path):
    """Blocks of a few kilobytes: rows and cells are those of the reader of whole files, in every encoding; more than thirty columns stay."""
    rng = random.Random(4)
    (tmp_path / "a.csv").write_bytes(wild_csv(rng, 700).encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes(wild_csv(rng, 500, ";", "\r\n").encode("utf-8"))
    (tmp_path / "c.csv").write_bytes(wild_csv(rng, 500, "\t").encode("gbk"))
    (tmp_path / "d.csv").write_bytes("名称,x\n".encode("gbk") + b"\xff\xfe,1\n" * 40)
    (tmp_path / "e.csv").write_bytes(b'a,b\n5" pipe,6" pipe\n"open,1\n2')
    (tmp_path / "f.csv").write_bytes(b"")
    want = cells_of(ingest.read_csv_files(spark, str(tmp_path)))
    assert max(len(c) for _, _, c in want) == 37
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert ingest._lines(spark, str(tmp_path)).select("path", "block").distinct().count() > 20
        assert cells_of(ingest.read_csv(spark, str(tmp_path))) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert cells_of(ingest.read_csv(spark, str(tmp_path))) == want


@pytest.mark.parametrize("line", ['a,"b', 'a,b"c', '"a""', '"a"",b', '"a","b', '"a"x,"', 'x"y","', '""', '"",', ',"', '"a""b",c', '"'])
def test_open_quotes_as_the_csv_reader_sees_them(line):
    for inside in (False, True):
        text = ('"' if inside else "") + line + '\nEND",END'
        rows = list(csv.reader(io.StringIO(text, newline="")))
        assert ingest.stays_open(line.encode(), inside, b",") == ("END" in rows[0][-1] or "END" in "".join(rows[0]))


def test_export_keeps_all_rows(spark, tmp_path):
    df = spark.range(10_001).select(F.lit(1).alias("import_batch_id"), F.col("id").alias("sequence"), F.lit("x").alias("item_name"))
    with pytest.raises(ValueError, match="confirm"):
        ingest.export(df, str(tmp_path / "x"))
    ingest.export(df, str(tmp_path / "x"), confirmed=True)
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == 10_001
    with pytest.raises(ValueError, match="narrow"):
        ingest.export(df, str(tmp_path / "y"), confirmed=True, limit=10_000)


def test_deep_trees_are_told(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, f"l{min(i + 1, 5)}", f"n{i}") for i in range(14)], "id long, parent_id long, level string, name string")
    with pytest.raises(ValueError, match="deeper"):
        tree.rebuilt(nodes)
    assert tree.rebuilt(nodes, depth=14).filter("level = 'l5'").count() == 1
    assert {r.id: r.path for r in tree.paths(nodes).collect()}[4] == "n0/n1/n2/n3/n4"
    assert all(r.path is None for r in tree.paths(nodes).filter("id > 4").collect())


def test_checksum_streams_a_batch(spark):
    import hashlib

    rows = [(i % 3, i // 3, i, None if i % 5 == 0 else f"c{i}", None if i % 7 == 0 else f"n{i}", None if i % 3 == 2 else i * 10, i % 11 != 0) for i in range(300)]
    df = spark.createDataFrame(rows, "import_batch_id int, sequence long, id long, item_code string, item_name string, total_cents long, active boolean").repartition(5)
    got = {r.import_batch_id: r for r in quality.batch_checksum(df).collect()}
    for b in range(3):
        own = sorted(r for r in rows if r[0] == b and r[6])
        lines = [":".join(str(x) for x in (r[1], r[3] or "", r[4], r[5]) if x is not None) for r in own]
        assert (got[b].n, got[b].checksum) == (len(own), hashlib.sha256("|".join(lines).encode()).hexdigest())
        assert got[b].total_cents == (None if b == 2 else sum(r[5] for r in own))
    assert quality.batch_checksum(df.filter("false")).collect() == []


# --- stored tables ---


def stored_bill(spark, path):
    rows = [(100 * b + i, b, i, f"k{i % 4 + b}", 100 + i, True, "normal", i if i % 10 else None, "dict", "completed", datetime.date(2026, 1 + b, 1), f"n{i}", "m", "P") for b in range(3) for i in range(20)]
    names = "id long, import_batch_id long, sequence long, match_key string, unit_rate_cents long, active boolean, anomaly_flag string, material_dict_id long, match_key_source string, data_source_type string, price_period date, item_name string, unit_std string, province string"
    stored.write_batches(spark.createDataFrame(rows, names), path)
    return {b: sorted((tmp.name, tmp.stat().st_mtime_ns) for tmp in (path_of(path) / f"import_batch_id={b}").iterdir()) for b in range(3)}


def path_of(path):
    import pathlib

    return pathlib.Path(path)


def test_deletion_touches_its_batch_only(spark, tmp_path):
    path = str(tmp_path / "bill")
    before = stored_bill(spark, path)
    assert stored.set_active(spark, path, [1], False) == 20 and stored.set_active(spark, path, [1], False) == 0
    now = {b: sorted((f.name, f.stat().st_mtime_ns) for f in (tmp_path / f"bill/import_batch_id={b}").iterdir()) for b in range(3)}
    assert now[0] == before[0] and now[2] == before[2] and now[1] != before[1]
    rows = stored.read_batches(spark, path)
    assert {(r.import_batch_id, r.active) for r in rows.select("import_batch_id", "active").distinct().collect()} == {(0, True), (1, False), (2, True)} and rows.count() == 60
    assert stored.set_active(spark, path, [1], True) == 20 and stored.read_batches(spark, path, [1]).filter("active").count() == 20


def test_purge_behind_gate_and_snapshot(spark, tmp_path):
    path = str(tmp_path / "bill")
    stored_bill(spark, path)
    old, new = datetime.date(2026, 1, 1), datetime.date(2026, 2, 25)
    asked = spark.createDataFrame([(0, "a", "a", old), (1, "b", "wrong", old), (2, "c", "c", new)], "import_batch_id long, name string, confirm_name string, deleted_at date")
    today = F.lit(datetime.date(2026, 3, 1))
    assert stored.purge(spark, path, asked, str(tmp_path / "kept"), today) == [0]
    assert {r.import_batch_id for r in stored.read_batches(spark, path).select("import_batch_id").distinct().collect()} == {1, 2}
    assert spark.read.csv(str(tmp_path / "kept/batch-0"), header=True).count() == 20
    (tmp_path / "kept/batch-2").mkdir()
    with pytest.raises(Exception, match="already exists"):  # no snapshot, no purge
        stored.purge(spark, path, asked.withColumn("deleted_at", F.lit(old)).filter("import_batch_id = 2"), str(tmp_path / "kept"), today)
    assert stored.read_batches(spark, path, [2]).count() == 20


def test_catalog_write_behind_its_gate(spark, tmp_path):
    bill, path = str(tmp_path / "bill"), str(tmp_path / "catalog")
    stored_bill(spark, bill)
    lines = spark.read.parquet(bill)
    with pytest.raises(ValueError, match="coverage"):
        stored.write_catalog(spark, path, lines.withColumn("material_dict_id", F.lit(None).cast("long")), ["note"])
    assert not path_of(path).exists()
    first = stored.write_catalog(spark, path, lines.filter("import_batch_id < 2"), ["note"], buckets=4).first()
    assert first.passes and spark.read.parquet(path).count() == 5
    noted = spark.read.parquet(path).withColumn("note", F.lit("mine"))
    from boqspark.shared import cut

    cut(noted).write.mode("overwrite").partitionBy("bucket").parquet(path)
    stamp = {p.name: sorted(f.name for f in p.iterdir()) for p in path_of(path).glob("bucket=*")}
    stored.write_catalog(spark, path, lines, ["note"], batch=2, buckets=4)
    rows = {r.match_key: r for r in spark.read.parquet(path).collect()}
    assert set(rows) == {f"k{i}" for i in range(6)} and rows["k0"].note == "mine" and rows["k2"].note == "mine" and rows["k5"].note is None
    want = {r.match_key: r for r in quality.catalog(lines).collect()}
    assert all((rows[k].n, rows[k].avg_rate, rows[k].latest_period) == (want[k].n, want[k].avg_rate, want[k].latest_period) for k in want)
    touched = {f"bucket={r.b}" for r in lines.filter("import_batch_id = 2").select(F.pmod(F.xxhash64("match_key"), F.lit(4)).alias("b")).distinct().collect()}
    assert all((sorted(f.name for f in p.iterdir()) == stamp.get(p.name)) == (p.name not in touched) for p in path_of(path).glob("bucket=*"))


def test_changes_that_are_permitted(spark):
    rows = spark.createDataFrame([(1, "std_name", "x", "why"), (1, "std_name", "x", " "), (1, "item_name", "y", None), (1, "active", "z", "why"), (1, "other", "z", "why")], "id long, field string, new_value string, reason string")
    assert [r.kept for r in merge.permitted(rows, True).collect()] == [True, False, True, False, False]
    assert [r.kept for r in merge.permitted(rows, False).collect()] == [False, False, True, False, False]
    ids = spark.createDataFrame([(1,), (1,), (7,)], "id long")
    assert [(r.id, r.warning) for r in merge.missing_ids(rows, ids).collect()] == [(7, "no such row: 7")]


def test_files_by_path_are_the_same_whatever_their_size(spark, tmp_path, monkeypatch):
    """large files are hashed and read in parts; hashes and rows are those of whole files."""
    import hashlib

    head, body = "项目编码,项目名称,工程量\n", "".join(f'{i:09d},"a, ""{i}""\nb",{i}\n' if i % 7 == 0 else f"{i:09d},pipe {i},{i}\n" for i in range(3000))
    texts = {"a b+%20[x].csv": head + body, "b.csv": head + body.rstrip("\n"), "c.csv": "﻿" + head + body, "d.csv": "﻿" + head + body.rstrip("\n"), "e.csv": (head + body).replace("\n", "\r\n"), "f.csv": head + body + "\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "g.csv").write_bytes((head + body).encode("gbk"))
    found = [(r.path, r.length) for r in spark.read.format("binaryFile").load(str(tmp_path)).collect()]
    rows = lambda: sorted((r.path, r.row, r.cells) for r in ingest.rows_of(spark, found).collect())
    hashes = lambda: sorted(map(tuple, ingest.hashed(spark, found).collect()))
    want = sorted((p, hashlib.sha256((tmp_path / p.split("/")[-1]).read_bytes()).hexdigest()) for p, _ in found)
    whole = rows()
    assert len(found) == 7 and hashes() == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(ingest, "WHOLE_FILE", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert hashes() == want and rows() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
