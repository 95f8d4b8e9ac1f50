import datetime as dt
import hashlib

import pytest

from demandloom.schemas import SALES
from demandloom.sources import fingerprints, sinks, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_is_typed_leniently_and_extra_columns_stay(spark, tmp_path):
    path = write(tmp_path / "s.csv", "Date,SKU,Units_Sold,Revenue,Price,Promotion,Note\n2024-01-01,SKU001,2,20.0,10.0,0,hi\nnot-a-date,SKU002,x,5.0,5.0,1,\n")
    rows = tables.load_sales(spark, path).collect()
    assert (rows[0]["Date"], rows[0]["Units_Sold"], rows[0]["Note"]) == (dt.date(2024, 1, 1), 2, "hi")
    assert rows[1]["Date"] is None and rows[1]["Units_Sold"] is None


def test_missing_columns_and_files_fail(spark, tmp_path):
    with pytest.raises(tables.MissingColumns, match="Promotion"):
        tables.load_sales(spark, write(tmp_path / "m.csv", "Date,SKU,Units_Sold,Revenue,Price\n"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_sales(spark, str(tmp_path / "none.csv"))


def test_json_has_no_infinities(spark, tmp_path):
    df = spark.createDataFrame([("a", float("inf"), dt.date(2024, 1, 1)), ("b", float("nan"), None)], "k string, x double, d date")
    back = spark.read.json(sinks.sink_json_records(df, str(tmp_path / "j")))
    assert sorted((r["k"], r["x"], r["d"]) for r in back.collect()) == [("a", None, "2024-01-01"), ("b", None, None)]


def test_fingerprints_notice_changes(spark, tmp_path):
    (tmp_path / "f").mkdir()
    write(tmp_path / "f" / "a.txt", "one")
    write(tmp_path / "f" / "b.txt", "two")
    before = fingerprints.file_fingerprint(spark, str(tmp_path / "f")).collect()
    before = spark.createDataFrame(before, "file string, bytes long, sha256 string")
    write(tmp_path / "f" / "b.txt", "two!")
    write(tmp_path / "f" / "c.txt", "new")
    after = fingerprints.file_fingerprint(spark, str(tmp_path / "f"))
    assert {r["file"]: r["change"] for r in fingerprints.assert_unchanged(before, after).collect()} == {"b.txt": "changed", "c.txt": "added"}


def test_table_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    one, two = (fingerprints.table_fingerprint(x, "t") for x in (df, df.repartition(7, "b")))
    assert fingerprints.assert_unchanged(one, two).count() == 0


def test_parquet_round_trip_with_partitions(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "SKU001", 1, 1.0, 1.0, 0)], SALES.schema)
    path = sinks.sink_parquet(df, str(tmp_path / "p"), ["SKU"])
    assert tables.scan_parquet(spark, path, ["Units_Sold"]).first()[0] == 1


def test_fingerprints_of_tables_in_folders_keep_part_files_apart(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.txt").write_text(name)
    got = {r["file"]: r["bytes"] for r in fingerprints.file_fingerprint(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"one/part-0.txt": 3, "two/part-0.txt": 3}


def tree(content, block):
    """The hash tree by itself, from whole contents."""
    level = [hashlib.sha256(b"\0" + content[i : i + block]).digest() for i in range(0, max(len(content), 1), block)]
    for _ in range(fingerprints.LEVELS):
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + fingerprints.FANOUT])).digest() for i in range(0, len(level), fingerprints.FANOUT)]
    return level[0].hex()


def test_tree_fingerprints_equal_the_tree_over_whole_contents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    contents = {"empty.bin": b"", "one.bin": b"x", "edge.bin": bytes(range(256)), "d/a b%20c.bin": bytes(i * 7 % 251 for i in range(200_000)), "d/same.bin": b"x"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = {r["file"]: r for r in fingerprints.tree_fingerprint(spark, str(tmp_path), "*.bin", 128).collect()}
    assert {n: (r["bytes"], r["blocks"], r["tree_sha256"]) for n, r in got.items()} == {
        n: (len(c), max(1, -(-len(c) // 128)), tree(c, 128)) for n, c in contents.items() if c
    }
    # More than one node: swapping two blocks far apart is seen.
    changed = bytearray(contents["d/a b%20c.bin"])
    changed[:128], changed[-192:-64] = changed[-192:-64], changed[:128]
    (tmp_path / "d/a b%20c.bin").write_bytes(bytes(changed))
    after = fingerprints.tree_fingerprint(spark, str(tmp_path), "*.bin", 128)
    before = spark.createDataFrame(list(got.values()), after.schema)
    assert [(r["file"], r["change"]) for r in fingerprints.assert_unchanged(before, after).collect()] == [("d/a b%20c.bin", "changed")]


def test_plain_fingerprints_do_not_hold_whole_files(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 20_000
    (tmp_path / "big.bin").write_bytes(data)
    (tmp_path / "a b.bin").write_bytes(b"x")
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "1000")
    try:
        got = {r["file"]: (r["bytes"], r["sha256"]) for r in fingerprints.file_fingerprint(spark, str(tmp_path), "*.bin").collect()}
    finally:
        spark.conf.unset(limit)
    assert got == {"big.bin": (len(data), hashlib.sha256(data).hexdigest()), "a b.bin": (1, hashlib.sha256(b"x").hexdigest())}
