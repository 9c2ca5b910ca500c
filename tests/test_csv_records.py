"""CSV with line breaks in cells, split at every place."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tabweave.sources import csv_records as R
from tabweave.sources import files as S


def rows_made(n, seed):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "b", '"', "\n", ",", ";", "é", " ", "\r\n", "x" * 9]) for _ in range(rng.randrange(1, 8)))
    return [(str(i), cell(), cell()) for i in range(n)]


def written(path, rows, sep=",", encoding="utf-8", end="\n"):
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(("id", "one", "two"))
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))


@pytest.fixture
def small_splits(spark):
    keep = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for c, v in keep.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("size, sep, encoding, end", [(7, ",", "utf-8", "\n"), (50, ";", "ISO-8859-1", "\n"), (333, ",", "utf-8", "\r\n")])
def test_records_split_anywhere(spark, tmp_path, small_splits, size, sep, encoding, end):
    rows = rows_made(60, size)
    written(tmp_path / "a.csv", rows, sep, encoding, end)
    written(tmp_path / "b.csv", [(f"b{i}", x, y) for i, x, y in rows[:20]], sep, encoding, end)
    small_splits(size)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    got = S.read_csv(spark, str(tmp_path), sep=sep, encoding=encoding)
    want = {r[0]: r[1:] for r in rows} | {f"b{r[0]}": r[1:] for r in rows[:20]}
    assert {r["id"]: (r["one"], r["two"]) for r in got.collect()} == want


def test_a_cell_spans_many_splits(spark, tmp_path, small_splits):
    rows = [("1", "short", "x"), ("2", "line\n" * 500, 'q"' * 40 + "\n"), ("3", "", "end")]
    written(tmp_path / "a.csv", rows)
    small_splits(64)
    got = {r["id"]: (r["one"], r["two"]) for r in S.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"1": ("short", "x"), "2": (rows[1][1], rows[1][2]), "3": (None, "end")}


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rows = [(str(i), f"a\nb{i}", "c") for i in range(20_000)]
    written(tmp_path / "a.csv", rows)
    small_splits(40_000)
    found = S.read_csv(spark, str(tmp_path / "a.csv")).withColumn("task", F.spark_partition_id())
    assert found.count() == 20_000 and found.select("task").distinct().count() >= 5


def test_stray_quotes_blank_lines_and_bom(spark, tmp_path, small_splits):
    text = '﻿id,one,two\n1,5" disk,"a ""quoted"" word"\n\n2,"closed"tail,x\n3,"",\n4,"open\n\nend",y'
    (tmp_path / "a.csv").write_bytes(text.encode())
    for size in (5, 1 << 20):
        small_splits(size)
        got = S.read_csv(spark, str(tmp_path / "a.csv"), required=["id"])
        one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "a.csv"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))


@pytest.mark.parametrize("line, want", [(b'a,b', (False, True)), (b'"a', (True, False)), (b'a"b,c', (False, False)), (b'"a""b",c', (False, False)),
                                        (b'x",y"z,"q', (True, True)), (b'"";"a', (False, False)), (b'""a', (False, True))])
def test_state_after_a_line(line, want):
    assert tuple(R.inside_after(line, s, b",") for s in (False, True)) == want


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,one,two\n")
    assert S.read_csv(spark, str(tmp_path / "a.csv")).count() == 0
