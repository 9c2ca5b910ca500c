"""CSV records: lines and records become Python objects a few bytes at a time, whatever an Arrow batch holds."""

import pyarrow as pa

from tabweave.sources import csv_records
from tabweave.sources import files as S


def test_lines_in_slices(monkeypatch):
    monkeypatch.setattr(csv_records, "CHUNK", 1000)
    lines = [bytes([65 + i % 26]) * (i % 300) for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 500), pa.array([0] * 250 + [9] * 250, pa.int64()), pa.array(lines, pa.binary())], names=["file", "block", "line"])
    parts = list(csv_records._by_block(iter([batch.slice(0, 300), batch.slice(300)])))
    assert [x for *_, part in parts for x in part] == lines
    assert max(sum(map(len, part)) for *_, part in parts) < 1300  # the line that crosses the limit is still in
    assert [(block, new) for _, block, new, _ in parts if new] == [(0, True), (9, True)]


def test_rows_are_the_same(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(csv_records, "CHUNK", 64)  # the driver's; tasks have the default
    rows = [(str(i), f'é "{i}",\nline\n{"x" * (i % 90 + 1)}') for i in range(400)]
    S.write_csv(spark.createDataFrame(rows, "id string, text string"), str(tmp_path / "c"), encoding="ISO-8859-1")
    back, enc = S.read_csv_auto(spark, str(tmp_path / "c"), text_col="text")
    assert enc == "ISO-8859-1" and sorted(map(tuple, back.collect())) == sorted(rows)
