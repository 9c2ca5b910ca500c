"""CSV records with line breaks inside quoted cells, each file read by many tasks.

Spark splits a CSV file only if every line is a record. Here the file is read as physical lines, which it splits at will, and
the record boundaries are found in two passes:

1. each block of a file is a function of one bit: given whether its first line begins inside a quoted cell, does the line
   after its last one? A line without quotes changes nothing; others are scanned once for either start;
2. the functions are composed along each file (a window over one row a block), which tells every block its start;
3. each block cuts its lines into records. A record that goes on in the next block leaves as a fragment; fragments of
   one record (at most two a block) are put together in a small join of their own.

Quotes inside a cell that does not begin with one are plain characters, doubled ones stand for one, and a closed cell ends at the
next separator: as in Spark's own reader. Only record boundaries are found here; cells are parsed by ``from_csv``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

QUOTE = b'"'
BOM = b"\xef\xbb\xbf"
CHUNK = 1 << 22  # bytes of lines that are Python objects at once


def splittable(encoding: str) -> bool:
    """True for encodings that write line breaks and quotes as ASCII does."""
    return '\n",;a'.encode(encoding) == b'\n",;a'


def inside_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether the line after this one begins inside a quoted cell."""
    if QUOTE not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find(QUOTE, at)
            while at >= 0 and line[at + 1:at + 2] == QUOTE:
                at = line.find(QUOTE, at + 2)
            if at < 0:
                return True
            at = line.find(sep, at + 1)  # what follows a closing quote belongs to the cell
            if at < 0:
                return False
            at += len(sep)
        if line[at:at + 1] != QUOTE:  # a cell without quotes: on to the next one that begins with a quote
            at = line.find(sep + QUOTE, at)
            if at < 0:
                return False
            at += len(sep)
        at, inside = at + 1, True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of about ``CHUNK`` bytes of the column: a batch has a number of rows, whatever their length."""
    for batch in batches:
        before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(before // CHUNK)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, list[bytes]]]:
    """(file, block, whether it is new, lines): the lines of a task in order, block after block."""
    last = None
    for batch in _slices(batches, 2):
        file, block = batch.column(0), batch.column(1).to_numpy()
        lines = batch.column(2).to_pylist()
        starts = file.dictionary_encode().indices.to_numpy() if not isinstance(file, pa.DictionaryArray) else file.indices.to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (starts[1:] != starts[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lines)]):
            if hi > lo:
                at = (file[lo].as_py(), int(block[lo]))
                yield *at, at != last, lines[lo:hi]
                last = at


def _starts_inside(lines: DataFrame, sep: bytes) -> set[int]:
    """Hashes of the blocks whose first line begins inside a quoted cell: at most eight bytes a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([now[2]]), pa.array([now[3]])],
                                              names=["file", "block", "outside", "inside"])

        for file, block, new, part in _by_block(batches):
            if new:
                if now:
                    yield out()
                now = [file, block, False, True]
            for line in part:
                if QUOTE in line:
                    first = block == 0 and line.startswith(BOM)
                    scan = [inside_after(line[3:] if first else line, s, sep) for s in (False, True)]
                    now[2], now[3] = scan[now[2]], scan[now[3]]
        if now:
            yield out()

    blocks = lines.mapInArrow(run, "file string, block bigint, outside boolean, inside boolean")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    swaps = F.col("outside") & ~F.col("inside")
    blocks = blocks.withColumn("swaps", F.coalesce(F.sum(swaps.cast("int")).over(before), F.lit(0)))
    settled = F.when(F.col("outside") == F.col("inside"), F.struct("block", "outside", "swaps"))  # whatever was before
    last = F.max(settled).over(before)
    start = F.coalesce(last["outside"].cast("int"), F.lit(0)) + F.col("swaps") - F.coalesce(last["swaps"], F.lit(0))
    found = blocks.withColumn("start", start % 2 == 1).filter("start").select("file", "block").collect()
    return {_key(r["file"], r["block"]) for r in found}


def _key(file: str, block: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{file}\0{block}".encode(), digest_size=8).digest(), "big")


def records(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(file, first, record): every record of the files, without its line end; ``first`` marks each file's first one."""
    ensure_checkpoint_dir(spark)
    if not splittable(encoding):
        raise ValueError(f"{encoding} does not write line breaks as ASCII does")
    lines, mark = _lines(spark, path), sep.encode(encoding)
    sent = spark.sparkContext.broadcast(_starts_inside(lines, mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, held, inside, head, file, block, first = sent.value, [], False, False, None, 0, False
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 5
            rows.clear()
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "block", "kind", "first", "record"])

        def ended() -> None:
            """The block is over: what it holds goes on in the next one."""
            if held:
                rows.append((file, block, 2 if head else 1, first, b"\n".join(held)))  # all of it, or the beginning of a record
                held.clear()

        for at_file, at_block, new, part in _by_block(batches):
            if new:
                ended()
                file, block = at_file, at_block
                head = inside = _key(file, block) in starts
                first = block == 0
                if first and part[0].startswith(BOM):
                    part[0] = part[0][3:]
            for line in part:
                held.append(line)
                inside = inside_after(line, inside, mark)
                if not inside:
                    # kind 0: a whole record; 3: the end of one that began in another block
                    rows.append((file, block, 3 if head else 0, first, held[0] if len(held) == 1 else b"\n".join(held)))
                    held.clear()
                    head = first = False
            if rows:
                yield flush()
        ended()
        if rows:
            yield flush()

    cut = lines.mapInArrow(run, "file string, block bigint, kind int, first boolean, record binary")
    whole = cut.filter("kind = 0").select("file", "first", "record")
    pieces = cut.filter("kind > 0").checkpoint(eager=True)  # at most two rows a block
    along = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == 1, 1).otherwise(0))
    nth = F.sum((F.col("kind") == 1).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    glued = (pieces.withColumn("nth", nth).groupBy("file", "nth")
             .agg(F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts")))
    joined = F.aggregate("parts", F.lit(None).cast("binary"), lambda s, p: F.when(s.isNull(), p["record"]).otherwise(
        F.concat(s, F.lit(b"\n"), p["record"])))
    return whole.unionByName(glued.select("file", "first", joined.alias("record")))


def parsed(found: DataFrame, columns: list[str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """The cells of the records but each file's first one, as strings."""
    body = found.filter(~F.col("first")).select("record")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 0):
            text = [b.removesuffix(b"\r").decode(encoding, "replace") for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([t for t in text if t], pa.string())], names=["record"])

    names = [f"c{i}" for i in range(len(columns))]
    cells = F.from_csv("record", ", ".join(f"{n} string" for n in names), {"sep": sep, "escape": '"', "multiLine": "true"})
    rows = body.mapInArrow(decode, "record string").select(cells.alias("r"))
    return rows.select(*[F.col(f"r.{n}").alias(c) for n, c in zip(names, columns)])
