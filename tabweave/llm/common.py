"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that where a text is all ASCII
    (one byte per character); other texts go through ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that no frame uses (names are compared without case, as Spark does)."""
    used = {c.lower() for f in frames for c in f.columns}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage, survives lost executors, lives in
    the folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column of an Arrow batch; null counts as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with a per-task set-up: ``make()`` runs once per task and
    returns the function that turns one batch into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = make()
        for batch in batches:
            out = turn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
