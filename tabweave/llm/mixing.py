"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells (source, language, topic). Starting from the tokens of
each cell, the weights are raked: scaled to the target share of each source,
then of each language, then of each topic, until a whole sweep moves no cell by more
than ``TOLERANCE``. Targets that cannot be met together leave a margin that stays off: every
cell carries ``margin_gap``, the largest relative distance of its three margins from
their targets. A cell's ratio of raked weight to tokens, times a scale, is the
probability with which each of its documents is kept; no document is repeated.
The scale makes ``rate`` the expected share of all tokens that is kept:
a cell whose ratio asks for more than all of its documents (``wanted`` above 1 in
``cell_ratios``) is kept whole and the others make up for it, so that a small cell does
not set the size of the sample. With ``rate=None`` the scale is one over the largest ratio:
the expected tokens then have the target margins in full,
and the smallest cell may decide how few they are. A document's draw is a hash of seed
and id, so a sample can be repeated and does not depend on partitions.

Raking works on the cell table (one row per cell, made by one aggregate with
map-side combining; its size is counted). Its sweeps run in one task where it has
at most ``ONE_TASK_CELLS`` rows, else they are windows over that table. The ratios go
back to the rows by a broadcast when the cell table has at most
``BROADCAST_CELLS`` rows, else by a shuffled join.

Defined results: null categories are the category ``NONE``; a null or empty text
has no tokens, is in the topic ``empty`` and in cells of no weight gets the
probability 1 (it cannot move a margin); repeated rows share one draw; a target
share of a category without tokens is left out and the others are scaled up;
an empty table gives an empty result; other columns are ignored by
``mix_weights`` and carried by ``mix_sample``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, pinned

DIMS = ("source", "lang", "topic")
NONE = "(none)"
POWER = 0.8  # default targets: token shares to this power, scaled to 1
TOLERANCE = 1e-12  # relative change of a cell's weight in a whole sweep
MOST_SWEEPS = 2_000  # where the margins come closer too slowly; the gap that is left is reported
AT_ONCE = 5  # sweeps between two checkpoints
ORACLE_SWEEPS = 300
SEED = 7
RATE = 0.4  # of the tokens, in a sample
BROADCAST_CELLS = 100_000
ONE_TASK_CELLS = 1_000_000  # some 50 MB
BYTES_PER_TOKEN = 4


def token_weight(text: Column) -> Column:
    """Tokens of a text, by its bytes."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / BYTES_PER_TOKEN).cast("bigint")


def topic_of(text: Column) -> Column:
    """A coarse topic by plain marks of the text; callers pass their own column instead."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t == "", "empty").when(t.contains("License"), "legal").when(t.contains(" | "), "table")
            .when(t.contains("***") | t.contains("$$$"), "noise").when(F.octet_length(t) > 8000, "long").otherwise("prose"))


def default_targets(cells: DataFrame, power: float = POWER) -> dict[str, DataFrame]:
    """Per dimension (value, share): the token shares, flattened by ``power``."""
    out = {}
    for dim in DIMS:
        sums = cells.filter("tokens > 0").groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("raw"))
        total = sums.agg(F.sum("raw")).first()[0]
        out[dim] = sums.select(dim, (F.col("raw") / F.lit(total or 1.0)).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, one_task: int = ONE_TASK_CELLS) -> DataFrame:
    """``cells`` (the dimensions, tokens) with ``mass``, whose margins approach the
    target shares, and ``margin_gap``. Up to ``one_task`` cells are swept in one task, more by windows."""
    goal = {}
    for dim, share in targets.items():  # only categories that have tokens can be met
        have = cells.filter("tokens > 0").groupBy(dim).agg(F.sum("tokens").alias("t"))
        met = have.join(share, dim, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        shares, tokens = met.agg(F.sum("share"), F.sum("t")).first()
        goal[dim] = pinned(met.select(dim, (F.col("share") / F.lit(shares or 1.0) * F.lit(float(tokens or 0))).alias("goal")))
    now = cells.filter("tokens > 0").withColumn("mass", F.col("tokens").cast("double"))
    for dim, want in goal.items():
        now = now.join(want.withColumnRenamed("goal", f"goal_{dim}"), dim)
    now = pinned(now)
    if now.count() <= one_task:
        schema = T.StructType([*_schema_of(now, [*cells.columns, "mass"]).fields, T.StructField("margin_gap", T.DoubleType())])
        return now.coalesce(1).mapInPandas(_rake_in_task(list(goal), tolerance, cells.columns), schema)
    have = {dim: F.sum("mass").over(Window.partitionBy(dim)) for dim in goal}  # over the cells of a category, not over its documents
    for sweep in range(1, MOST_SWEEPS + 1):
        now = now.withColumn("before", F.col("mass"))
        for dim in goal:
            now = now.withColumn("mass", F.when(have[dim] > 0, F.col("mass") * F.col(f"goal_{dim}") / have[dim]).otherwise(0.0))
        if sweep % AT_ONCE == 0 or sweep == MOST_SWEEPS:
            now = pinned(now)
            moved = now.agg(F.max(F.abs(F.col("mass") - F.col("before")) / F.greatest("before", F.lit(1e-300)))).first()[0]
            if (moved or 0.0) <= tolerance:
                break
    gaps = [F.when(F.col(f"goal_{dim}") > 0, F.abs(have[dim] / F.col(f"goal_{dim}") - 1)).otherwise(0.0) for dim in goal]
    return now.select(*cells.columns, "mass", F.greatest(*gaps, F.lit(0.0)).alias("margin_gap"))


def _schema_of(df: DataFrame, columns: list[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns])


def _rake_in_task(dims: list[str], tolerance: float, columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The sweeps over a cell table that one task holds."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if not held:
            return
        cells = pd.concat(held, ignore_index=True)
        mass = cells["mass"].to_numpy(np.float64).copy()
        margins = [(np.unique(cells[d], return_inverse=True)[1], cells[f"goal_{d}"].to_numpy(np.float64)) for d in dims]
        for _ in range(MOST_SWEEPS):
            before = mass
            for code, goal in margins:
                have = np.bincount(code, mass)[code]
                mass = np.where(have > 0, mass * goal / np.where(have > 0, have, 1.0), 0.0)
            if (np.abs(mass - before) <= tolerance * before).all():
                break
        gap = np.zeros(len(mass))
        for code, goal in margins:
            gap = np.maximum(gap, np.abs(np.bincount(code, mass)[code] / np.where(goal > 0, goal, 1.0) - 1) * (goal > 0))
        yield cells.assign(mass=mass, margin_gap=gap)[[*columns, "mass", "margin_gap"]]

    return run


def _keyed(docs: DataFrame, source_col: str, lang_col: str, text_col: str, topic: Column | None) -> list[Column]:
    text = F.col(text_col).cast("string")
    none = F.lit(NONE)
    return [F.coalesce(F.col(source_col).cast("string"), none).alias("source"),
            F.coalesce(F.col(lang_col).cast("string"), none).alias("lang"),
            F.coalesce(topic if topic is not None else topic_of(text), none).alias("topic"),
            token_weight(text).alias("tokens")]


def cell_ratios(docs: DataFrame, source_col: str = "source", lang_col: str = "lang", text_col: str = "text",
                topic: Column | None = None, targets: dict[str, DataFrame] | None = None, power: float = POWER,
                rate: float | None = RATE) -> DataFrame:
    """(source, lang, topic, weight, margin_gap, wanted, probability) of every cell with tokens; ``wanted``
    is the weight scaled to ``rate`` of all tokens, or else to 1 at most."""
    cells = pinned(docs.select(*_keyed(docs, source_col, lang_col, text_col, topic))
                   .groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))
    raked = rake(cells, targets or default_targets(cells, power)).withColumn("weight", F.col("mass") / F.col("tokens"))
    raked = pinned(raked.select(*DIMS, "tokens", "weight", "margin_gap"))
    top = raked.agg(F.max("weight")).first()[0]
    wanted = F.col("weight") / F.lit(top or 1.0) if rate is None else F.col("weight") * F.lit(_scale(raked, rate))
    return raked.withColumn("wanted", wanted).withColumn("probability", F.least("wanted", F.lit(1.0))).drop("tokens")


def _scale(cells: DataFrame, rate: float) -> float:
    """The factor c at which min(1, c * weight) keeps ``rate`` of the tokens: cells that would
    pass 1 are taken whole and the rest is scaled up, until no more cells pass."""
    scale, whole = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(scale) >= 1
        n, kept, mass, tokens = cells.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("tokens")).otherwise(0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight") * F.col("tokens"))), F.sum("tokens")).first()
        if n == whole or not mass:  # with no mass left every cell with a weight is whole
            return scale
        scale, whole = (rate * tokens - kept) / mass, n


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A uniform number in [0, 1) from the first 13 hex digits of md5(seed|id)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def mix_weights(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang",
                text_col: str = "text", topic: Column | None = None, targets: dict[str, DataFrame] | None = None,
                power: float = POWER, seed: int = SEED, carry: str | None = None, rate: float | None = RATE) -> DataFrame:
    """Per row: the id, its cell, ``n_tokens``, ``weight`` (raked tokens per token), ``margin_gap``,
    ``probability`` and ``kept``; ``carry`` names a struct column that is passed on."""
    cells = cell_ratios(docs, source_col, lang_col, text_col, topic, targets, power, rate).drop("wanted")
    rows = docs.select(F.col(id_col).alias("id"), *_keyed(docs, source_col, lang_col, text_col, topic),
                       *([F.col(carry).alias("carried")] if carry else []))
    ratios = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    out = rows.join(ratios, [*DIMS], "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.select(F.col("id").alias(id_col), *DIMS, F.col("tokens").alias("n_tokens"),
                      F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("margin_gap", F.lit(0.0)).alias("margin_gap"), "probability",
                      (draw(F.col("id"), seed) < F.col("probability")).alias("kept"),
                      *([F.col("carried")] if carry else []))


def mix_sample(docs: DataFrame, id_col: str = "doc_id", rate: float | None = RATE, **kw) -> DataFrame:
    """The sampled rows of ``docs``, with their columns: ``rate`` of the tokens is expected."""
    whole = free_name("_row", docs)
    packed = docs.withColumn(whole, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = mix_weights(packed, id_col, carry=whole, rate=rate, **kw).filter("kept")
    return kept.select([F.col("carried")[c].alias(c) for c in docs.columns])


def _sweep(rows: str) -> str:
    for dim in DIMS:
        rows = (f"SELECT it, source, lang, topic, tokens, g_source, g_lang, g_topic, "
                f"mass * g_{dim} / sum(mass) OVER (PARTITION BY {dim}) AS mass FROM ({rows})")
    return rows


ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, 'License') THEN 'legal'
       WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '***') OR contains(text, '$$$') THEN 'noise'
       WHEN strlen(text) > 8000 THEN 'long' ELSE 'prose' END AS topic,
  CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT) AS tokens FROM documents),
c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
gs AS (SELECT source, pow(sum(tokens), 0.8) / sum(pow(sum(tokens), 0.8)) OVER () * sum(sum(tokens)) OVER () AS g_source FROM c GROUP BY source),
gl AS (SELECT lang, pow(sum(tokens), 0.8) / sum(pow(sum(tokens), 0.8)) OVER () * sum(sum(tokens)) OVER () AS g_lang FROM c GROUP BY lang),
gt AS (SELECT topic, pow(sum(tokens), 0.8) / sum(pow(sum(tokens), 0.8)) OVER () * sum(sum(tokens)) OVER () AS g_topic FROM c GROUP BY topic),
m AS (SELECT 0 AS it, source, lang, topic, tokens, g_source, g_lang, g_topic, tokens AS mass
      FROM c JOIN gs USING (source) JOIN gl USING (lang) JOIN gt USING (topic)
      UNION ALL SELECT it + 1, source, lang, topic, tokens, g_source, g_lang, g_topic, mass FROM ({_sweep(f"SELECT * FROM m WHERE it < {ORACLE_SWEEPS}")})),
w AS (SELECT source, lang, topic, tokens, mass / tokens AS weight, greatest(abs(sum(mass) OVER (PARTITION BY source) / g_source - 1),
        abs(sum(mass) OVER (PARTITION BY lang) / g_lang - 1), abs(sum(mass) OVER (PARTITION BY topic) / g_topic - 1)) AS margin_gap
      FROM m WHERE it = {ORACLE_SWEEPS}),
-- the scale that keeps the rate if the k cells with the greatest weights are kept whole, and the first k that agrees with it
k AS (SELECT weight, ({RATE} * sum(tokens) OVER () - coalesce(sum(tokens) OVER before, 0)) / sum(tokens * weight) OVER after AS scale,
        row_number() OVER (ORDER BY weight DESC, source, lang, topic) AS nth FROM w
      WINDOW before AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             after AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c0 AS (SELECT scale FROM k WHERE scale * weight < 1 ORDER BY nth LIMIT 1),
r AS (SELECT source, lang, topic, weight, margin_gap, least(1.0, weight * (SELECT scale FROM c0)) AS probability FROM w),
j AS (SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens AS n_tokens, coalesce(r.weight, 1.0) AS weight,
  coalesce(r.margin_gap, 0.0) AS margin_gap, coalesce(r.probability, 1.0) AS probability,
  CAST(('0x' || substr(md5('7|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM d LEFT JOIN r USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(margin_gap, 6) AS margin_gap,
  round(probability, 6) AS probability, u < probability AS kept FROM j"""
