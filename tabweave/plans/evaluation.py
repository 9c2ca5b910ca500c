"""P9 prepared-table split and feature build, P11 entity feature table,
P8 recipe loading.

P9: lower-case names (B17), binary indicators (B12), kind order (B15),
split (E4), imputation (J5) and min-max scaling (J6) fitted on the training
rows, label-encoded target (J1).
P11: cleaned entity names (I17), row sentences (I19) encoded once per
distinct sentence (K1/K2) into ``X0..X{d-1}`` columns.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import TableSpec
from ..functions.text import binary_indicator, clean_entity, row_sentence
from ..operators import features as J
from ..operators import prepare as P
from ..operators import split as X
from ..operators.encoder import HashingEncoder, encode_distinct

RECIPE_DIR = os.path.join(os.path.dirname(__file__), "recipes")


def build_features(df: DataFrame, row_id: str, spec: TableSpec, seed: int = 42, fit_on: str = "train") -> DataFrame:
    df = P.lowercase_first(df)
    row_id, target = row_id.lower(), spec.target.lower()
    bins, nums, cats = spec.columns_of("bin"), spec.columns_of("num"), spec.columns_of("cat")
    df = df.withColumns({c: binary_indicator(c) for c in bins})
    split = X.stratified_holdout_then_val(df, row_id, target, seed=seed)
    df = df.join(split, row_id)
    fit = df.filter(F.col("split") == "train") if fit_on == "train" else df
    df = J.impute_apply(df, J.impute_fit(fit, mean_cols=nums, mode_cols=cats))
    df = J.minmax_apply(df, J.minmax_fit(fit, nums))
    df = J.label_encode_apply(df, target, J.label_encode_fit(fit, target), unknown=-1)
    return df.select(row_id, *bins, *nums, *cats, target, "split")


def entity_features(df: DataFrame, entity: str, cols: list[str], dim: int = 8) -> DataFrame:
    e = df.select(clean_entity(entity).alias("entity"), row_sentence(cols).alias("_s"))
    enc = encode_distinct(e, "_s", HashingEncoder(dim), "_v")
    return enc.select("entity", *[F.col("_v")[i].alias(f"X{i}") for i in range(dim)])


def load_recipe(name: str) -> dict:
    with open(os.path.join(RECIPE_DIR, f"{name}.json")) as fh:
        return json.load(fh)


def run_recipe(df: DataFrame, recipe: dict) -> tuple[DataFrame, TableSpec]:
    """Apply the recipe's steps; return the table and its spec."""
    out = P.prepare(df, recipe["steps"])
    spec = TableSpec(target=recipe.get("target"), entity=recipe.get("entity"), task=recipe.get("task", "classification"),
                     kinds={**{c: "num" for c in recipe.get("num", [])}, **{c: "cat" for c in recipe.get("cat", [])}},
                     repeated=recipe.get("repeated", False))
    return out, spec
