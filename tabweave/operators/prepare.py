"""Table preparation ops (B1-B19) and a declarative recipe runner.

Column-level decisions (drop high-null / constant columns) come from ONE
fused aggregate whose single result row (one value per column) is read on
the driver; every row-level step stays a Spark expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import TableSpec
from ..functions import text as T


def q(c: str) -> Column:
    return F.col(f"`{c}`")


# ------------------------------------------------------------------ B1 / B2
def null_counts(df: DataFrame) -> dict:
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count_if(q(c).isNull()).alias(f"z{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*aggs).first()
    return {"n": row["__n"], "nulls": {c: row[f"z{i}"] for i, c in enumerate(df.columns)}}


def high_null_columns(df: DataFrame, p: float = 0.5) -> list[str]:
    """Columns whose null count is strictly greater than ``int(n * p)``."""
    s = null_counts(df)
    cut = int(s["n"] * p)
    return [c for c, z in s["nulls"].items() if z > cut]


def drop_high_null(df: DataFrame, p: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """B1."""
    return df.drop(*[c for c in high_null_columns(df, p) if c not in keep])


def single_unique_columns(df: DataFrame, at_most: bool = False) -> list[str]:
    """Columns with exactly one distinct non-null value (``at_most``: also all-null).

    ``min == max`` over non-null values is equivalent to one distinct value and
    costs a plain aggregate instead of a distinct count per column."""
    aggs = []
    for i, c in enumerate(df.columns):
        aggs += [F.count(q(c)).alias(f"n{i}"), (F.min(q(c)) == F.max(q(c))).alias(f"e{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        if row[f"n{i}"] == 0:
            if at_most:
                out.append(c)
        elif row[f"e{i}"]:
            out.append(c)
    return out


def drop_single_unique(df: DataFrame, at_most: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """B2 (all-null columns stay unless ``at_most``)."""
    return df.drop(*[c for c in single_unique_columns(df, at_most) if c not in keep])


# ------------------------------------------------------------------ B3 / B4 / B5 / B6 / B7
def clean_column_name(name: str) -> str:
    return name.replace(" ", "_").replace("\n", "_").replace("%", "Percentage")


def clean_column_names(df: DataFrame) -> DataFrame:
    """Space and newline -> ``_``, ``%`` -> ``Percentage``."""
    return df.withColumnsRenamed({c: clean_column_name(c) for c in df.columns if clean_column_name(c) != c})


def clean_text_cells(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Newline -> space; ``®``, ``™`` and control characters removed (string columns)."""
    cols = cols if cols is not None else [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: clean_text(q(c)) for c in cols})


def clean_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[\r\n]", " "), "[®™\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def resolve_text_columns(columns: list[str], include: list[str] | None = None,
                         exclude: list[str] | None = None) -> list[str]:
    """``include`` wins, else all columns minus ``exclude``; every listed name must exist."""
    absent = sorted({*(include or ()), *(exclude or ())}.difference(columns))
    if absent:
        raise ValueError(f"columns not found: {absent}; available: {columns}")
    return list(include) if include else [c for c in columns if c not in set(exclude or ())]


def drop_columns(df: DataFrame, names=(), contains=(), positions=(), errors: str = "raise") -> DataFrame:
    """Drop by name, by substring, by position; ``errors='ignore'`` skips absent names."""
    names = list(names)
    missing = [c for c in names if c not in df.columns]
    if missing and errors != "ignore":
        raise ValueError(f"columns not found: {missing}")
    drop = {c for c in names if c in df.columns}
    drop |= {c for c in df.columns if any(s in c for s in contains)}
    drop |= {df.columns[i] for i in positions}
    return df.drop(*[c for c in df.columns if c in drop])


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[q(c) for c in names])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B7."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


# ------------------------------------------------------------------ B8 / B9
def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    """B8."""
    return df.dropna(subset=subset)


def keep_rows(df: DataFrame, pred: Column) -> DataFrame:
    """B9 ``data[mask]``: a NULL predicate drops the row."""
    return df.filter(F.coalesce(pred, F.lit(False)))


def drop_rows(df: DataFrame, pred: Column) -> DataFrame:
    """B9 ``data[~mask]``: a NULL predicate keeps the row."""
    return df.filter(~F.coalesce(pred, F.lit(False)))


# ------------------------------------------------------------------ B10 / B11 / B19
def coerce_numeric(df: DataFrame, cols: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Listed columns (default: every non-string column, plus none of the
    text ones) to double; bad values -> NULL."""
    if cols is None:
        cols = [c for c, t in df.dtypes if t != "string" and c not in exclude]
    return df.withColumns({c: T.to_number(q(c)) for c in cols})


def as_category(df: DataFrame, cols: list[str], keep_null: bool = False) -> DataFrame:
    """To string (Spark's rendering); a missing value becomes the category
    ``'nan'`` unless ``keep_null``."""
    def cat(c):
        s = q(c).cast("string")
        return s if keep_null else F.coalesce(s, F.lit("nan"))
    return df.withColumns({c: cat(c) for c in cols})


def fit_cells(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Categorical -> string, numeric -> double with NULL -> 0."""
    ex = {c: q(c).cast("string") for c in spec.columns_of("cat") if c in df.columns}
    ex.update({c: F.coalesce(T.to_number(q(c)), F.lit(0.0)) for c in spec.columns_of("num") if c in df.columns})
    return df.withColumns(ex)


# ------------------------------------------------------------------ B15 - B18
def kind_order(spec: TableSpec) -> list[str]:
    """Bin, num, cat column order (target excluded, names lower-case)."""
    return spec.columns_of("bin") + spec.columns_of("num") + spec.columns_of("cat")


def kinds_from_dtypes(df: DataFrame, target: str | None = None) -> dict[str, list[str]]:
    """String columns are categorical, others numerical; target removed."""
    cat = [c for c, t in df.dtypes if t == "string" and c != target]
    num = [c for c, t in df.dtypes if t != "string" and c != target]
    return {"cat": cat, "num": num}


def lowercase_first(df: DataFrame) -> DataFrame:
    """Lower-case names, keep the first of duplicates (by position).

    Spark resolves names case-insensitively, so columns are first renamed
    positionally to unique temporary names."""
    tmp = [f"__c{i}" for i in range(len(df.columns))]
    seen: dict[str, str] = {}
    for t, c in zip(tmp, df.columns):
        seen.setdefault(c.lower(), t)
    return df.toDF(*tmp).select(*[F.col(t).alias(c) for c, t in seen.items()])


def check_kind_overlap(spec: TableSpec, kinds: dict[str, list[str]], retag: bool = False) -> dict[str, list[str]]:
    """A column in two kind lists raises, or (``retag``) is renamed ``[kind]col``."""
    where: dict[str, list[str]] = {}
    for k, cols in kinds.items():
        for c in cols:
            where.setdefault(c, []).append(k)
    clash = {c: ks for c, ks in where.items() if len(ks) > 1}
    if clash and not retag:
        raise ValueError(f"columns with more than one kind: {clash}")
    return {k: [f"[{k}]{c}" if c in clash else c for c in cols] for k, cols in kinds.items()}


# ------------------------------------------------------------------ recipe runner
def _each(make):
    """A step that rewrites its columns: ``make(column, step)``."""
    return lambda df, cols, step: df.withColumns({c: make(q(c), step) for c in cols})


def _texts(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def _encode_label(df: DataFrame, cols: list[str], step: dict) -> DataFrame:
    from .features import label_encode_apply, label_encode_fit

    for c in cols:
        df = label_encode_apply(df, c, label_encode_fit(df, c))
    return df


def _distinct(df: DataFrame, cols: list[str], step: dict) -> DataFrame:
    from .augment import distinct_keep_first

    return distinct_keep_first(df, cols, step["row_id"])


# Steps that work on listed columns (``cols``, or ``col`` for one).
COLUMN_STEPS = {
    "clean_text": _each(lambda c, s: clean_text(c)),
    "na_tokens": _each(lambda c, s: T.null_tokens(c, s.get("tokens"))),
    "null_blank": _each(lambda c, s: T.null_if_blank(c)),
    "null_value": _each(lambda c, s: T.null_if_value(c, s["value"])),
    "numeric": _each(lambda c, s: T.to_number(c)),
    "currency": _each(lambda c, s: T.strip_currency(c)),
    "percent": _each(lambda c, s: T.strip_percent(c)),
    "suffix_number": _each(lambda c, s: T.strip_suffix(c, s["suffix"])),
    "drop_first_char": _each(lambda c, s: T.drop_first_char(c)),
    "drop_last_char": _each(lambda c, s: T.drop_last_char(c)),
    "minutes": _each(lambda c, s: T.duration_minutes(c)),
    "rescale": _each(lambda c, s: T.rescale(c, s["factor"])),
    "lower": _each(lambda c, s: F.lower(c.cast("string"))),
    "text": _each(lambda c, s: c.cast("string") if s.get("keep_null") else F.coalesce(c.cast("string"), F.lit("nan"))),
    "split_part": _each(lambda c, s: T.split_part(c, s["sep"], s.get("index", 0))),
    "regex": _each(lambda c, s: T.regex_extract(c, s["pattern"], s.get("group", 1))),
    "regex_count": _each(lambda c, s: T.regex_count(c, s["pattern"], s.get("zero_as_null", True))),
    "first_chars": _each(lambda c, s: T.prefix(c, s["n"])),
    "last_chars": _each(lambda c, s: T.suffix(c, s["n"])),
    "year": _each(lambda c, s: T.year_text(c)),
    "trim_chars": _each(lambda c, s: T.trim_chars(c, s["chars"])),
    "space_after": _each(lambda c, s: T.space_after(c, s.get("sep", ","))),
    "date": _each(lambda c, s: T.reformat_date(c, s["patterns"], s.get("out", "yyyy-MM-dd HH:mm:ss"), s.get("strict", False))),
    "map": _each(lambda c, s: T.map_values(c, s["map"], s.get("keep", False))),
    "fill_from": _each(lambda c, s: T.fill_from(c, q(s["other"]))),
    "names": _each(lambda c, s: T.names_from_literal_list(c, s.get("field", "name"))),
    "json_field": _each(lambda c, s: T.json_field(c, s["path"])),
    "log": _each(lambda c, s: T.log_target(c, str(s.get("base", "e")), s.get("plus_one", False), s.get("scale"))),
    "binary": _each(lambda c, s: T.binary_indicator(c, s.get("tokens"))),
    "binarize": _each(lambda c, s: T.binarize(c, s["threshold"], s.get("inclusive", False))),
    "binarize_contains": _each(lambda c, s: T.binarize_contains(c, s["needle"])),
    "dropna": lambda df, cols, s: drop_null_rows(df, cols),
    "select": lambda df, cols, s: keep_columns(df, cols),
    "distinct": _distinct,
    "label_encode": _encode_label,
}
# Steps that work on the table.
TABLE_STEPS = {
    "clean_names": lambda df, s: clean_column_names(df),
    "drop": lambda df, s: drop_columns(df, s.get("names", ()), s.get("contains", ()), s.get("positions", ()),
                                       "ignore" if s.get("ignore") else "raise"),
    "rename": lambda df, s: rename_columns(df, s["map"]),
    "drop_high_null": lambda df, s: drop_high_null(df, s.get("p", 0.5), tuple(s.get("keep", ()))),
    "drop_single_unique": lambda df, s: drop_single_unique(df, s.get("at_most", False), tuple(s.get("keep", ()))),
    "concat": lambda df, s: df.withColumn(s["out"], T.concat_strict(*[q(c) for c in s["of"]], sep=s.get("sep", " "))),
    "filter": lambda df, s: keep_rows(df, F.expr(s["expr"])),
    "exclude": lambda df, s: drop_rows(df, F.expr(s["expr"])),
}
EVERY_TEXT = ("clean_text", "na_tokens", "null_blank")  # without a list: all string columns


def run_step(df: DataFrame, step: dict) -> DataFrame:
    """One recipe step. A listed column that the table lacks raises, unless the
    step says ``"ignore": true`` (then it works on those that are there)."""
    op = step["op"]
    if op in TABLE_STEPS:
        return TABLE_STEPS[op](df, step)
    if op not in COLUMN_STEPS:
        raise ValueError(f"unknown recipe op {op!r}")
    listed = [step["col"]] if "col" in step else step.get("cols")
    if listed is None:
        if op not in EVERY_TEXT:
            raise ValueError(f"recipe op {op!r} needs cols")
        listed = _texts(df)
    absent = [c for c in listed if c not in df.columns]
    if absent and not step.get("ignore"):
        raise ValueError(f"recipe op {op!r}: no columns {absent}")
    present = [c for c in listed if c in df.columns]
    return COLUMN_STEPS[op](df, present, step) if present else df


def prepare(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Run a recipe: an ordered list of ``{"op": ..., ...}`` steps."""
    for s in steps:
        df = run_step(df, s)
    return df


def safe_name(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", name)
