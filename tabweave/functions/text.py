"""Scalar cell functions (JVM-side expressions; no Python per row).

Each function takes and returns a ``Column`` so it fuses into whole-stage
codegen and can be used inside ``select`` / ``withColumn`` / recipes.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed values that must equal the reference's semantics.
# pandas' default NA strings; a table's own tokens are given by its recipe.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Values read as "true" by the binary indicator.
TRUE_TOKENS = ["1", "yes", "true", "positive", "t", "y"]
# Characters removed from prices before the numeric cast.
CURRENCY_CHARS = "$,€£¥"

# Unicode letters/digits form a token; everything else separates tokens.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
NUMERIC_TEXT = r"^\s*[+-]?((?i)inf|infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*$"


# ----------------------------------------------------------------- tokens
def tokenize(c: Column | str) -> Column:
    """Lower-cased word tokens of the whole text (no length limit)."""
    return F.filter(F.split(F.lower(F.coalesce(_c(c), F.lit(""))), TOKEN_SPLIT), lambda t: t != "")


def char_ngrams(c: Column | str, n: int = 3) -> Column:
    """Character n-grams of ``' ' + lower(text) + ' '``; too short -> empty.

    The characters are zipped with themselves shifted, which is linear in the text
    (``substring`` at each position would walk the text from its start every time)."""
    p = F.concat(F.lit(" "), F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(" "))
    chars = F.regexp_extract_all(p, F.lit("(?s)."), F.lit(0))
    grams = chars
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(chars, F.lit(k + 1), F.size(chars)), lambda a, b: F.concat(a, b))
    return F.filter(grams, F.isnotnull)  # the last ones lack a character


# ----------------------------------------------------------------- nulls
def null_tokens(c: Column | str, tokens: list[str] | None = None) -> Column:
    """Cell -> NULL when its trimmed text is a missing-value token."""
    c = _c(c)
    return F.when(F.trim(c).isin(tokens or NA_TOKENS), F.lit(None)).otherwise(c)


def null_if_blank(c: Column | str) -> Column:
    c = _c(c)
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(c)


def null_if_value(c: Column | str, value) -> Column:
    return F.nullif(_c(c), F.lit(value))


# ----------------------------------------------------------------- numbers
def to_number(c: Column | str) -> Column:
    """Strict numeric coercion: numeric text -> double, anything else -> NULL.

    Spark alone would accept ``'1d'`` (Java float suffix); the regex guard
    rejects it, like pandas' ``to_numeric(errors='coerce')``.
    """
    c = _c(c).cast("string")
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


def strip_currency(c: Column | str) -> Column:
    return to_number(F.regexp_replace(_c(c), "[" + re.escape(CURRENCY_CHARS) + "]", ""))


def strip_percent(c: Column | str) -> Column:
    return to_number(F.regexp_replace(_c(c), "%+$", ""))


def strip_suffix(c: Column | str, suffix: str) -> Column:
    return to_number(F.regexp_replace(_c(c), re.escape(suffix) + "$", ""))


def drop_last_char(c: Column | str) -> Column:
    c = _c(c)
    return _substr(c, 1, F.length(c) - 1)


def drop_first_char(c: Column | str) -> Column:
    c = _c(c)
    return _substr(c, 2, F.length(c))


def _substr(c: Column, pos, length) -> Column:
    return F.substring(c, F.lit(pos) if isinstance(pos, int) else pos, F.lit(length) if isinstance(length, int) else length)


def duration_minutes(c: Column | str) -> Column:
    """``'1 hr 30 min'`` -> 90, ``'24 min per ep'`` -> 24; 0 or unparsable -> NULL."""
    t = F.regexp_replace(_c(c).cast("string"), " per ep", "")
    hrs = F.coalesce(F.regexp_extract(t, r"^(\d+) hr", 1).try_cast("double"), F.lit(0.0))
    mins = F.coalesce(F.regexp_extract(t, r"(\d+) min", 1).try_cast("double"), F.lit(0.0))
    total = hrs * 60 + mins
    return F.when(total == 0, F.lit(None)).otherwise(total)


def rescale(c: Column | str, factor: float) -> Column:
    return _c(c) * F.lit(factor)


# ----------------------------------------------------------------- text shape
def split_part(c: Column | str, sep: str, i: int) -> Column:
    """Part ``i`` (0-based; -1 = last) after splitting on the literal ``sep``."""
    parts = F.split(_c(c), re.escape(sep))
    return F.element_at(parts, i + 1 if i >= 0 else i)


def regex_extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First match group, NULL when nothing matches."""
    v = F.regexp_extract(_c(c), pattern, group)
    return F.when(_c(c).rlike(pattern), v)


def regex_count(c: Column | str, pattern: str, zero_as_null: bool = True) -> Column:
    n = F.regexp_count(_c(c), F.lit(pattern)).cast("double")
    return F.when(n == 0, F.lit(None)).otherwise(n) if zero_as_null else n


def prefix(c: Column | str, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def suffix(c: Column | str, n: int) -> Column:
    return F.substring(_c(c), -n, n)


def year_text(c: Column | str) -> Column:
    """``2005.0`` -> ``'2005'``."""
    return F.split(_c(c).cast("string"), r"\.").getItem(0)


def trim_chars(c: Column | str, chars: str) -> Column:
    """Strip any of ``chars`` from both ends (``'100.0'`` with ``'.0'`` -> ``'1'``)."""
    return F.btrim(_c(c), F.lit(chars))


def concat_strict(*cols: Column | str, sep: str = " ") -> Column:
    """Concatenate with a separator; NULL if any part is NULL."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(_c(c).cast("string"))
    return F.concat(*parts)


def space_after(c: Column | str, sep: str = ",") -> Column:
    return F.replace(_c(c), F.lit(sep), F.lit(sep + " "))


# ----------------------------------------------------------------- dates
def reformat_date(c: Column | str, in_patterns: list[str], out_pattern: str = "yyyy-MM-dd HH:mm:ss",
                  strict: bool = False) -> Column:
    """Parse with the first matching pattern and re-render as text.

    ``strict=True`` raises on an unparsable non-null value (ANSI ``to_timestamp``)."""
    c = _c(c)
    if strict:
        parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in in_patterns])
        parsed = F.when(c.isNull(), F.lit(None)).when(parsed.isNotNull(), parsed).otherwise(
            F.raise_error(F.concat(F.lit("unparsable date: "), c)))
    else:
        parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in in_patterns])
    return F.date_format(parsed, out_pattern)


# ----------------------------------------------------------------- maps
def map_values(c: Column | str, mapping: dict, keep_unmapped: bool = False) -> Column:
    """Dictionary map; unmapped -> NULL, or kept when ``keep_unmapped``."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    v = F.try_element_at(m, _c(c))
    return F.coalesce(v, _c(c)) if keep_unmapped else v


def fill_from(c: Column | str, other: Column | str) -> Column:
    return F.coalesce(_c(c), _c(other))


# ----------------------------------------------------------------- nested
def names_from_literal_list(c: Column | str, field: str = "name") -> Column:
    """Python-literal list of dicts -> ``'a, b, c'``; empty list -> NULL.

    Quotes are swapped only where they open or close a literal (next to a brace,
    bracket, colon or comma), so an apostrophe inside a name stays."""
    js = F.regexp_replace(_c(c), r"(?<=[{\[,:]\s{0,4})'|'(?=\s*[}\],:])", '"')
    arr = F.from_json(js, f"array<struct<{field}:string>>")
    joined = F.array_join(F.transform(arr, lambda x: x[field]), ", ")
    return F.when(F.size(arr) > 0, joined)


def json_field(c: Column | str, path: str) -> Column:
    """``$.a.b`` of a JSON text; NULL and ``'None'`` both become NULL."""
    v = F.get_json_object(_c(c), path)
    return F.when(v == "None", F.lit(None)).otherwise(v)


# ----------------------------------------------------------------- entity / row text
def clean_entity(c: Column | str) -> Column:
    """Remove ``<``, ``>``, newlines; ``_`` -> space; lower-case."""
    return F.lower(F.translate(F.regexp_replace(_c(c), "[<>\n]", ""), "_", " "))


def row_text(cols: list[str]) -> Column:
    """``col: value, col: value`` over non-blank cells (trimmed)."""
    parts = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "",
                    F.concat(F.lit(f"{c}: "), F.trim(F.col(f"`{c}`").cast("string")))) for c in cols]
    return F.concat_ws(", ", *parts)


def row_sentence(cols: list[str], query_prefix: bool = True) -> Column:
    """``col value. col value.`` over non-null cells; values are cleaned, names stay."""
    parts = [F.when(F.col(f"`{c}`").isNotNull(),
                    F.concat(F.lit(f"{c} "), clean_entity(F.col(f"`{c}`").cast("string")), F.lit(".")))
             for c in cols]
    s = F.concat_ws(" ", *parts)
    return F.concat(F.lit("query: "), s) if query_prefix else s


def encoder_text(cat_cols: list[str], bin_cols: list[str] = ()) -> Column:
    """``col value col value``; a binary column contributes its name when 1."""
    parts = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(c + " "), F.col(f"`{c}`").cast("string")))
             for c in cat_cols]
    parts += [F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in bin_cols]
    return F.concat_ws(" ", *parts)


# ----------------------------------------------------------------- display
def case_id(*cols: Column | str) -> Column:
    return F.concat_ws("_", *[_c(c).cast("string") for c in cols])


def replace_chain(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Ordered chain of substring replacements."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, _c(c))


def significance(p: Column | str) -> Column:
    """Stars of a p-value: each level includes its lower and excludes its upper
    bound. Exactly 0.05 (and a negative value) is in no level and stays as its text."""
    p = _c(p)
    return (F.when(p > 0.05, "NS").when((p >= 0.01) & (p < 0.05), "*").when((p >= 0.001) & (p < 0.01), "**")
            .when((p >= 0) & (p < 0.001), "***").otherwise(p.cast("string")))


def significant(p: Column | str, alpha: float = 0.05) -> Column:
    """1 below ``alpha`` (and above 0), 0 above it; ``alpha`` itself, 0 and negatives stay."""
    p = _c(p).cast("double")
    return F.when(p > alpha, 0.0).when((p > 0) & (p < alpha), 1.0).otherwise(p)


# ----------------------------------------------------------------- binary
def binary_indicator(c: Column | str, tokens: list[str] | None = None) -> Column:
    """1 when the lower-cased text is a true token, else 0; NULL is 0, and nothing is trimmed."""
    return F.coalesce(F.lower(_c(c).cast("string")).isin(tokens or TRUE_TOKENS), F.lit(False)).cast("int")


def binarize(c: Column | str, threshold: float, inclusive: bool = False) -> Column:
    """``< t`` (or ``<= t``) -> 0, else 1; NULL stays NULL."""
    c = _c(c)
    low = c <= threshold if inclusive else c < threshold
    return F.when(c.isNull(), F.lit(None)).when(low, F.lit(0)).otherwise(F.lit(1))


def binarize_contains(c: Column | str, needle: str) -> Column:
    c = _c(c)
    return F.when(c.isNull(), F.lit(None)).when(c.contains(needle), F.lit(1)).otherwise(F.lit(0))


# ----------------------------------------------------------------- logs
def log_target(c: Column | str, base: str = "e", plus_one: bool = False, scale: float | None = None) -> Column:
    """Log transform; a non-positive argument gives NULL (no complex numbers)."""
    x = _c(c).cast("double")
    if scale:
        x = x / F.lit(scale)
    if plus_one:
        x = x + 1
    if base == "e":
        return F.ln(x)
    if base == "10":
        return F.log10(x)
    return F.log(float(base), x)
