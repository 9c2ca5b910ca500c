"""Places in an order without sorting it: the rows before the c-th one of each group, and the value there.

A split, a fold, a sample or a quantile needs a few places in the order of each group, not the rank of every row. Rows are counted per
group and leading bits of their order key (partial aggregates; no row is shuffled), the counts tell the interval that a
place falls into, and intervals with more than ``EDGE_ROWS`` rows are counted again by their next bits: one more pass for
every ``2 ** BITS`` times as many rows. Only the rows of the last intervals are ranked, by key and ids.

Keys are bigints; equal ones go by the ids. Where so many rows share one key that an interval cannot get smaller, its rows are
ranked by range partitions (``core.positions``), so no group of ties meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import measured, positions
from ..session import ensure_checkpoint_dir

BITS = 12  # of the key, a pass
EDGE_ROWS = 200_000  # rows of an interval that one task ranks


def double_bits(c: Column) -> Column:
    """The bits of a double as a bigint in the order of the doubles: -0.0 equals 0.0, NaN comes last, null stays null."""
    x = c.cast("double")
    a = F.abs(x)
    guess = F.floor(F.log2(a)).cast("int")
    low = F.pow(F.lit(2.0), guess)  # the logarithm may round across a power of two
    exp = F.when(a < low, guess - 1).when(a >= low * 2, guess + 1).otherwise(guess)
    normal = F.shiftleft((exp + 1023).cast("bigint"), 52) + ((a / F.pow(F.lit(2.0), exp) - 1) * F.lit(float(2 ** 52))).cast("bigint")
    tiny = (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint")  # below the least normal number
    bits = (F.when(F.isnan(x), F.lit(0x7FF8000000000000)).when(a == F.lit(float("inf")), F.lit(0x7FF0000000000000))
            .when(a < F.lit(2.0 ** -1022), tiny).otherwise(normal))
    return F.when(x < 0, -bits).otherwise(bits)


def _renamed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumnsRenamed({b: f"_by_{b}" for b in by})


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> list[Column]:
    return [left[b].eqNullSafe(right[f"_by_{b}"]) for b in by]


def intervals(df: DataFrame, by: list[str], key: str, places: Callable[[Column], list[Column]], key_bits: int,
              edge_rows: int) -> tuple[DataFrame, int, bool]:
    """(by..., _i, _c, _lo, _before, _n, _m): for the ``_i``-th place the leading bits ``_lo`` of the interval that holds row ``_c``, the
    rows before and in it; the bits that are not leading; and whether an interval has more than ``edge_rows``. Places
    outside ``1..m`` have no row."""
    ensure_checkpoint_dir(df.sparkSession)
    shift = max(0, key_bits - BITS)
    w = Window.partitionBy(*by).orderBy("_lo")
    counts = df.groupBy(*by, F.shiftright(F.col(key), shift).alias("_lo")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({"_upto": F.sum("_n").over(w), "_m": F.sum("_n").over(Window.partitionBy(*by))})
    at = F.posexplode(F.array(*[c.cast("bigint") for c in places(F.col("_m"))])).alias("_i", "_c")
    holds = "_before < _c and _c <= _before + _n"
    found = counts.select(*by, "_lo", "_n", (F.col("_upto") - F.col("_n")).alias("_before"), "_m", at).filter(holds).checkpoint(eager=True)

    def largest() -> int:
        return found.filter("_c < _before + _n").agg(F.max("_n")).first()[0] or 0

    while shift and largest() > edge_rows:
        deeper = max(0, shift - BITS)
        wide = _renamed(found.select(*by, "_lo").distinct(), by)
        inner = df.join(wide, [*_same(df, wide, by), F.shiftright(df[key], shift) == wide["_lo"]])
        w = Window.partitionBy(*by, "_lo").orderBy("_deep")
        part = (inner.groupBy(*by, "_lo", F.shiftright(F.col(key), deeper).alias("_deep")).agg(F.count(F.lit(1)).alias("_k"))
                .withColumn("_more", F.sum("_k").over(w) - F.col("_k")))
        part = _renamed(part.withColumnRenamed("_lo", "_above"), by)
        found = (found.join(part, [*_same(found, part, by), found["_lo"] == part["_above"]])
                 .select(*by, F.col("_deep").alias("_lo"), F.col("_k").alias("_n"), (F.col("_before") + F.col("_more")).alias("_before"),
                         "_m", "_i", "_c").filter(holds).checkpoint(eager=True))
        shift = deeper
    return found, shift, largest() > edge_rows


def sliced(df: DataFrame, by: list[str], key: str, ids: list[str], cuts: Callable[[Column], list[Column]], out: str = "slice",
           key_bits: int = 60, edge_rows: int = EDGE_ROWS, size_col: str | None = None) -> DataFrame:
    """``df`` with ``out``: how many of its group's cuts a row lies behind, the rows in the order of ``key``, then ``ids``.

    ``cuts(m)`` gives the ascending row counts at which a group of ``m`` rows is cut; a row is behind a cut at ``c`` if its
    position is greater. ``key`` is a bigint of ``key_bits`` bits (64: signed). Null group values are a group. ``size_col`` adds the
    size of the group."""
    # the last row is a place too, so that every group is found
    found, shift, big = intervals(df, by, key, lambda m: [*cuts(m), m], key_bits, edge_rows)
    n_cuts = len(cuts(F.lit(0)))
    # a column a cut, not a list with lambdas: Spark may push a lambda over the rows' key below the join, where there is no key
    kind = "struct<_c:bigint,_lo:bigint,_before:bigint,_n:bigint>"
    each_cut = [F.max(F.when(F.col("_i") == i, F.struct("_c", "_lo", "_before", "_n"))).alias(f"_cut{i}") for i in range(n_cuts)]
    if by:
        each = measured(_renamed(found.groupBy(*by).agg(*each_cut, F.max("_m").alias("_m")), by))
        rows = df.join(each, _same(df, each, by)).drop(*[f"_by_{b}" for b in by])
    else:  # a few numbers
        got = found.agg(*each_cut, F.max("_m").alias("_m")).first()
        given = [got[f"_cut{i}"] for i in range(n_cuts)]
        rows = df.withColumns({**{f"_cut{i}": (F.struct(*[F.lit(v).alias(k) for k, v in c.asDict().items()]) if c else F.lit(None)).cast(kind)
                                  for i, c in enumerate(given)}, "_m": F.lit(got["_m"] or 0).cast("bigint")})
    here = F.shiftright(F.col(key), shift)
    passed, inside = F.lit(0), {}
    for i, limit in enumerate(cuts(F.col("_m"))):
        cut = F.col(f"_cut{i}")
        # a cut before the first row has no interval and lies before every row
        none = F.when(limit > F.col("_m"), 0).otherwise(1)
        passed = passed + F.when(cut.isNull(), none).when(here > cut["_lo"], 1).otherwise(0)
        inside[f"_in{i}"] = F.coalesce((here == cut["_lo"]) & (cut["_c"] < cut["_before"] + cut["_n"]), F.lit(False))
    kept = [*df.columns, *([F.col("_m").alias(size_col)] if size_col else [])]
    rows = rows.withColumns({"_passed": passed, **inside})
    some = F.greatest(F.lit(False), F.lit(False), *[F.col(c) for c in inside])
    edge = rows.filter(some).withColumn("_lo", here)
    if big:
        edge = positions(edge, [*by, "_lo"], [key, *ids], out="_r")
    else:
        edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_lo").orderBy(key, *ids)))
    behind = sum((F.when(F.col(f"_in{i}") & (F.col("_r") + F.col(f"_cut{i}")["_before"] > F.col(f"_cut{i}")["_c"]), 1).otherwise(0)
                  for i in range(n_cuts)), F.lit(0))
    plain = rows.filter(~some)
    return plain.select(*kept, F.col("_passed").alias(out)).unionByName(edge.select(*kept, (F.col("_passed") + behind).alias(out)))


def keys_at(df: DataFrame, by: list[str], key: str, places: Callable[[Column], list[Column]], key_bits: int = 60,
            edge_rows: int = EDGE_ROWS) -> DataFrame:
    """(by..., m, keys): the keys at the given 1-based places of each group. Places outside ``1..m`` are null."""
    rows = df.select(*by, F.col(key).alias("_key"))
    n_places = len(places(F.lit(0)))
    found, shift, big = intervals(rows, by, "_key", lambda m: [*places(m), m], key_bits, edge_rows)
    wide = _renamed(found.select(*by, F.col("_lo").alias("_at"), "_n").distinct(), by)
    inner = rows.join(wide, [*_same(rows, wide, by), F.shiftright(rows["_key"], shift) == wide["_at"]])
    if shift == 0:  # one key an interval: of a hot key one row is enough
        ranked = inner.groupBy(*by, "_at").agg(F.min("_key").alias("_k")).withColumn("_r", F.lit(None).cast("int"))
    elif big:
        ranked = positions(inner, [*by, "_at"], ["_key"], out="_r").withColumn("_k", F.col("_key"))
    else:
        ranked = inner.select("*", F.row_number().over(Window.partitionBy(*by, "_at").orderBy("_key")).alias("_r"), F.col("_key").alias("_k"))
    ranked = _renamed(ranked.select(*by, "_at", "_r", "_k"), by)
    picked = found.join(ranked, [*_same(found, ranked, by), found["_lo"] == ranked["_at"],
                                 F.coalesce(ranked["_r"] == found["_c"] - found["_before"], F.lit(True))])
    keys = F.transform(F.sequence(F.lit(0), F.lit(n_places - 1)), lambda i: F.try_element_at(F.col("_got"), i))
    return (picked.groupBy(*by).agg(F.max("_m").alias("m"), F.map_from_entries(F.collect_list(F.struct("_i", "_k"))).alias("_got"))
            .select(*by, "m", keys.alias("keys")))


def bits_double(bits: Column) -> Column:
    """The double that ``double_bits`` made a bigint of."""
    b = F.abs(bits)
    exp, part = F.shiftright(b, 52).cast("int"), b.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    normal = (F.lit(1.0) + part / F.lit(float(2 ** 52))) * F.pow(F.lit(2.0), exp - 1023)
    tiny = part * F.lit(2.0 ** -537) * F.lit(2.0 ** -537)
    size = (F.when(b == F.lit(0x7FF8000000000000), F.lit(float("nan"))).when(b == F.lit(0x7FF0000000000000), F.lit(float("inf")))
            .when(exp == 0, tiny).otherwise(normal))
    return F.when(bits < 0, -size).otherwise(size)


def selected(df: DataFrame, by: list[str], value: str, places: Callable[[Column], list[Column]], edge_rows: int = EDGE_ROWS) -> DataFrame:
    """(by..., m, values): the values (doubles) at the given 1-based places of each group, nulls left out. Places outside
    ``1..m`` are null."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, double_bits(F.col(value)).alias("_bits"))
    got = keys_at(rows, by, "_bits", places, 64, edge_rows)
    return got.select(*by, "m", F.transform("keys", bits_double).alias("values"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], edge_rows: int = EDGE_ROWS) -> DataFrame:
    """(by..., m, quantiles): exact quantiles with linear interpolation, without a buffer of all values."""
    spots = [lambda m, p=p: (m - 1) * F.lit(float(p)) for p in shares]
    places = lambda m: [f(spot(m)) + 1 for spot in spots for f in (F.floor, F.ceil)]
    got = selected(df, by, value, places, edge_rows)
    m, v = F.col("m"), F.col("values")
    out = []
    for k, spot in enumerate(spots):
        low, high, part = v[2 * k], v[2 * k + 1], spot(m) - F.floor(spot(m))
        out.append(F.when(part == 0, low).otherwise(low * (1 - part) + high * part))
    return got.select(*by, "m", F.array(*out).alias("quantiles"))
