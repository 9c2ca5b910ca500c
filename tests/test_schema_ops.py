"""Schema-level and driver-list operators (B5, B15-B18, C11, N2, D5, J-ops, M4/M5, recipes)."""

import pytest
from pyspark.sql import functions as F

from tabweave.core import TableSpec
from tabweave.functions import text as X
from tabweave.operators import augment as A
from tabweave.operators import features as J
from tabweave.operators import graph as G
from tabweave.operators import prepare as P
from tabweave.operators.runs import param_grid


def test_resolve_text_columns():
    cols = ["id", "name", "city", "label"]
    assert P.resolve_text_columns(cols, include=["city", "name"]) == ["city", "name"]
    assert P.resolve_text_columns(cols, exclude=["id", "label"]) == ["name", "city"]
    with pytest.raises(ValueError):
        P.resolve_text_columns(cols, include=["nope"])


def test_kinds_and_overlap(spark):
    df = spark.createDataFrame([(1, "a", 2.0, "y")], "id int, name string, v double, target string")
    assert P.kinds_from_dtypes(df, "target") == {"cat": ["name"], "num": ["id", "v"]}
    spec = TableSpec.from_kinds(bin_cols=["B"], num_cols=["N1", "n2"], cat_cols=["C"], target="n2")
    assert P.kind_order(spec) == ["b", "n1", "c"]
    with pytest.raises(ValueError):
        P.check_kind_overlap(spec, {"num": ["x"], "cat": ["x", "y"]})
    assert P.check_kind_overlap(spec, {"num": ["x"], "cat": ["x", "y"]}, retag=True) == {"num": ["[num]x"], "cat": ["[cat]x", "y"]}


def test_lowercase_first_keeps_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("Key", "key", "Other")
    out = P.lowercase_first(df)
    assert out.columns == ["key", "other"] and out.first()["key"] == 1


def test_column_map_frame_and_label_set(spark):
    m = A.column_map_frame(spark, {"Name": "name", "v": "v"}).collect()
    assert {(r["aux_column"], r["renamed"]) for r in m} == {("Name", True), ("v", False)}
    df = spark.createDataFrame([(" a ",), ("a",), ("",), (None,), ("b",)], "l string")
    assert sorted(r["label"] for r in A.label_set(df, "l").collect()) == ["a", "b"]


def test_param_grid_order(spark):
    g = param_grid(spark, {"depth": [2, 4], "lr": [0.1, 0.3, 0.5]})
    rows = g.orderBy("config_idx").collect()
    assert len(rows) == 6 and (rows[0]["depth"], rows[0]["lr"]) == (2, 0.1) and (rows[1]["depth"], rows[1]["lr"]) == (2, 0.3)


def test_encoders_and_scalers(spark):
    train = spark.createDataFrame([(1, "b", 1.0), (2, "a", 3.0), (3, "b", None)], "id int, c string, x double")
    test = spark.createDataFrame([(4, "z", 5.0)], "id int, c string, x double")
    enc = {r["value"]: r["code"] for r in J.label_encode_fit(train, "c").collect()}
    assert enc == {"a": 0, "b": 1}
    assert J.ordinal_encode(train, test, ["c"]).first()["c"] == -1
    vals = J.impute_fit(train, mean_cols=["x"], mode_cols=["c"])
    assert vals == {"x": 2.0, "c": "b"}
    mm = J.minmax_apply(train.na.fill(0.0), J.minmax_fit(train, ["x"])).orderBy("id").collect()
    assert [r["x"] for r in mm] == [0.0, 1.0, -0.5]
    cats = J.one_hot_fit(train, "c")
    oh = J.one_hot_apply(test, "c", cats).first()
    assert oh["c_a"] == 0 and oh["c_b"] == 0


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(2,), (1,), (2,), (1,)], "v int")
    assert J.impute_fit(df, mode_cols=["v"]) == {"v": 1}
    empty = spark.createDataFrame([(None,)], "v string")
    assert J.impute_fit(empty, mode_cols=["v"]) == {"v": "Unknown"}


def test_column_views_and_corruption(spark):
    df = spark.createDataFrame([(i, i, i * 10, i * 100, -i) for i in range(6)], "id int, a int, b int, c int, d int")
    v = G.column_views(df, ["a", "b", "c", "d"], 2, 0.5, keep=["id"])
    v0 = [c for c in v.filter("view = 0").dropna(how="all", subset=["a", "b", "c", "d"]).columns]
    assert set(v.columns) == {"id", "a", "b", "c", "d", "view"} and v.count() == 12
    cv = G.corrupted_view(df, "id", ["a", "b", "c", "d"], seed=3)
    rows = cv.collect()
    assert sorted(r["a"] for r in rows) == list(range(6))  # the block is a permutation
    assert all(r["c"] == r["id"] * 100 for r in rows)      # the rest stays aligned


def test_recipe_runner(spark):
    from tabweave.plans.evaluation import load_recipe, run_recipe
    df = spark.createDataFrame([(1, "A b", "$1,200.50", "N/A"), (2, "c", "$3", "5"), (3, "d", "$4", "6")],
                               "id int, `Customer Name` string, price_text string, nation_text string")
    df = df.withColumn("segment", F.lit("s")).withColumn("Acct%", F.lit(None).cast("double")) \
        .withColumn("half_null", F.lit(1)).withColumn("messy_text", F.lit("x\ny"))
    out, spec = run_recipe(df, load_recipe("standin_customer"))
    r = {x["id"]: x for x in out.collect()}
    assert r[1]["price_text"] == 1200.5 and r[1]["nation_text"] is None and r[2]["nation_text"] == 5.0
    assert "AcctPercentage" not in out.columns and spec.target == "segment"


def test_benchmark_recipes_parse():
    import os

    from tabweave.plans.evaluation import RECIPE_DIR, load_recipe
    names = [f[:-5] for f in os.listdir(RECIPE_DIR) if f.endswith(".json")]
    assert len(names) == 13
    for n in names:
        rec = load_recipe(n)
        assert all(s["op"] in {**P.COLUMN_STEPS, **P.TABLE_STEPS} for s in rec["steps"])
        assert rec["target"] or n in ("nnstocks_wiki", "agbooks_goodreads")


def test_batch_encoder_plugs_into_knn(spark):
    import numpy as np

    from tabweave.operators import match as M
    from tabweave.operators.encoder import BatchEncoder, encode

    def loader():
        return lambda texts: np.array([[len(t), t.count("a") + 1.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([(1, "aaa"), (2, "bb"), (3, "aab")], "id bigint, text string")
    v = encode(df, "text", BatchEncoder(loader, 2, name="toy"))
    assert dict(v.dtypes)["vec"] == "array<float>"
    knn = {r["t1_id"]: r["t2_id"] for r in M.vector_knn(v, "id", "vec", v, "id", "vec", k=1, exclude_same_id=True).collect()}
    assert set(knn) == {1, 2, 3}


# ------------------------------------------------------------------ rules with a deciding case
def test_encoding_is_read_from_every_line(spark, tmp_path):
    from tabweave.sources.files import detect_encoding, read_csv_auto

    path = tmp_path / "t.csv"
    path.write_bytes(b"a\n" + b"plain\n" * 20_000 + "caf\xe9\n".encode("latin-1"))
    assert detect_encoding(spark, str(path)) == "ISO-8859-1"
    back, _ = read_csv_auto(spark, str(path))
    assert back.filter("a = 'café'").count() == 1


def test_ratio_counts_and_draws_are_64_bit(spark):
    from tabweave.core import ratio_count, seeded_uint

    assert spark.range(1).select(ratio_count(F.lit(4_000_000_000), 0.7)).first()[0] == 2_800_000_000
    top = spark.range(2_000).select(seeded_uint(1, "id").alias("u")).agg(F.max("u"), F.min("u")).first()
    assert 1 << 59 < top[0] < 1 << 60 and top[1] > 1 << 32


def test_one_hot_has_no_cap(spark):
    df = spark.range(10_001).select(F.col("id"), F.concat(F.lit("c"), F.col("id")).alias("c"))
    got = J.one_hot_vector(df, df.union(df.limit(1).select(F.lit(-1), F.lit("new"))), "c", out="v")
    assert got.count() == 10_002 and got.first()["v"].size == 10_001


def test_binary_indicator_and_significance(spark):
    df = spark.createDataFrame([(None,), ("T",), (" T ",), ("YES",), ("0",)], "a string")
    assert [r[0] for r in df.select(X.binary_indicator("a")).collect()] == [0, 1, 0, 1, 0]
    ps = [0.0, 0.0009, 0.001, 0.01, 0.05, 0.06, None]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    assert [r[0] for r in df.select(X.significance("p")).collect()] == ["***", "***", "**", "*", "0.05", "NS", None]
    assert [r[0] for r in df.select(X.significant("p")).collect()] == [0.0, 1.0, 1.0, 1.0, 0.05, 0.0, None]


def test_names_with_an_apostrophe(spark):
    df = spark.createDataFrame([("[{'name': 'Bob's Bar'}, {'name': 'x'}]",), ("[]",)], "a string")
    assert [r[0] for r in df.select(X.names_from_literal_list("a")).collect()] == ["Bob's Bar, x", None]


def test_what_must_raise(spark, tmp_path):
    from tabweave.plans.union_da import labelled_aux
    from tabweave.sources.files import read_split

    with pytest.raises(ValueError):
        P.resolve_text_columns(["a"], exclude=["nope"])
    with pytest.raises(ValueError):
        A.label_set(spark.createDataFrame([(" ",), (None,)], "l string"), "l")
    spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string").write.parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError):
        read_split(spark, str(tmp_path / "s"), ["id"])
    with pytest.raises(ValueError):
        labelled_aux(spark.range(1).withColumn("y", F.lit(1)), "id", "y")
    with pytest.raises(ValueError):
        P.prepare(spark.range(1), [{"op": "numeric", "cols": ["nope"]}])
    assert P.prepare(spark.range(1), [{"op": "numeric", "cols": ["nope"], "ignore": True}]).columns == ["id"]


def test_chunk_columns_deal():
    from tabweave.operators.sample import chunk_columns

    cols = [f"c{i}" for i in range(11)]
    plan = chunk_columns(cols, 3, seed=1)
    assert len(plan) == 3 and set().union(*plan) == set(cols)
    assert all(4 <= len(p) <= 5 for p in plan)  # three of its own, one drawn, at most one left over


def test_view_columns():
    assert G.view_columns(list("abcde"), 2, 0.4) == [["a", "b", "c", "d", "e"], ["d", "e", "b", "c"]]
    assert G.view_columns(list("ab"), 1, 0.5) == [["a", "b"]]


def test_star_graph_self_loops(spark):
    df = spark.createDataFrame([(1, "x", -2.0), (2, None, 0.0)], "id int, t string, n double")
    got = G.star_edges(df, "id", ["t"], ["n"]).groupBy("row_id", "kind").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(1, "text"): 1, (1, "num"): 1, (1, "self"): 2, (2, "num"): 1, (2, "self"): 1}


RECIPE_ROWS = {
    "maryland": ({"Crash Date/Time": "01/02/2020 03:04:05 PM", "Number of Lanes": "2", "Weather": None, "Collision Type": "a",
                  "Report Number": "r1", "Local Case Number": "c", "Location": "l"},
                 {"Crash_Date/Time": "2020-01-02 15:04:05", "Number_of_Lanes": 2.0, "Weather": "nan", "Collision_Type": 0}),
    "seattle": ({"COLLISIONTYPE": "z", "INCDATE": "bad", "PERSONCOUNT": "3", "STATUS": "Unknown", "REPORTLINK": "u"},
                {"COLLISIONTYPE": 0, "INCDATE": None, "PERSONCOUNT": 3.0, "STATUS": "Unknown"}),
    "newyork": ({"StatuteCodes": "s", "BBL": "1e3", "ApprovedDate": "2021-05-06", "Class": "A"}, {"StatuteCodes": 0, "BBL": 1000.0, "ApprovedDate": "2021-05-06", "Class": "A"}),
    "chicago": ({"VIOLATION DESCRIPTION": "d", "SSA": None, "LATITUDE": "x"}, {"VIOLATION_DESCRIPTION": 0, "SSA": "nan", "LATITUDE": None}),
    "nnstocks_stocks": ({"sector": "s", "lastsale": "$1,234.5", "pctchange": "-2.5%", "industry": "i", "name": "n"}, {"sector": 0, "lastsale": 1234.5, "pctchange": -2.5, "name": "n"}),
    "nnstocks_wiki": ({"wiki_title": "w", "revenue": None, "website": "u"}, {"wiki_title": "w", "revenue": "nan"}),
    "discogs": ({"genres": "g", "release_year": "1999", "region": "eu"}, {"genres": 0, "release_year": 1999.0, "region": "eu"}),
    "sp": ({"track_genre": "g", "explicit": "True", "tempo": "120.5", "Unnamed: 0": "7"}, {"track_genre": 0, "explicit": 1, "tempo": 120.5, "Unnamed:_0": 7.0}),
    "nctaxi_newyork_taxi": ({"dolocationid": "5", "fare_amount": "n/a", "payment_type": "1"}, {"dolocationid": 0, "fare_amount": None, "payment_type": "1"}),
    "nctaxi_chicago_taxi": ({"dropoff_community_area": "8", "fare": "7.5", "company": None}, {"dropoff_community_area": 0, "fare": 7.5, "company": "nan"}),
    "agbooks_amazon": ({"categories": "c", "average_rating": "4.5", "store": None}, {"categories": 0, "average_rating": 4.5, "store": "nan"}),
    "agbooks_goodreads": ({"title": "t", "num_pages": "", "format": "pb"}, {"title": "t", "num_pages": None, "format": "pb"}),
}


@pytest.mark.parametrize("name", sorted(RECIPE_ROWS))
def test_recipe(spark, name):
    """One row that decides, three that keep its columns from being screened out."""
    from tabweave.plans.evaluation import load_recipe, run_recipe

    row, want = RECIPE_ROWS[name]
    recipe = load_recipe(name)
    filler = lambda n: {c: (f"0{n}/03/2020 01:00:00 AM" if c == "Crash Date/Time" else f"~{n}{c}") for c in row}
    target = recipe["target"]
    rows = [row, filler(4), filler(5), {c: (None if target and c.replace(" ", "_") == target else v) for c, v in filler(6).items()}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{c}` string" for c in row))
    got, spec = run_recipe(df, recipe)
    assert got.count() == (3 if target else 4) and spec.target == target
    first = [r.asDict() for r in got.collect()]
    assert any({c: r.get(c) for c in want} == want for r in first), first


STEP_CASES = [
    ({"op": "clean_text"}, "a\nb®", "a b"), ({"op": "na_tokens"}, " n/a ", None), ({"op": "na_tokens", "tokens": ["?"]}, "n/a", "n/a"),
    ({"op": "null_blank"}, "  ", None), ({"op": "null_value", "value": "x"}, "x", None), ({"op": "numeric"}, "1e2", 100.0),
    ({"op": "currency"}, "$1,5", 15.0), ({"op": "percent"}, "5%", 5.0), ({"op": "suffix_number", "suffix": " km"}, "7 km", 7.0),
    ({"op": "drop_first_char"}, "abc", "bc"), ({"op": "drop_last_char"}, "abc", "ab"), ({"op": "minutes"}, "1 hr 5 min", 65.0),
    ({"op": "lower"}, "AB", "ab"), ({"op": "text"}, None, "nan"), ({"op": "text", "keep_null": True}, None, None),
    ({"op": "split_part", "sep": "-", "index": -1}, "a-b", "b"), ({"op": "regex", "pattern": "(\\d+)"}, "a12", "12"),
    ({"op": "regex_count", "pattern": "a"}, "aba", 2.0), ({"op": "first_chars", "n": 2}, "abc", "ab"), ({"op": "last_chars", "n": 2}, "abc", "bc"),
    ({"op": "year"}, "2005.0", "2005"), ({"op": "trim_chars", "chars": ".0"}, "100.0", "1"), ({"op": "space_after"}, "a,b", "a, b"),
    ({"op": "date", "patterns": ["MM/dd/yyyy"], "out": "yyyy"}, "01/02/2003", "2003"), ({"op": "map", "map": {"a": "b"}}, "a", "b"),
    ({"op": "fill_from", "other": "o"}, None, "other"), ({"op": "names"}, "[{'name': 'n'}]", "n"), ({"op": "json_field", "path": "$.k"}, '{"k": "v"}', "v"),
    ({"op": "binary"}, "Yes", 1), ({"op": "binarize_contains", "needle": "b"}, "abc", 1),
]


@pytest.mark.parametrize("step, cell, want", STEP_CASES)
def test_recipe_step(spark, step, cell, want):
    df = spark.createDataFrame([(cell, "other")], "c string, o string")
    assert P.run_step(df, {**step, "col": "c"}).first()["c"] == want


def test_recipe_number_and_table_steps(spark):
    df = spark.createDataFrame([(4.0, "x", None), (1.0, "y", "z")], "n double, a string, b string")
    steps = [{"op": "rescale", "col": "n", "factor": 25.0}, {"op": "log", "col": "n", "base": "10"}, {"op": "binarize", "col": "n", "threshold": 1.5},
             {"op": "concat", "of": ["a", "b"], "out": "ab"}, {"op": "rename", "map": {"a": "A"}}, {"op": "exclude", "expr": "A = 'q'"},
             {"op": "filter", "expr": "n >= 0"}, {"op": "dropna", "cols": ["ab"]}, {"op": "drop", "positions": [2]}, {"op": "select", "cols": ["n", "ab"]}]
    assert [tuple(r) for r in P.prepare(df, steps).collect()] == [(0, "y z")]
    with pytest.raises(ValueError):
        P.run_step(df, {"op": "nope"})
