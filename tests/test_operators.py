import pytest
from pyspark.sql import functions as F

from pivolith.functions import formula
from pivolith.operators.computed import with_computed
from pivolith.operators.filters import range_filter, search_fields, text_filter
from pivolith.operators.find import find, parse_filter
from pivolith.operators.order import sort_pivot
from pivolith.operators.pivot import KEY, LEVEL, SUBTOTAL, TOTAL, pivot, pivot_long
from pivolith.plans.spec import Metric, PivotSpec, View
from pivolith.sources.catalog import Catalog
from pivolith.sources.views import ViewStore, displayed


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 30, ["x", "y"], (5,), '{"k": 7}'), (2, "Bob", None, [], (6,), None), (3, None, 40, None, (7,), '{"k": "7"}')], "id int, name string, age int, tags array<string>, s struct<v:int>, j string")


FILTERS = [
    ({}, [1, 2, 3]), ({"name": None}, [3]), ({"name": {"$ne": "Ann"}}, [2, 3]), ({"age": {"$gte": 30, "$lt": 40}}, [1]), ({"age": {"$gt": "20"}}, []), ({"id": {"$in": [1, 3]}}, [1, 3]), ({"id": {"$nin": [1]}}, [2, 3]),
    ({"name": {"$regex": "^a", "$options": "i"}}, [1]), ({"tags": "x"}, [1]), ({"tags": {"$all": ["x", "y"]}}, [1]), ({"tags": {"$size": 0}}, [2]), ({"tags": ["x", "y"]}, [1]), ({"tags": {"$elemMatch": {"$regex": "y"}}}, [1]),
    ({"s.v": {"$gt": 5}}, [2, 3]), ({"j.k": 7}, [1, 3]), ({"age": {"$exists": False}}, [2]), ({"age": {"$not": {"$gt": 35}}}, [1, 2]), ({"id": {"$mod": [2, 1]}}, [1, 3]), ({"nothing": None}, [1, 2, 3]), ({"nothing": 1}, []),
    ({"$or": [{"id": 1}, {"name": "Bob"}], "age": 30}, [1]), ({"$or": []}, []), ({"$nor": [{"id": 1}]}, [2, 3]), ({"id": "1"}, []), ({"id": {"$in": [None, 1]}}, [1]),
]


@pytest.mark.parametrize(("want", "ids"), FILTERS)
def test_find(people, want, ids):
    assert sorted(r["id"] for r in find(people, want).collect()) == ids


def test_find_through_arrays(spark):
    rows = [(1, [(9, "a"), (2, "b")]), (2, [(None, "c")]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id int, items array<struct<p:int,q:string>>")
    cases = [({"items.p": 9}, [1]), ({"items.p": {"$gt": 5}}, [1]), ({"items.p": {"$exists": True}}, [1]), ({"items.q": {"$regex": "^[bc]"}}, [1, 2]), ({"items.q": {"$in": ["c", "x"]}}, [2]), ({"items.p": {"$ne": 9}}, [2, 3, 4]), ({"items.none": 1}, [])]
    for want, ids in cases:
        assert sorted(r["id"] for r in find(df, want).collect()) == ids, want


def test_find_pieces(people):
    assert find(people, {"age": {"$lt": 1}}, lenient=True).count() == 1  # a blank is 0
    assert find(people, {}, {"id": 1, "name": 1}, skip=1, limit=1, order_by=["id"]).collect() == [(2, "Bob")]
    assert parse_filter("") == {}
    with pytest.raises(ValueError):
        parse_filter("[1]")
    with pytest.raises(ValueError):
        find(people, {"id": {"$bad": 1}})
    plan = find(people.sparkSession.read.parquet("/root/testdata/sf0.001/orders.parquet"), {"o_orderkey": {"$gt": 5}})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,5)" in plan


def test_text_and_range_filters(people):
    assert [r["id"] for r in text_filter(people, {"name": " B "}).collect()] == [2]
    assert [r["id"] for r in range_filter(people, {"age": (None, 30)}).orderBy("id").collect()] == [1, 2]
    assert search_fields(people, "A", hidden=("tags",)) == ["age", "name"]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("A", "x", "2024-01", 10.0, 2.0), ("A", "x", "2024-02", 20.0, 3.0), ("A", None, "2024-01", None, 1.0), ("b", "y", "2024-02", 5.0, 0.0), ("b", "", "2024-02", 1.0, 4.0), ("b", None, "2024-02", 1.0, 4.0)], "g string, h string, m string, v double, w double")


def test_pivot_shapes(sales):
    spec = PivotSpec(("g", "h"), ("m",), (Metric("v"), Metric("v", "avg"), Metric("v", "min"), Metric("v", "count"), Metric("ratio", "max")), subtotals=True)
    table = pivot(sales, spec, {"ratio": "v / w"})
    rows = table.collect()
    assert [(r["g"], r["h"], r[LEVEL], r[SUBTOTAL]) for r in rows] == [("A", "", 2, False), ("A", "x", 2, False), ("A", "", 1, True), ("b", "", 2, False), ("b", "y", 2, False), ("b", "", 1, True), (TOTAL, "", 0, False)]
    at = {(r["g"], r["h"], r[LEVEL]): r for r in rows}
    a = at["A", "", 1]
    assert (a["2024-01|v sum"], a["2024-01|v avg"], a["2024-01|v min"], a["2024-01|v count"]) == (10, 5, 0, 2)
    assert a["2024-01|ratio max"] == 10 / 3  # a ratio of sums
    assert at["A", "x", 2]["2024-01|v sum"] == 10 and at["b", "y", 2]["2024-01|v count"] == 0
    assert at[TOTAL, "", 0]["2024-02|v sum"] == 27 and at["b", "", 2]["2024-02|v count"] == 2


def test_levels_add_up(sales):
    long = pivot_long(sales, PivotSpec(("g", "h", "m"), (), (Metric("v"), Metric("v", "count")), subtotals=True))
    sums = {r[LEVEL]: (r["s"], r["c"]) for r in long.groupBy(LEVEL).agg(F.sum("v sum").alias("s"), F.sum("v count").alias("c")).collect()}
    assert sums == {k: (37.0, 6.0) for k in range(4)}


def test_pivot_without_rows(sales):
    assert pivot(sales.where("false"), PivotSpec(("g",), ("m",), (Metric("v"),))).collect() == []
    assert pivot(sales, PivotSpec(("g",))).where(F.col(LEVEL) == 0).first()["g count"] == 6
    assert pivot_long(sales, PivotSpec((), ("m", "h"), (Metric("v"),))).where(F.col(KEY) == "2024-02\x01").first()["v sum"] == 2


def test_hierarchy_sort(sales):
    table = pivot(sales, PivotSpec(("g", "h"), (), (Metric("v"),), subtotals=True))
    rows = [(r["g"], r["h"], r[LEVEL]) for r in sort_pivot(table, ("g", "h"), "v sum").collect()]
    assert rows == [("b", "", 2), ("b", "y", 2), ("b", "", 1), ("A", "", 2), ("A", "x", 2), ("A", "", 1), (TOTAL, "", 0)]
    flat = pivot(sales, PivotSpec(("h",), (), (Metric("v"),)))
    assert [r["h"] for r in sort_pivot(flat, ("h",), "v sum", descending=True).collect()] == ["x", "y", "", TOTAL]
    assert displayed(flat).collect()[-1][1] == "37.00"


def test_catalog_and_views(spark, tmp_path):
    cat = Catalog(spark, {"region": "/root/testdata/sf0.001/region.parquet"})
    assert cat.names() == ["region"] and cat.peek("region", 2).count() == 2 and cat.fields("region") == {"r_regionkey": "int", "r_name": "string"}
    with pytest.raises(ValueError):
        cat.get("secret")
    store = ViewStore(str(tmp_path / "views.json"))
    assert store.save(View("c", "n", PivotSpec(("a",), (), (Metric("b", "avg"),)), {"x": "b*2"})) and not store.save(View("", "n"))
    store.save(View("c", "m"))
    assert [v["name"] for v in store.list()] == ["m", "n"] and store.get("c", "n").spec.vals == (Metric("b", "avg"),)
    assert store.delete("c", "n") and store.get("c", "n") is None


def test_registered_queries_match_sql(spark):
    import duckdb

    from pivolith.plans import queries

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events embeddings".split():
        c.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, "/root/testdata/sf0.001")
        names = sorted(got.columns)
        want = c.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == names, name
        rows = sorted(str([r[columns.index(n)] for n in names]) for r in want.fetchall())
        assert sorted(str([r[n] for n in names]) for r in got.collect()) == rows, name


def test_flattened_numbers_match_sql(spark, tmp_path):
    import duckdb

    from pivolith.plans import queries

    nan, inf = float("nan"), float("inf")
    cases = [  # exact halves, texts that end in a half that the float isn't, wide, not finite, short and missing
        ([0.03125, 0.09375, -0.03125, 1.0], "0.0312 0.0938 -0.0312"), ([0.05365, 0.25605, -0.10855], "0.0536 0.2560 -0.1085"), ([0.00005, -0.00001, 1234567.5], "0.0000 -0.0000 1234567.5000"),
        ([2.0**55, -1e19, 3.4028234663852886e38], "36028797018963968.0000 -9999999980506447872.0000 340282346638528859811704183484516925440.0000"),
        ([nan, inf, -inf, 1.5], "nan inf -inf"), ([nan, 2.5, None, 7.0], "nan 2.5000"), ([None, 2.0, 3.0, 4.0], "2.0000 3.0000"), ([1.0], "1.0000"), ([None], None), ([], None), (None, None),
    ]
    spark.createDataFrame([(i, x, 0) for i, (x, _) in enumerate(cases)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["vec_id"], r["start"], r["parts"]) for r in queries.queries()["flatten_numbers"](spark, str(tmp_path)).collect())
    assert got == [(i, said, None if x is None else len(x)) for i, (x, said) in enumerate(cases)]
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(c.execute(queries.oracle_sql()["flatten_numbers"]).fetchall())


def test_aliases(spark):
    df = spark.createDataFrame([("a", 6.0, 2.0), ("b", 9.0, 3.0)], "k string, cost double, sales double")
    spec, spelt = PivotSpec(("k",), (), (Metric("ratio"),)), {"spend": "cost", "sales": "cost", "none": "gone"}
    rows = pivot(df, spec, {"ratio": "spend / sales"}, aliases=spelt).collect()
    assert {r["k"]: r["ratio sum"] for r in rows} == {"a": 3.0, "b": 3.0, "汇总": 3.0}
    assert [r["x"] for r in with_computed(df, {"x": "spend + 1"}, aliases=spelt).orderBy("k").collect()] == [7.0, 10.0]
    with pytest.raises(formula.FormulaError):
        with_computed(df, {"x": "none + 1"}, aliases=spelt)
