from collections import Counter, defaultdict

from pyspark.sql import functions as F

from turmalina.operators import latest
from turmalina.operators.pairs import pair_grid
from turmalina.operators.split import class_weights, stratified_split, with_class_weight


def test_latest_uses_the_total_order(spark):
    df = spark.createDataFrame([(1, "b", 1), (2, "a", 2), (2, "b", None), (2, "b", 4)], "y int, c string, v int")
    assert tuple(latest.latest_per(df, ["c"], ["y", "v"]).filter("c = 'b'").first()) == (2, "b", 4)
    by_value = latest.latest_values_per(df.filter("v IS NULL OR v < 4"), ["c"], ["y"])
    assert tuple(by_value.filter("c = 'b'").first()) == (2, "b", 1)


def test_latest_year_rows(spark):
    df = spark.createDataFrame([(1, "a"), (3, "a"), (3, "a"), (2, "b")], "ANO int, u string")
    got = Counter(tuple(r) for r in latest.rows_at_latest_year(df, ["u"]).select("ANO", "u").collect())
    assert got == {(3, "a"): 2, (2, "b"): 1}


def test_first_value_skips_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 6, 3)], "k string, v int, r int")
    assert tuple(latest.first_value_per(df, ["k"], "v", "r").first()) == ("a", 5)


def test_grid_holds_each_pair_once(spark):
    left = spark.range(7).withColumnRenamed("id", "l")
    right = spark.range(300).withColumnRenamed("id", "r")
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        grid = pair_grid(left, right, "r")
        assert grid.count() == 2100 and grid.distinct().count() == 2100
        plan = grid._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_is_exact_per_class_and_stable(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(1000)] + [(5000, "c")]
    df = spark.createDataFrame(rows, "k int, lab string")
    split = stratified_split(df, "lab", ["k"])
    got = defaultdict(Counter)
    for r in split.collect():
        got[r.lab][r.E_TESTE] += 1
    assert got["a"][True] == round(0.2 * 666) and got["b"][True] == round(0.2 * 334) and got["c"][True] == 0
    chosen = {r.k for r in split.filter("E_TESTE").collect()}
    again = stratified_split(df.repartition(7).orderBy(F.desc("k")), "lab", ["k"])
    assert chosen == {r.k for r in again.filter("E_TESTE").collect()}
    assert chosen != {r.k for r in stratified_split(df, "lab", ["k"], seed=9).filter("E_TESTE").collect()}


def test_split_moves_only_the_ranges_where_the_share_ends(spark):
    """Null labels are a class, equal keys count one by one, and no join meets the rows."""
    rows = [(i // 2 if i % 5 else None, "a" if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, lab string")
    split = stratified_split(df, "lab", ["k"])
    assert "Join" not in split._jdf.queryExecution().optimizedPlan().toString()
    assert split.columns == ["k", "lab", "E_TESTE"]
    got = Counter((r.lab, r.E_TESTE) for r in split.collect())
    assert got == {("a", True): 40, ("a", False): 160, (None, True): 20, (None, False): 80}
    assert Counter((r.k, r.lab) for r in split.collect()) == Counter(rows)
    for share, wanted in ((0.0, {False: 300}), (1.0, {True: 300})):
        assert Counter(r.E_TESTE for r in stratified_split(df, "lab", ["k"], share).collect()) == wanted
    assert stratified_split(df.limit(0), "lab", ["k"]).count() == 0



def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "lab string")
    assert {r.lab: r.PESO for r in class_weights(df, "lab").collect()} == {"a": 8 / 12, "b": 8 / 4}
    weighted = with_class_weight(df, "lab")
    assert weighted.agg(F.round(F.sum("PESO"), 6)).first()[0] == 8.0
    assert "Join" not in weighted._jdf.queryExecution().executedPlan().toString()


def test_choices_are_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    assert [r.c for r in latest.choices(df, "c").collect()] == ["a", "b"]
