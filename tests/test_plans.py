"""What the plans of the operators look like, and the operators that replace sorts and copies."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from test_scoring import panel as small_panel

from turmalina import app
from turmalina.fixtures.scorer import fixed_scorer
from turmalina.fixtures.tables import Feeds
from turmalina.functions import fixed_values as fv
from turmalina.functions import text
from turmalina.operators import latest
from turmalina.operators.median import exact_median
from turmalina.operators.rules import canonical_names, required_texts, rule_pieces
from turmalina.plans.panel import spread_nulls
from turmalina.plans.scenario import LAST, future_base
from turmalina.plans.scoring import score, sensitivity, with_features, with_impacts
from turmalina.schemas import EDITABLE
from turmalina.sources import tables as io

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def big(spark):
    """The small panel as Spark would see a large one: no broadcasts."""
    return small_panel(spark).repartition(3)


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_last_rows_of_pairs_are_not_sorted(spark, no_broadcast):
    df = big(spark)
    for found in (latest.latest_per(df, ["UNIDADE", "CURSO"], LAST),
                  latest.latest_numbers_per(df, ["UNIDADE", "CURSO"], ["QTD_CONC", "SALARIO_MEDIO"])):
        plan = plan_of(found)
        assert "Sort" not in plan and "HashAggregate" in plan
    assert latest.latest_per(df, ["UNIDADE", "CURSO"], LAST).count() == 4
    # By unit the rows of the last year alone are compared by their course's name.
    rows = latest.latest_per(df, ["UNIDADE"], LAST).collect()
    assert sorted((r.UNIDADE, r.ANO, r.CURSO) for r in rows) == [("U1", 2024, "CC"), ("U2", 2023, "AA")]


def test_grid_moves_keys_only(spark, no_broadcast):
    """What goes through the slots has the two keys and the slot, whatever the measures are."""
    plan = future_base(big(spark))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "_slot" in line]
    assert joins
    assert "Project [UNIDADE" in plan and all("QTD" not in line for line in joins)


def test_impacts_need_no_exchange(spark):
    rows = score(with_features(small_panel(spark)), fixed_scorer())
    for df in (with_impacts(rows, fixed_scorer()), sensitivity(small_panel(spark), fixed_scorer(), ["UNIDADE", "CURSO"])):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Join" not in plan
    row = with_impacts(rows, fixed_scorer()).first()
    assert [x.VARIAVEL for x in row.IMPACTOS] == ["ANO", *[v for v in (
        "QTD_EMPRESAS", "QTD_CONC", "SALARIO_MEDIO", "SALDO_EMPREGO", "VLR_MEDIO_BENEFICIO")]]
    assert row.QTD_CONC == rows.first().QTD_CONC and row.PROBS == rows.first().PROBS


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_exact_median(spark, width):
    draw = random.Random(width)
    rows = [("hot" if draw.random() < 0.5 else f"k{draw.randrange(9)}", draw.choice([None, draw.randrange(-50, 5000)]))
            for _ in range(3000)] + [(None, 3), (None, 4), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: r.m for r in exact_median(df, ["k"], "v", "m", width).collect()}
    by_key = {}
    for k, v in rows:
        if v is not None:
            by_key.setdefault(k, []).append(v)
    assert got == {k: float(statistics.median(v)) for k, v in by_key.items()}


def test_null_keys_do_not_meet(spark, no_broadcast):
    rows = spark.range(5000).withColumn("key", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")))
    right = spark.range(0, 5000, 20).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("x"))
    spread = rows.withColumn("key", spread_nulls(F.col("key"), ["id"]))
    assert spread.join(right, "key", "left").filter("x = 1").count() == 250
    sizes = [r["count"] for r in spread.repartition(16, "key").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 5000 / 16 and len(sizes) == 16


# --- rules ---

def test_required_texts():
    assert required_texts("SENAC CA") == ["SENAC CA"]
    assert required_texts("POLO (ALTO DA CRUZ) X") == ["POLO ", " X"]
    assert required_texts("ab?cd*e+f.g") == ["a", "c", "e", "f", "g"]
    assert required_texts("A{2}B[CD]E\\d") == ["B", "E"]
    assert required_texts("x|y") == []


def test_every_rule_is_met_by_what_it_matches(spark):
    rules = [*fv.SCRAPED_INSTITUTIONS, ("(4|5)$", "Z"), ("^X", "$1\\"), ("CEEP", "SEGUNDO")]
    pieces = rule_pieces(rules)
    assert sum(p is None for p in pieces) <= 3
    texts = [p for p, _ in rules] + [f"X {p} 5" for p, _ in rules] + [p[:-2] for p, _ in rules] + ["", "SEM REGRA"]
    texts += [f"{a} {b}" for (a, _), (b, _) in zip(rules, rules[5:])]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("SENAC CA",)], "n string")
    got = canonical_names(df, "n", rules, "o").select("n", "o").collect()
    plain = df.select("n", text.ordered_rules(F.col("n"), rules).alias("o")).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, plain), key=key)


# --- files and jobs ---

def test_drifting_folder(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1).write.parquet(f"{folder}/one")
    spark.createDataFrame([("2", 5.0), ("no", 6.0)], "a string, c double").coalesce(1).write.parquet(f"{folder}/two")
    from pyspark.sql import types as T
    wanted = T.StructType.fromDDL("a long, b string, c double")
    rows = io.read_drifting(spark, folder, "*/*.parquet", wanted).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "x", None), (2, None, 5.0), (None, None, 6.0)]
    assert io.read_drifting(spark, folder, "*/*.none", wanted).count() == 0


def test_refresh_replaces_its_year_only(spark, tmp_path):
    path = str(tmp_path / "p")
    io.write_panel(spark.createDataFrame([(2020, 1), (2021, 2)], "ANO int, v int"), path)
    io.write_panel(spark.createDataFrame([(2021, 3), (2022, 4)], "ANO int, v int"), path, years=[2021])
    assert sorted((r.ANO, r.v) for r in io.read_panel(spark, path).collect()) == [(2020, 1), (2021, 3)]


def test_jobs_with_ready_feeds_and_a_selection(spark, tmp_path):
    feeds, folder, ready = Feeds(spark, SF), str(tmp_path / "feeds"), str(tmp_path / "ready")
    for name in app.FEED_SCHEMAS:
        if name not in ("establishments_raw", "itinerary"):
            getattr(feeds, name)().write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(1996, "ASIA", 7)], "ANO int, UNIDADE string, `QTD_EMPRESAS ` long").write.parquet(f"{ready}/establishments")
    paths = [str(tmp_path / n) for n in ("panel", "model", "out")]
    app.main(["panel", folder, paths[0], "--ready", ready, "--dedupe"])
    panel = io.read_panel(spark, paths[0])
    assert {(r.ANO, r.UNIDADE, r.QTD_EMPRESAS) for r in panel.filter("QTD_EMPRESAS > 0").collect()} == {(1996, "ASIA", 7)}
    with pytest.raises(ValueError):
        app.read_ready(spark, folder)

    app.main(["panel", folder, paths[0], "--ready", ready])
    panel = io.read_panel(spark, paths[0])
    app.main(["train", paths[0], paths[1], "--rounds", "2"])
    app.main(["analyse", *paths, "--unit", "ASIA", "--edit", "QTD_CONC=3", "--edit", "SALARIO_MEDIO=1000.5"])
    read = lambda name: spark.read.parquet(f"{paths[2]}/selection/{name}")
    row = read("whatif").first()
    assert (row.QTD_CONC, row.SALARIO_MEDIO) == (3.0, 1000.5)
    assert read("real").count() == 1 and read("context").count() == panel.filter("UNIDADE = 'ASIA'").count()
    assert read("recommendations").count() == panel.select("CURSO").distinct().count()


def test_edits_of_texts():
    assert app.edits_of(["QTD_CONC=3", "SALDO_EMPREGO=-1.5"]) == {"QTD_CONC": 3.0, "SALDO_EMPREGO": -1.5}
    assert app.edits_of(None) == {} and set(EDITABLE) >= {"QTD_CONC"}
    with pytest.raises(ValueError):
        app.edits_of(["MAT_PAG=3"])
