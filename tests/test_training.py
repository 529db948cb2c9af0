import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.operators.encoding import category_table, encode, encode_out_of_fold
from turmalina.plans import training
from turmalina.plans.scenario import future_matrix
from turmalina.plans.scoring import score, with_features
from turmalina.plans.training import (
    BandModel, TrainingOptions, evaluate, evaluate_rounds, fit_features, one_hot_slot, train)
from turmalina.schemas import NUMERIC

SMALL = TrainingOptions(rounds=4, rate=0.4, depth=3)
PANEL = ("ANO int, CURSO string, UNIDADE string, MAT_PAG long, QTD_CONC long, QTD_EMPRESAS long, "
         "SALDO_EMPREGO long, SALARIO_MEDIO double, VLR_MEDIO_BENEFICIO double, FAIXA_MAT string")


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        conc = rng.randint(0, 30)
        band = fv.BAND_LOW if conc < 15 else fv.BAND_MID if conc < 22 else fv.BAND_HIGH
        rows.append((2020 + i % 5, f"C{i % 6}", f"U{i % 3}", 1, conc, rng.randint(1, 50), rng.randint(-9, 9),
                     rng.random() * 1000, rng.random() * 100, band))
    return spark.createDataFrame(rows, PANEL).dropDuplicates(["ANO", "CURSO", "UNIDADE", "QTD_CONC"]).cache()


@pytest.fixture(scope="module")
def model(panel):
    return train(panel, SMALL)


def test_the_panel_is_split_once_and_large_fits_follow_one_another(panel, model, monkeypatch):
    plans, at_once, one_vs_rest = [], [], training.OneVsRest
    monkeypatch.setattr(training, "category_table", lambda df, *rest: plans.append(
        df._jdf.queryExecution().analyzed().toString()) or category_table(df, *rest))
    monkeypatch.setattr(training, "OneVsRest", lambda **given: at_once.append(given["parallelism"]) or one_vs_rest(**given))
    small = train(panel, SMALL)
    monkeypatch.setattr(training, "SIDE_BY_SIDE", 0)
    large = train(panel, SMALL)
    assert at_once == [3, 1] and len(plans) == 4 and not any("Window" in p or "md5" in p for p in plans)
    told = [[tuple(r) for r in score(with_features(panel), m).select("PROBS").orderBy(*panel.columns).collect()] for m in (small, large)]
    assert told[0] == told[1]


def test_encoding(spark, panel):
    df = with_features(panel)
    stages = fit_features(df, TrainingOptions())
    odd = spark.createDataFrame([("U0", "C0"), ("U1", "C5"), ("U2", "C1"), ("new", "new")],
                                "UNIDADE string, CURSO string")
    got = [r[0] for r in PipelineModel(stages).transform(with_features(odd))
           .select(vector_to_array("features")).collect()]
    assert got == [[0] * 6 + u + c for u, c in (
        ([0, 0], [0] * 5), ([1, 0], [0, 0, 0, 0, 1]), ([0, 1], [1, 0, 0, 0, 0]), ([0, 0], [0] * 5))]


def test_slots_come_from_the_index_at_any_number_of_categories(spark):
    """More categories than any fixed slot limit; no row is made as wide as their list."""
    rows = spark.range(100_050).select(
        F.lpad(F.col("id").cast("string"), 7, "0").alias("CURSO"), F.lit("U").alias("UNIDADE"))
    stages = fit_features(rows.withColumns({c: F.lit(0.0) for c in NUMERIC}),
                          TrainingOptions())
    asked = spark.createDataFrame([(0, "0000000"), (1, "0000001"), (100_049, "0100049"), (0, "new")],
                                  "wanted int, CURSO string").withColumn("UNIDADE", F.lit("U"))
    coded = PipelineModel(stages[:1]).transform(asked)
    assert all(r[0] == r[1] for r in coded.select("wanted", one_hot_slot(stages, "CURSO")).collect())


def test_the_driver_holds_no_list_of_categories(spark):
    """The vector's column doesn't name each slot, and nulls and unseen names have none."""
    rows = spark.range(5_000).select(F.concat(F.lit("C"), F.col("id") % 2_500).alias("CURSO"), F.lit("U").alias("UNIDADE"))
    rows = rows.union(spark.createDataFrame([(None, "U")], "CURSO string, UNIDADE string"))
    rows = rows.withColumns({c: F.lit(1.5) for c in NUMERIC})
    stages = fit_features(rows, TrainingOptions())
    coded = PipelineModel(stages).transform(rows)
    assert len(coded.schema.json()) < 5_000 and coded.count() == 5_001
    assert coded.schema["features"].metadata["ml_attr"]["num_attrs"] == len(NUMERIC) + 2_499
    wanted = {name: i for i, name in enumerate(sorted(f"C{i}" for i in range(2_500)))} | {None: 0}
    for name, vector in coded.select("CURSO", "features").distinct().collect():
        slots = [len(NUMERIC) - 1 + wanted[name]] * (wanted[name] > 0)
        assert vector.indices.tolist() == [*range(len(NUMERIC)), *slots]


def test_slot_is_where_the_vector_has_its_one(panel):
    df = with_features(panel)
    stages = fit_features(df, TrainingOptions())
    units = len(stages[0].labelsArray[0]) - 1
    for vector, unit, course in PipelineModel(stages).transform(df).select(
            vector_to_array("features"), one_hot_slot(stages, "UNIDADE"), one_hot_slot(stages, "CURSO")).collect():
        assert [i + 1 for i, x in enumerate(vector[6:6 + units]) if x] == [unit] * (unit > 0)
        assert [i + 1 for i, x in enumerate(vector[6 + units:]) if x] == [course] * (course > 0)


def test_one_category_needs_no_slot(spark, panel):
    df = with_features(panel.filter("UNIDADE = 'U0'"))
    stages = fit_features(df, TrainingOptions())
    row = PipelineModel(stages).transform(df).select(F.size(vector_to_array("features"))).first()
    assert row[0] == 6 + df.select("CURSO").distinct().count() - 1


def test_classes_are_in_lexical_order(model):
    assert model.classes == sorted([fv.BAND_LOW, fv.BAND_MID, fv.BAND_HIGH])


def test_probabilities_sum_to_one_also_for_unseen_names(model, panel):
    odd = panel.limit(5).withColumn("UNIDADE", F.lit("nowhere"))
    for r in score(panel.unionByName(odd), model).select("PROBS").collect():
        assert abs(sum(r.PROBS) - 1) < 1e-9 and len(r.PROBS) == 3


def test_better_than_the_class_shares(model, panel):
    row = evaluate(panel, model, SMALL).first()
    assert row.N_TESTE > 30 and row.LOGLOSS < row.LOGLOSS_PARTES


def test_bands_follow_what_makes_them(model, panel):
    """The bands of the fixture are cut on QTD_CONC; a model that ignores its inputs fails."""
    rows = score(panel, model).select("FAIXA_MAT", "FAIXA_DOMINANTE", "PROB_MAX").collect()
    assert sum(r.FAIXA_MAT == r.FAIXA_DOMINANTE for r in rows) > 0.9 * len(rows)
    assert all(1 / 3 <= r.PROB_MAX <= 1 for r in rows)


def test_loss_by_round(model, panel):
    """The last round's loss is the model's, each round's that of the model cut there."""
    found = {r.RODADA: r for r in evaluate_rounds(panel, model, SMALL).collect()}
    whole = evaluate(panel, model, SMALL).first()
    assert sorted(found) == [1, 2, 3, 4]
    assert abs(found[4].LOGLOSS - whole.LOGLOSS) < 1e-9 and found[4].N_TESTE == whole.N_TESTE
    assert all(abs(r.LOGLOSS_PARTES - whole.LOGLOSS_PARTES) < 1e-9 for r in found.values())
    assert found[4].LOGLOSS < found[1].LOGLOSS
    first = evaluate(panel, train(panel, TrainingOptions(rounds=1, rate=0.4, depth=3)), SMALL).first()
    assert abs(first.LOGLOSS - found[1].LOGLOSS) < 1e-9
    with pytest.raises(ValueError):
        evaluate_rounds(panel, train(panel, TrainingOptions(learner="forest", rounds=2)), SMALL)


def test_shares_of_categories(spark):
    rows = [("a", "x", 0), ("a", "y", 1), ("a", "x", 1), ("b", "y", 0), (None, "x", 0)]
    df = spark.createDataFrame(rows, "c string, l string, _dobra int")
    table = category_table(df, "c", "l", ["x", "y"], smoothing=1.0)
    whole = {r.c: (r.p0, r.p1) for r in encode(df.select("c").distinct(), table, "c", "p", 2, F.array(F.lit(0.0), F.lit(0.0)))
             .collect()}
    assert whole["a"] == pytest.approx(((2 + .6) / 4, (1 + .4) / 4)) and whole["b"] == pytest.approx((.6 / 2, 1.4 / 2))
    assert whole[None] == pytest.approx((1.6 / 2, .4 / 2))
    out = sorted((r.c or "", r._dobra, r.l, round(r.p0, 9)) for r in encode_out_of_fold(df, table, "c", "p", 2, 1.0).collect())
    assert out == [("", 0, "x", .6), ("a", 0, "x", round(1.6 / 3, 9)), ("a", 1, "x", round(1.6 / 2, 9)),
                   ("a", 1, "y", round(1.6 / 2, 9)), ("b", 0, "y", .6)]


def test_rare_categories_tell_no_labels(spark):
    """A course of one row must not give its label away."""
    rng = random.Random(8)
    rows = [(2020, f"C{i}", "U", 1, rng.randint(0, 9), 1, 1, 1.0, 1.0, fv.BAND_LOW if rng.random() < 0.5 else fv.BAND_HIGH)
            for i in range(600)]
    df = spark.createDataFrame(rows, PANEL)
    found = evaluate(df, train(df, TrainingOptions(rounds=8, rate=0.3)), TrainingOptions()).first()
    assert found.LOGLOSS < found.LOGLOSS_PARTES + 0.15


def test_same_seed_same_model(model, panel):
    again = train(panel, SMALL)
    both = score(panel, model).select("*", F.col("PROB_MAX").alias("a")).drop("PROBS", "FAIXA_IDX", "FAIXA_DOMINANTE")
    both = score(both.drop("PROB_MAX"), again)
    assert both.agg(F.max(F.abs(F.col("a") - F.col("PROB_MAX")))).first()[0] < 1e-9


def test_save_and_load(model, panel, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = BandModel.load(str(tmp_path / "m"))
    assert loaded.classes == model.classes and loaded.numeric == model.numeric
    keys = ["ANO", "CURSO", "UNIDADE", "QTD_CONC"]
    before, after = ({tuple(r[:4]): r.PROBS for r in score(panel, m).select(*keys, "PROBS").collect()}
                     for m in (model, loaded))
    assert before == after


def test_forest_option(panel):
    forest = train(panel, TrainingOptions(learner="forest", rounds=5))
    assert abs(sum(score(panel, forest).first().PROBS) - 1) < 1e-9


def test_fitted_model_scores_the_future_grid(model, panel):
    got = future_matrix(panel, model)
    assert got.count() == 3 * 3 * panel.select("CURSO").distinct().count()


def test_one_band_cannot_be_learnt(panel):
    with pytest.raises(ValueError):
        train(panel.withColumn("FAIXA_MAT", F.lit(fv.BAND_LOW)), SMALL)
    with pytest.raises(ValueError):
        train(panel, TrainingOptions(learner="other"))


def test_shares_of_every_row_are_compiled(spark):
    """The out-of-fold shares are plain arithmetic on the counts, without a function over a list, and
    are those of the other folds' rows."""
    rows = [("a", "x", 0), ("a", "x", 1), ("a", "y", 1), ("b", "y", 0), (None, "x", 2), ("c", "y", 4)]
    df = spark.createDataFrame(rows, "C string, L string, _dobra int")
    table = category_table(df, "C", "L", ["x", "y"], 10.0)
    got = encode_out_of_fold(df, table, "C", "p_", 2, 10.0)
    expected = []
    for c, label, fold in rows:
        own = [m for d, m, f in rows if d == c and f != fold]
        expected.append((c, label, fold, *[(own.count(k) + 3 / 6 * 10.0) / (len(own) + 10.0) for k in "xy"]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    table = spark.createDataFrame(table.collect(), table.schema)  # without the plan that counts
    plan = encode_out_of_fold(df, table, "C", "p_", 2)._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan
