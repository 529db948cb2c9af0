import math

import pytest
from pyspark.sql import functions as F

from turmalina.fixtures.scorer import CLASSES, SCALES, WEIGHTS, fixed_scorer
from turmalina.functions import fixed_values as fv
from turmalina.plans import decision, scenario, whatif
from turmalina.plans.scoring import (
    by_size, cell_label, score, sensitivity, shocked, shocked_rows, with_features, with_impacts)

PANEL = ("ANO int, CURSO string, UNIDADE string, MAT_PAG long, QTD_CONC long, QTD_EMPRESAS long, "
         "SALDO_EMPREGO long, SALARIO_MEDIO double, VLR_MEDIO_BENEFICIO double, FAIXA_MAT string")


def panel(spark):
    # UNIDADE U2 never offered course CC; the two years tie at the top for U1.
    return spark.createDataFrame([
        (2023, "AA", "U1", 5, 1, 10, 5, 1000.0, 50.0, fv.BAND_LOW),
        (2024, "AA", "U1", 30, 3, 12, 0, 1100.0, 60.0, fv.BAND_MID),
        (2024, "CC", "U1", 50, 8, 12, -4, 2100.0, 60.0, fv.BAND_HIGH),
        (2022, "CC", "U1", 50, 5, 12, -4, 2000.0, 60.0, fv.BAND_HIGH),
        (2023, "AA", "U2", 9, 2, 20, 7, 900.0, 70.0, fv.BAND_LOW),
        (2021, "BBB", "U2", 9, 4, 20, 9, 950.0, 70.0, fv.BAND_LOW)], PANEL)


def plain_probs(row):
    z = {v: row[v] / (abs(row[v]) + s) for v, s in SCALES.items()}
    e = [math.exp(b + len(row["UNIDADE"]) % 5 * u + len(row["CURSO"]) % 7 * c
                  + sum(w * z[v] for v, w in lin.items())) for b, lin, u, c in WEIGHTS]
    return [x / sum(e) for x in e]


def plain_cell(row):
    p = plain_probs(row)
    i = p.index(max(p))
    band = CLASSES[i]
    mark = {fv.BAND_HIGH: "✅" if p[i] >= 0.7 else "🟢", fv.BAND_MID: "🟡", fv.BAND_LOW: "🔴"}[band]
    return f"{mark} {band} ({round(p[i] * 100, 1)}%)"


def test_equal_maxima_take_the_first(spark):
    class Flat:
        classes = ["x", "y", "z"]
        def score(self, df):
            return df.withColumn("PROBS", F.array(F.lit(0.3), F.lit(0.5), F.lit(0.5)))
    row = score(spark.range(1), Flat()).first()
    assert (row.FAIXA_IDX, row.FAIXA_DOMINANTE, row.PROB_MAX) == (1, "y", 0.5)


def test_nan_probability_counts_as_zero(spark):
    class Odd:
        classes = ["x", "y"]
        def score(self, df):
            return df.withColumn("PROBS", F.array(F.lit(float("nan")), F.lit(0.5)))
    assert score(spark.range(1), Odd()).first().PROBS == [0.0, 0.5]


def test_shock(spark):
    df = spark.createDataFrame([(10.0,), (0.0,), (-4.0,)], "v double")
    assert [round(r[0], 9) for r in df.select(shocked(F.col("v"))).collect()] == [11.0, 1.0, 1.0]
    kept = df.filter("v > 0").select(shocked(F.col("v"), delta=0.0))
    assert kept.first()[0] == 10.0


def test_features_fill_absent_columns(spark):
    df = with_features(spark.createDataFrame([(None,)], "QTD_CONC long"), ["QTD_CONC", "ANO"])
    assert tuple(df.first()) == (0.0, 0.0)


def test_impacts_follow_single_row_scoring(spark):
    rows = score(with_features(panel(spark)), fixed_scorer())
    got = {(r.ANO, r.CURSO, r.UNIDADE, r.VARIAVEL): r.IMPACTO
           for r in shocked_rows(rows, fixed_scorer()).collect()}
    for r in panel(spark).collect():
        base = r.asDict()
        p = plain_probs(base)
        i = p.index(max(p))
        for v in SCALES:
            value = base[v] * 1.1 if base[v] > 0 else 1.0
            expected = plain_probs({**base, v: value})[i] - p[i]
            assert got[(float(r.ANO), r.CURSO, r.UNIDADE, v)] == pytest.approx(expected, abs=1e-12)


def test_no_shock_no_impact_and_given_band(spark):
    rows = score(with_features(panel(spark).filter("SALDO_EMPREGO > 0")), fixed_scorer())
    none = shocked_rows(rows, fixed_scorer(), delta=0.0)
    assert none.agg(F.max(F.abs("IMPACTO"))).first()[0] < 1e-15
    total = None
    for i in range(3):
        part = shocked_rows(rows, fixed_scorer(), band_index=i).agg(F.sum("IMPACTO")).first()[0]
        total = part if total is None else total + part
    assert abs(total) < 1e-12


def test_only_present_variables_are_shocked(spark):
    df = panel(spark).drop("VLR_MEDIO_BENEFICIO")
    names = {r.VARIAVEL for r in sensitivity(df, fixed_scorer(), ["UNIDADE", "CURSO", "ANO"]).collect()}
    assert names == set(SCALES) - {"VLR_MEDIO_BENEFICIO"}


def test_future_matrix_with_imputation(spark):
    df = panel(spark)
    got = {(r.CENARIO, r.UNIDADE, r.CURSO): r for r in scenario.future_matrix(df, fixed_scorer()).collect()}
    assert len(got) == 3 * 2 * 3
    last = {("U1", "AA"): (2024, "AA"), ("U1", "CC"): (2024, "CC"), ("U2", "AA"): (2023, "AA"),
            ("U2", "BBB"): (2021, "BBB")}
    unit_last = {"U1": (2024, "CC"), "U2": (2023, "AA")}
    median = {"AA": 2.0, "BBB": 4.0, "CC": 6.5}
    source = {(r.ANO, r.CURSO, r.UNIDADE): r.asDict() for r in df.collect()}
    for (name, unit, course), r in got.items():
        known = (unit, course) in last
        year, from_course = last[(unit, course)] if known else unit_last[unit]
        row = dict(source[(year, from_course, unit)], CURSO=course, ANO=2026)
        if not known:
            row["QTD_CONC"] = median[course]
        for m, f in zip(fv.SCENARIO_MEASURES, fv.SCENARIOS[name]):
            row[m] *= f
        assert (r.HISTORICO_NA_UNIDADE, r.ANO_SIM, r.col_recom) == (known, 2026, plain_cell(row))


def test_base_scenario_of_the_last_year_scores_like_the_last_row(spark):
    df = panel(spark).filter("CURSO = 'AA' AND UNIDADE = 'U1'")
    future = scenario.future_matrix(df, fixed_scorer(), year=2024, scenarios=("base",)).first()
    real = score(with_features(whatif.real_rows(df)), fixed_scorer()).first()
    assert future.PROB_MAX == pytest.approx(real.PROB_MAX, abs=1e-15)


def test_row_order_changes_nothing(spark):
    df = panel(spark)
    mixed = spark.createDataFrame(list(reversed(df.collect())), df.schema).repartition(3)
    for make in (lambda d: scenario.future_matrix(d, fixed_scorer()),
                 lambda d: scenario.probability_history(d, fixed_scorer(), per_course=False),
                 lambda d: whatif.real_rows(d, per_course=False),
                 lambda d: decision.recommendation_table(d, fixed_scorer(), ["U1", "U2"])):
        assert sorted(map(tuple, make(df).collect()), key=str) == sorted(map(tuple, make(mixed).collect()), key=str)


def test_units_filter_and_unknown_scenario(spark):
    got = scenario.future_matrix(panel(spark), fixed_scorer(), scenarios=("base", "outro"), units=["U2"])
    rows = {(r.CENARIO, r.CURSO): r.PROB_MAX for r in got.collect()}
    assert len(rows) == 6 and all(rows[("base", c)] == rows[("outro", c)] for c in ("AA", "BBB", "CC"))


def test_history(spark):
    got = scenario.probability_history(panel(spark), fixed_scorer(), unit="U1", course="AA").collect()
    assert sorted(r.ANO for r in got) == [2021, 2022, 2023, 2024]
    base = {"UNIDADE": "U1", "CURSO": "AA", "QTD_CONC": 3, "QTD_EMPRESAS": 12, "SALARIO_MEDIO": 1100.0,
            "SALDO_EMPREGO": 0, "VLR_MEDIO_BENEFICIO": 0.0}
    for r in got:
        assert [r[c] for c in CLASSES] == pytest.approx(plain_probs({**base, "ANO": r.ANO}), abs=1e-12)
    overall = scenario.probability_history(panel(spark), fixed_scorer(), unit="U1", per_course=False)
    assert {r.CURSO for r in overall.collect()} == {"CC"}
    assert scenario.probability_history(panel(spark), fixed_scorer(), unit="none").collect() == []


def test_whatif_edits(spark):
    df = panel(spark)
    got = whatif.whatif(df, fixed_scorer(), {"QTD_CONC": 9}, unit="U2", per_course=False).collect()
    assert len(got) == 1 and (got[0].CURSO, got[0].QTD_CONC, got[0].CURSO_SEL) == ("AA", 9.0, "GLOBAL")
    with pytest.raises(ValueError):
        whatif.whatif(df, fixed_scorer(), {"MAT_PAG": 1})
    edits = spark.createDataFrame([("U1", "AA", "k", "QTD_CONC", 9.0), ("U1", "AA", "k", "SALARIO_MEDIO", 1.0),
                                   ("U1", "AA", "l", "QTD_CONC", 0.0)],
                                  "UNIDADE string, CURSO_SEL string, CASO string, VARIAVEL string, VALOR double")
    rows = {r.CASO: r for r in whatif.whatif(df, fixed_scorer(), edit_table=edits).collect()}
    assert (rows["k"].QTD_CONC, rows["k"].SALARIO_MEDIO, rows["l"].SALARIO_MEDIO) == (9.0, 1.0, 1100.0)


@pytest.mark.parametrize("mode", ["live", "function"])
def test_whatif_across_courses(spark, mode):
    df = panel(spark)
    edited = whatif.apply_edits(whatif.real_rows(df, unit="U1", course="AA"), {"QTD_EMPRESAS": 99, "SALDO_EMPREGO": 2})
    got = {r.CURSO: r.RECOM_SIMULADO for r in whatif.whatif_courses(df, edited, fixed_scorer(), mode=mode).collect()}
    mine = {"UNIDADE": "U1", "ANO": 2026, "QTD_EMPRESAS": 99.0, "VLR_MEDIO_BENEFICIO": 60.0, "QTD_CONC": 3.0}
    means = {"BBB": (9.0, 950.0), "CC": (-4.0, 2050.0)}
    expected = {"AA": plain_cell({**mine, "CURSO": "AA", "SALDO_EMPREGO": 2.0, "SALARIO_MEDIO": 1100.0})}
    for course, (balance, wage) in means.items():
        balance = 2.0 if mode == "function" else balance
        expected[course] = plain_cell({**mine, "CURSO": course, "SALDO_EMPREGO": balance, "SALARIO_MEDIO": wage})
    assert got == expected


def test_cells_and_advice(spark):
    df = spark.createDataFrame([(fv.BAND_HIGH, 0.7), (fv.BAND_HIGH, 0.699), (fv.BAND_HIGH, 0.49), (fv.BAND_MID, 0.5),
                                (fv.BAND_LOW, 0.6), (fv.BAND_LOW, 0.59), ("?", 1.0)], "b string, p double")
    cells = [r[0] for r in df.select(cell_label(F.col("b"), F.col("p"))).collect()]
    assert cells == ["✅ Acima de 40 (70.0%)", "🟢 Acima de 40 (69.9%)", "🟢 Acima de 40 (49.0%)",
                     "🟡 Entre 21 e 40 (50.0%)", "🔴 Abaixo de 21 (60.0%)", "🔴 Abaixo de 21 (59.0%)",
                     "⚠️ ? (100.0%)"]
    told = [r[0] for r in df.select(decision.advice(F.col("b"), F.col("p"))).collect()]
    assert told == ["✅ Recomendar fortemente a oferta", "🟢 Recomendar a oferta", "⚠️ Analisar manualmente",
                    "🟡 Oferta com cautela", "🔴 Não priorizar oferta", "⚠️ Analisar manualmente",
                    "⚠️ Analisar manualmente"]


def impacts(spark, band, p, *pairs):
    schema = "FAIXA_DOMINANTE string, PROB_MAX double, IMPACTOS array<struct<VARIAVEL:string,IMPACTO:double>>"
    return spark.createDataFrame([(band, p, list(pairs))], schema)


def test_executive_real(spark):
    def told(*case, **options):
        r = decision.executive_real(impacts(spark, *case), **options).first()
        return r.TEXTO, r.NIVEL
    risks = [("QTD_CONC", -0.02), ("ANO", -0.5), ("SALDO_EMPREGO", 0.9), ("SALARIO_MEDIO", -0.03), ("x", -0.01)]
    text, level = told(fv.BAND_HIGH, 0.69, *risks)
    assert "**ANO, SALÁRIO MÉDIO (CAGED)**" in text and "**69.0%**" in text and level == "success"
    assert told(fv.BAND_HIGH, 0.7, ("ANO", 0.5)) == (fv.TEXT_HIGH % 70.0, "success")
    assert told(fv.BAND_HIGH, 0.68, *risks) == (fv.TEXT_BALANCED, "info")
    assert told(fv.BAND_MID, 0.4, *risks) == (fv.TEXT_MID % 40.0, "info")
    assert told(fv.BAND_LOW, 0.9, *risks) == (fv.TEXT_BALANCED, "info")
    assert told(fv.BAND_LOW, 0.9, *risks, fix_labels=True) == (fv.TEXT_LOW % 90.0, "warning")


def test_executive_whatif(spark):
    still = decision.executive_whatif(impacts(spark, fv.BAND_MID, 0.4, ("ANO", 0.01), ("y", -0.01))).first()
    assert (still.TEXTO, still.NIVEL) == (fv.TEXT_WHATIF_STABLE, "info")
    moved = decision.executive_whatif(impacts(
        spark, fv.BAND_MID, 0.4, ("ANO", 0.02), ("QTD_EMPRESAS", -0.3), ("y", 0.001))).first()
    assert moved.TEXTO == fv.TEXT_WHATIF_SHIFT % (fv.BAND_MID, "EMPRESAS (RAIS), ANO")


def test_top_drivers(spark):
    df = impacts(spark, "b", 0.5, *[(c, (-1) ** i * i / 100) for i, c in enumerate("abcdefg")])
    got = [(r.POSICAO, r.VARIAVEL, r.PONTOS) for r in decision.top_drivers(df, ["FAIXA_DOMINANTE"]).collect()]
    assert got == [(1, "g", "+6.0"), (2, "f", "-5.0"), (3, "e", "+4.0"), (4, "d", "-3.0"), (5, "c", "+2.0")]


def test_impact_order_breaks_ties_by_name(spark):
    df = impacts(spark, "b", 0.5, ("b", 0.1), ("a", -0.1), ("c", 0.2))
    assert [x.VARIAVEL for x in df.select(by_size(F.col("IMPACTOS"))).first()[0]] == ["c", "a", "b"]


def test_impact_list_per_row(spark):
    rows = score(with_features(panel(spark)), fixed_scorer())
    listed = with_impacts(rows, fixed_scorer())
    assert listed.count() == 6 and listed.agg(F.min(F.size("IMPACTOS"))).first()[0] == 6


def test_context_table(spark):
    got = decision.context_table(panel(spark), unit="U1", course="GLOBAL")
    assert "MATR.(SENAI)" in got.columns and [r.ANO for r in got.collect()] == [2022, 2023, 2024, 2024]
    assert decision.context_table(panel(spark), unit="U1", course="AA", year=2024).count() == 1


def test_recommendation_table(spark):
    df = panel(spark)
    simulated = spark.createDataFrame([("AA", "sim")], "CURSO string, RECOM_SIMULADO string")
    got = decision.recommendation_table(df, fixed_scorer(), ["U1", "U2"], simulated,
                                        ("Simulado", "Otimista", "Nada"))
    assert got.columns == ["Curso Técnico", "Simulado", "Otimista"]
    rows = [tuple(r) for r in got.collect()]
    assert [r[0] for r in rows] == ["AA", "BBB", "CC"] and [r[1] for r in rows] == ["sim", None, None]
    matrix = {(r.UNIDADE, r.CURSO): r.col_recom for r in scenario.future_matrix(
        df, fixed_scorer(), scenarios=("otimista",)).collect()}
    # U2 appears first in the panel (its 2021 row), so its cells are taken.
    assert [r[2] for r in rows] == [matrix[("U2", c)] for c in ("AA", "BBB", "CC")]
    assert "Simulado" not in decision.recommendation_table(df, fixed_scorer(), ["U1"]).columns
