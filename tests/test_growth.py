"""Steps whose work must not grow faster than the rows: what their plans hold, and odd rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from turmalina.fixtures.queries import institutions_scraped_column
from turmalina.fixtures.scorer import fixed_scorer
from turmalina.plans import competitors, decision, enrolment, whatif
from turmalina.plans.scoring import score, sensitivity, with_features, with_impacts
from turmalina.schemas import PANEL_COLUMNS

PANEL = "ANO int, CURSO string, UNIDADE string, " + ", ".join(
    f"{c} {'string' if c == 'FAIXA_MAT' else 'double' if c in ('SALARIO_MEDIO', 'TOTAL_REPASSE', 'VLR_MEDIO_BENEFICIO') else 'long'}"
    for c in PANEL_COLUMNS[3:])


def _panel(spark):
    rows = [(y, f"C{c}", u, y % 7, c, 1, 2, 3, 4, 5, c - 3, 10.5 * c, 7, 8.0, 9.0, "x")
            for y, c, u in itertools.product((2000, 2001, 2002), range(4), ("A", "B"))]
    return spark.createDataFrame(rows, PANEL)


def _optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_impacts_are_not_computed_to_look_for_empty_lists(spark):
    rows = whatif.real_rows(_panel(spark))
    long = sensitivity(rows, fixed_scorer(), ["UNIDADE", "CURSO"])
    assert "size(" not in _optimised(long) and long.count() == 8 * 6
    impacts = with_impacts(score(with_features(rows), fixed_scorer()), fixed_scorer())
    top = decision.top_drivers(impacts, ["UNIDADE", "CURSO"])
    assert "size(" not in _optimised(top).replace("size(risks", "") and top.count() == 8 * 5
    empty = impacts.withColumn("IMPACTOS", F.slice("IMPACTOS", 1, 0))
    assert decision.top_drivers(empty, ["UNIDADE", "CURSO"]).count() == 0


def test_rules_of_many_keys_are_dealt_out(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    done = institutions_scraped_column(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in done._jdf.queryExecution().executedPlan().toString() and done.count() == 50


@pytest.fixture
def municipality(spark):
    return spark.createDataFrame([("ÁGUA", "U", "AGUA"), ("AGUA", "V", "AGUA"), ("SOL", "U", "SOL")],
                                 "MUNICIPIO string, UNIDADE string, MUNICIPIO_COD string")


def test_texts_of_cities_are_conformed_once(spark, municipality):
    rows = [("SENAI U", "Técnico em X", "\tágua", "2001/1", "a"), ("SENAI U", "Técnico em X", "sol", "2001/1", "a"),
            ("U", "X", None, "2001/2", "a"), ("Total geral", "X", "sol", "2001/1", "a"), ("U", "X total", "sol", "2001/1", "a"),
            ("U", "X", "total", "2001/1", "a"), ("U", "X", "sol", "2001/1", "total"), (None, "X", "sol", "2001/1", "a")]
    cube = spark.createDataFrame(rows, "UNIDADE string, CURSO string, CIDADE string, PERIODO_LETIVO string, TURNO string")
    done = enrolment.enrolments(cube, municipality)
    # The first city is listed twice.
    assert {tuple(r) for r in done.collect()} == {(2001, "U", "X", 4)}
    assert "translate" not in _optimised(done)


def test_names_of_institutions_are_cleaned_once(spark, municipality):
    rows = [("1 Rede-A", "X", "ÁGUA", "03/02/2001 T"), ("2 rede a", "X", "ÁGUA", "03/02/2001T10:00"), ("B", "X", "SOL", "2001-02-03"),
            ("C", "X", "SOL", "?"), (None, "Y", "SOL", "03/02/2001"), ("C", "X", "LUA", "03/02/2001"), ("SENAI", "X", "SOL", "03/02/2001")]
    raw = spark.createDataFrame([(a, "m", b, c, d, None) for a, b, c, d in rows], "UNIDADE_DE_ENSINO string, MODALIDADE string, "
                                "CURSO string, MUNICIPIO string, Dt_SCRAPING string, AZURE_GEOLOCATOR string")
    done = competitors.scraped_competitors(raw, municipality)
    assert {tuple(r) for r in done.collect()} == {(2001, "X", "U", 2, 0), (2001, "Y", "U", 0, 0)}
    assert "regexp_replace" not in _optimised(done)


def test_census_rows_are_summed_in_one_step(spark, municipality):
    rows = [(2001, code, 4, e, "x", 1, 1, 1, "0") for code, e in (("17", "E"), ("27", "E"), ("37", "F"), ("97", "E"))]
    raw = spark.createDataFrame(rows, "NU_ANO_CENSO int, CO_MUNICIPIO string, TP_DEPENDENCIA int, NO_ENTIDADE string, "
                                "NO_CURSO_EDUC_PROFISSIONAL string, QT_MAT_CURSO_TEC_CT int, QT_MAT_CURSO_TEC_CONC int, "
                                "QT_MAT_TEC_SUBS int, TP_LOCALIZACAO_DIFERENCIADA string")
    territory = spark.createDataFrame([("17", "Sol"), ("27", "Sol"), ("37", "Água")], "CO_MUN_IBGE_7 string, NO_MUNICIPIO string")
    done = competitors.census_competitors(raw, territory, municipality)
    found = {tuple(r) for r in done.select("ANO", "CURSO", "UNIDADE", "QTD_CONC", "QTD_MAT_CONC").collect()}
    # Two codes of one name are summed; the third name leads to two units; the last code has no name.
    assert found <= {(2001, "X", "U", 1, 6), (2001, "X", "U", 1, 3), (2001, "X", "V", 1, 3)} and (2001, "X", "V", 1, 3) in found
    assert _optimised(done).count("Aggregate [") == 2
