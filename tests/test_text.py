import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.functions import measures, text
from turmalina.operators.lines import explode_lines


def values(spark, data, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def plain_key(value):
    kept = (c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.combining(c))
    return re.sub(r"[^0-9A-Za-z]+", "", "".join(kept)).upper()


def test_key_normaliser_golden(spark):
    assert values(spark, ["São Gonçalo d'Água-Ç", None, "ﬁ ½ 𝟏x"], text.normalise_key) == [
        "SAOGONCALODAGUAC", "", "FI121X"]


def test_key_normaliser_on_every_character(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    data = ["a" + "b".join(map(chr, points[i:i + 500])) + "z" for i in range(0, len(points), 500)]
    assert values(spark, data, text.normalise_key) == [plain_key(v) for v in data]


def test_ordered_rules_golden(spark):
    rules = [("UNI POLO BARRA", "UNIC"), ("UNI POLO BARRA DA ESTIVA", "UNIC")]
    assert values(spark, ["UNI POLO BARRA DA ESTIVA", None],
                  lambda c: text.ordered_rules(c, rules)) == ["UNIC DA ESTIVA", None]
    rules = [("UNI POLO CAM", "UNIC"), ("UNIC_AREM", "UNIC")]
    assert values(spark, ["UNI POLO CAM_AREM"],
                  lambda c: text.ordered_rules(c, rules)) == ["UNIC_AREM"]
    assert values(spark, ["ab"], lambda c: text.ordered_rules(c, [("b", r"$1\2")])) == [r"a$1\2"]


def test_default_rules_match_a_frame_replace(spark):
    names = [p for p, _ in fv.SCRAPED_INSTITUTIONS]
    names += [n.replace("(", "").replace(")", "") + " II" for n in names]
    names += ["X " + n + " " + n for n in names[:20]] + ["OUTRA ESCOLA", ""]
    expected = pd.Series(names).replace(dict(fv.SCRAPED_INSTITUTIONS), regex=True).tolist()
    assert values(spark, names, text.ordered_rules) == expected


def test_first_match_takes_the_first_arm(spark):
    data = ["CENTRO DE EDUCACAO", "COLEGIO SENAC X", "CENTRO EDUCACIONAL", "ESCOLA", None,
            "CENTRO DE EDUCAÇÃO PROFISSIONAL SENAC CASA DO COMÉRCIO", "UNICSUL GRAU TECNICO",
            "COLEGIO ESTADUAL DE COCOS TEMPO INTEGRAL", "COLEGIO ESTADUAL DE COCOS TEMPO INTEGRAL B"]
    assert values(spark, data, text.first_match) == [
        "CE", "SENAC", "CE", "ESCOLA", None, "SENAC", "GRAU TÉCNICO", "COLEGIO ESTADUAL DE COCOS",
        "COLEGIO ESTADUAL DE COCOS TEMPO INTEGRAL B"]


def test_recode(spark):
    assert values(spark, ["ILHEUS", "SANTA TEREZINHA", None],
                  lambda c: text.recode(c, fv.MUNICIPALITY_ACCENTS)) == [
        "ILHÉUS", "SANTA TEREZINHA", None]
    assert values(spark, ["SANTA TEREZINHA"],
                  lambda c: text.recode(c, fv.MUNICIPALITY_ACCENTS_FLOW)) == ["SANTA TERESINHA"]
    assert values(spark, ["PETROLINA"], lambda c: text.recode(c, fv.CITY_RECODE)) == ["JUAZEIRO"]


def test_occupation_code(spark):
    data = ["3132-05 - Tec", "313205", "none", "12 3132 - 05", "a 3132", None]
    assert values(spark, data, text.occupation_code) == [
        "313205", "313205", None, "313205", "3132", None]


def test_subtotals(spark):
    df = spark.createDataFrame([("Total geral", "a"), ("totalizado", "b"), (None, "c"),
                                ("x", " TOTAL "), ("subtotal", "d"), ("totalé", "e"), ("total-1", "f")],
                               "UNIDADE string, CURSO string")
    kept = [r.CURSO for r in text.drop_subtotals(df).orderBy("CURSO").collect()]
    assert kept == ["b", "c", "d", "e"]


def test_exclude_keeps_nulls(spark):
    df = spark.createDataFrame([("x senai y",), (None,), ("outro",)], "u string")
    assert {r.u for r in text.exclude_matching(df, "u").collect()} == {None, "outro"}


def test_unit_and_course_names(spark):
    assert values(spark, ["SENAI  CIMATEC", "SENAI FEIRA\t", "DENDEZEIROSX", "X SENAI"],
                  text.strip_unit_name) == ["SALVADOR", "FEIRA", "DENDEZEIROSX", "X SENAI"]
    assert values(spark, ["técnico  em redes ", "Curso técnico em X", None],
                  text.strip_course_prefix) == ["REDES", "CURSO TÉCNICO EM X", None]
    assert values(spark, ["Curso técnico em redes", "TECNÓLOGO EM X"], text.strip_titles) == [
        "CURSO REDES", "X"]
    assert values(spark, ["12 Escola – A/B-c "], text.clean_institution) == ["ESCOLA A B C"]


def test_keyword_classes(spark):
    data = ["ESPECIALIZAÇÃO técnica em X", "bacharel em Y", "Curso", None]
    assert values(spark, data, lambda c: text.keyword_class(
        c, fv.ITINERARY_CLASSES, fv.ITINERARY_CLASS_OTHER)) == ["POSTEC", "GRAD", "FIC", "FIC"]
    assert values(spark, ["x BACHAREALDO EM NEGÓCIOS DA MODA y", "z", None], text.keyword_repair) == [
        "Bacharelado em Negócios da Moda", "z", None]


def test_explode_lines_pads_and_keeps_null_cells(spark):
    df = spark.createDataFrame([(1, "a\nb\n", "x"), (2, None, "y\nz")], "i int, p string, q string")
    got = sorted(tuple(r) for r in explode_lines(df, ["p", "q"]).collect())
    assert got == [(1, "", ""), (1, "a", "x"), (1, "b", ""), (2, "", "y"), (2, "", "z")]


def test_bands(spark):
    df = spark.createDataFrame([(20,), (21,), (40,), (41,)], "n int")
    assert [r[0] for r in df.select(measures.enrolment_band(F.col("n"))).collect()] == [
        fv.BAND_LOW, fv.BAND_MID, fv.BAND_MID, fv.BAND_HIGH]
    ages = spark.createDataFrame([(None,), (14,), (15,), (17,), (24,), (30,), (39,), (50,), (59,), (60,)],
                                 "n int")
    assert [r[0] for r in ages.select(measures.age_band(F.col("n"))).collect()] == [
        "Menor de 14 anos", "Menor de 14 anos", "14 a 17", "14 a 17", "18 a 24", "25 a 30",
        "31 a 39", "40 a 50", "51 a 59", "+ 60"]


def test_years(spark):
    assert values(spark, ["05/03/2024", "5/3/2024 10:00", "2023-01-09", "x", None],
                  measures.day_first_year) == [2024, 2024, 2023, None, None]
    df = spark.createDataFrame([(2021,), (2022,), (2024,)], "y int")
    assert [r[0] for r in df.select(measures.lagged_year(F.col("y"), fv.LAGGED_YEARS)).collect()] == [
        None, 2023, 2025]


def test_personal_data_is_digested(spark):
    df = spark.createDataFrame([("123", "9")], "d string, r string")
    key = df.select(text.student_key(F.col("d"), F.col("r"))).first()[0]
    assert re.fullmatch("[0-9a-f]{64}", key)


def test_fill_numeric(spark):
    df = spark.createDataFrame([(None, float("nan"), None)], "a int, b double, c string")
    assert tuple(measures.fill_numeric(df).first()) == (0, 0.0, None)
