import random

import pytest
from brute import panel_by_joins

from turmalina.plans.panel import build_panel
from turmalina.sources.tables import read_panel, work_path, write_panel

ENR = "ANO int, UNIDADE string, CURSO string, MATRICULAS long"
EST = "ANO int, UNIDADE string, QTD_EMPRESAS long"
CAT = "CURSO string, CBO string"
FLOW = ("ANO int, UNIDADE string, CO_CBO string, CBO_UNIDADE string, SALARIO_MEDIO double, "
        "SUM_ADMITIDOS long, SUM_DESLIGADOS long, SALDO_EMPREGO long")
LINK = "ANO int, UNIDADE string, CBO_UNIDADE string, QTD_VINCULOS long, SALARIO_MEDIO double"
CONC = "ANO int, CURSO string, UNIDADE string, QTD_CONC int, QTD_MAT_CONC int"
AID = "ANO int, UNIDADE string, QTD_FAMILIAS long, TOTAL_REPASSE double, VLR_MEDIO_BENEFICIO double"


def feeds(spark, enr, est=(), cat=(), flow=(), link=(), conc=(), aid=()):
    pairs = zip((enr, est, cat, flow, link, conc, aid), (ENR, EST, CAT, FLOW, LINK, CONC, AID))
    return [spark.createDataFrame(list(rows), schema) for rows, schema in pairs]


def listed(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_repetition_and_dedupe(spark):
    data = feeds(spark, [(2024, "U", "C", 5)], [(2024, "U", 7)], [("C", "1"), ("C", "2"), ("C", "3")],
                 [(2024, "U", "1", "1U", 100.0, 4, 1, 3)], [(2024, "U", "2U", 9, 50.0)],
                 [(2024, "C", "U", 1, 10), (2024, "C", "U", 1, 20)], [(2024, "U", 2, 8.0, 4.0)])
    row = build_panel(*data).first().asDict()
    assert (row["MAT_PAG"], row["QTD_CONC"], row["QTD_MAT_CONC"]) == (30, 6, 90)
    assert (row["QTD_EMPRESAS"], row["SUM_ADMITIDOS"], row["QTD_VINCULOS"]) == (42, 8, 18)
    assert (row["SALARIO_MEDIO"], row["VLR_MEDIO_BENEFICIO"], row["FAIXA_MAT"]) == (100.0, 4.0, "Entre 21 e 40")
    once = build_panel(*data, dedupe=True).first().asDict()
    assert (once["MAT_PAG"], once["QTD_CONC"], once["QTD_MAT_CONC"], once["QTD_EMPRESAS"]) == (5, 2, 30, 7)
    assert (once["SALDO_EMPREGO"], once["QTD_VINCULOS"], once["FAIXA_MAT"]) == (3, 9, "Abaixo de 21")


def test_missing_feeds_fill_with_zero_and_drop_no_row(spark):
    got = listed(build_panel(*feeds(spark, [(2024, "U", "C", 41), (2024, None, "C", 1)])))
    assert got == [(2024, "C", "U", 41, 0, 0, 0, 0, 0, 0, 0, 0.0, 0, 0.0, 0.0, "Acima de 40")]


def random_feeds(spark, seed, hot):
    rng = random.Random(seed)
    years, units, courses, codes = [2022, 2023], ["U1", "U2", None], ["C1", "C2", "C3", None], ["1", "2", "3"]

    def pick(options):
        # A third of the rows fall on one value.
        return options[0] if hot and rng.random() < 0.34 else rng.choice(options)

    def many(n, make):
        return [make() for _ in range(n)]

    def maybe(v):
        return None if rng.random() < 0.2 else v

    return feeds(
        spark,
        many(40, lambda: (pick(years), pick(units), pick(courses), rng.randint(1, 9))),
        many(5, lambda: (pick(years), pick(units), maybe(rng.randint(1, 9)))),
        sorted({(pick(courses), pick(codes)) for _ in range(8)}, key=str),
        many(20, lambda: (pick(years), "x", "y", maybe(pick(codes) + str(pick(units[:2]))), maybe(rng.random()),
                          maybe(rng.randint(0, 5)), maybe(rng.randint(0, 5)), maybe(rng.randint(-3, 5)))),
        many(12, lambda: (pick(years), "x", pick(codes) + pick(units[:2]), maybe(rng.randint(0, 5)), 1.0)),
        many(25, lambda: (pick(years), pick(courses), pick(units), maybe(1), maybe(rng.randint(0, 9)))),
        many(6, lambda: (pick(years), pick(units), maybe(2), maybe(rng.random()), maybe(rng.random()))))


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True), (3, True)])
def test_equals_the_row_by_row_joins(spark, seed, hot):
    data = random_feeds(spark, seed, hot)
    assert listed(build_panel(*data)) == listed(panel_by_joins(*data))


def test_dedupe_equals_faithful_without_repetition(spark):
    data = feeds(spark, [(2024, "U", "C", 5), (2024, "V", "C", 50)], [(2024, "U", 7)], [("C", "1")],
                 [(2024, "U", "1", "1U", 100.0, 4, 1, 3)], [(2024, "U", "1U", 9, 50.0)],
                 [(2024, "C", "U", 1, 10)], [(2024, "U", 2, 8.0, 4.0)])
    assert listed(build_panel(*data)) == listed(build_panel(*data, dedupe=True))


def test_written_by_year(spark):
    df = build_panel(*feeds(spark, [(2023, "U", "C", 5), (2024, "U", "C", 6)]))
    path = work_path(spark, "panel")
    write_panel(df, path)
    assert listed(read_panel(spark, path).select(df.columns)) == listed(df)
    one = read_panel(spark, path).filter("ANO = 2024")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(ANO" in one._jdf.queryExecution().toString()
