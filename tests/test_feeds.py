import datetime as dt

from pyspark.sql import functions as F

from turmalina.plans import catalogue, competitors, enrolment, geography, labour
from turmalina.schemas import FEED_SCHEMAS
from turmalina.sources import tables as io


def feed(spark, name, rows):
    return spark.createDataFrame(rows, FEED_SCHEMAS[name])


def dims(spark):
    units = feed(spark, "municipality_unit", [
        ("Camaçari", "Salvador"), ("Salvador", "Salvador"), ("Ilhéus", "Ilhéus")])
    territory = feed(spark, "territory", [
        ("1", "17", "CAMACARI"), ("2", "27", "SALVADOR"), ("3", "37", "ILHEUS"), ("4", "47", "SEM UNIDADE")])
    return geography.municipality_dimension(units), territory


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_municipality_dimension(spark):
    municipality, _ = dims(spark)
    assert ("ILHÉUS", "ILHÉUS", "ILHEUS") in rows(municipality, "MUNICIPIO")


def test_job_links_average_the_municipal_means(spark):
    municipality, territory = dims(spark)
    raw = feed(spark, "job_links_raw", [
        ("1", "111111", 2022, 10.0), ("1", "111111", 2022, 20.0), ("2", "111111", 2022, 45.0),
        ("2", None, 2022, 1.0), ("4", "111111", 2022, 9.0), ("9", "111111", 2022, 9.0),
        ("1", "111111", 2020, 7.0), ("3", "111111", 2024, None)])
    got = rows(labour.job_links(raw, territory, municipality), "ANO")
    assert got == [(2023, "SALVADOR", "111111SALVADOR", 3, 30.0),
                   (2025, "ILHÉUS", "111111ILHÉUS", 1, None)]


def test_establishments(spark):
    municipality, territory = dims(spark)
    raw = feed(spark, "establishments_raw", [
        ("1", "a", 2023), ("1", "b", 2023), ("2", "a", 2023), ("4", "a", 2023), ("3", "a", 2019)])
    assert rows(labour.establishments(raw, territory, municipality), "ANO") == [(2024, "SALVADOR", 3)]


def test_job_flow(spark):
    municipality, territory = dims(spark)
    day = dt.date(2024, 5, 1)
    raw = feed(spark, "job_flow_raw", [
        (day, "1", "111111", 1000.0, 1, 0, 101), (day, "1", "111111", 2000.0, 0, 1, 101),
        (day, "2", "111111", 3000.0, 1, 0, 101), (day, "2", "111111", 100.0, 1, 0, 101),
        (day, "2", "111111", 3000.0, 1, 0, 111), (day, "2", "111111", 3000.0, 1, 0, None),
        (dt.date(2022, 12, 31), "2", "111111", 3000.0, 1, 0, 101)])
    got = rows(labour.job_flow(raw, territory, municipality), "ANO")
    assert got == [(2024, "SALVADOR", "111111", "111111SALVADOR", 2000.0, 1000.0, 2250.0, 2, 1, 1)]


def test_family_benefit_mean_is_over_raw_rows(spark):
    municipality, territory = dims(spark)
    d1, d2 = dt.date(2023, 1, 1), dt.date(2023, 2, 1)
    raw = feed(spark, "benefit_raw", [
        (d1, "1", "BA", 10, 100.0, 4.0), (d2, "1", "BA", 10, 100.0, 6.0), (d1, "2", "BA", 1, 5.0, 11.0),
        (d1, "2", "SP", 9, 9.0, 9.0), (d2, "3", "BA", None, None, None)])
    assert rows(labour.family_benefit(raw, territory, municipality), "UNIDADE") == [
        (2023, "ILHÉUS", 0, 0.0, None), (2023, "SALVADOR", 21, 205.0, 7.0)]


def test_census_counts_one_per_institution(spark):
    municipality, territory = dims(spark)
    def row(code, name, course, a, b, c, place="0"):
        return (2024, code, 4, name, course, a, b, c, place)
    raw = feed(spark, "school_census_raw", [
        row("17", "SENAC A", "Redes", 5, 0, 0), row("27", "SENAC B", "redes", 8, 1, 0),
        row("17", "ESCOLA", "Redes", 0, 0, 0), row("17", "OUTRA", "Redes", 4, None, 1),
        row("17", "SENAI X", "Redes", 5, 0, 0), row("17", "ESCOLA", "Magistério", 5, 0, 0),
        row("17", "ESCOLA", None, 5, 0, 0), row("17", "ESCOLA", "Redes", 5, 0, 0, "1"),
        row("37", "ESCOLA", "Redes", 2, 1, 1)])
    got = rows(competitors.census_competitors(raw, territory, municipality), "UNIDADE", "QTD_MAT_CONC")
    # Both names of one institution are averaged: (5 + 9) / 2.
    assert got == [(2024, "REDES", "ILHÉUS", 1, 4), (2024, "REDES", "SALVADOR", 1, 7)]


def test_scraped_competitors(spark):
    municipality, _ = dims(spark)
    raw = feed(spark, "competitors_scraped", [
        ("SENAC CA", "EAD", "REDES", "SALVADOR", "01/02/2026", None),
        ("Senac Camaçari", "EAD", "REDES", "CAMAÇARI", "01/02/2025", "g"),
        ("Grau Técnico Juazeiro", "EAD", "REDES", "SALVADOR", "01/02/2025", "g"),
        ("1 GRAU TÉCNICO-JUAZEIRO", "EAD", "REDES", "SALVADOR", "01/02/2025", "g"),
        ("Senai Cimatec", "EAD", "REDES", "SALVADOR", "01/02/2025", "g"),
        ("ESCOLA", "EAD", "REDES", "CAMACARI", "01/02/2025", "g"),
        (None, "EAD", "REDES", "ILHÉUS", "01/02/2024", "g")])
    got = rows(competitors.scraped_competitors(raw, municipality), "ANO")
    # SENAC CAMAÇARI becomes SENACMAÇARI: the shorter rule comes first and leaves the rest.
    assert got == [(2024, "REDES", "ILHÉUS", 0, 0), (2025, "REDES", "SALVADOR", 3, 0)]


def cube_row(**values):
    names = FEED_SCHEMAS["enrolment_cube"].names
    return tuple(values.get(n) for n in names)


def test_enrolments(spark):
    municipality, _ = dims(spark)
    base = dict(UNIDADE="SENAI CIMATEC", CURSO="Técnico em Redes", PERIODO_LETIVO="2024/1", CIDADE=" salvador")
    cube = feed(spark, "enrolment_cube", [
        cube_row(**base), cube_row(**{**base, "UNIDADE": "SENAI DENDEZEIROS"}),
        cube_row(**{**base, "CURSO": "TÉCNICO  EM redes "}), cube_row(**{**base, "SEXO": "Total"}),
        cube_row(**{**base, "CURSO": "Total geral"}), cube_row(**{**base, "PERIODO_LETIVO": "2024 total"}),
        cube_row(**{**base, "PERIODO_LETIVO": "2026/1"}), cube_row(**{**base, "UNIDADE": None}),
        cube_row(**{**base, "UNIDADE": "SENAI LEM"}), cube_row(**{**base, "PERIODO_LETIVO": "x"})])
    got = rows(enrolment.enrolments(cube, municipality), "UNIDADE")
    assert got == [(2024, "LUÍS EDUARDO MAGALHÃES", "REDES", 1), (2024, "SALVADOR", "REDES", 3)]


def test_a_city_listed_twice_repeats_its_enrolments(spark):
    municipality, _ = dims(spark)
    cube = feed(spark, "enrolment_cube", [
        cube_row(UNIDADE="X", CURSO="C", PERIODO_LETIVO="2024", CIDADE="Ilheus"),
        cube_row(UNIDADE="X", CURSO="C", PERIODO_LETIVO="2024", CIDADE="fora")])
    twice = municipality.unionByName(municipality.filter("MUNICIPIO_COD = 'ILHEUS'"))
    assert rows(enrolment.enrolments(cube, twice), "ANO") == [(2024, "X", "C", 3)]


def test_catalogue(spark):
    raw = feed(spark, "course_catalogue", [
        ("Técnico em Redes", "3132-05 - Tec\n \nOcupação ainda não classificada\n313205 outro\nsem",
         "Especialização Técnica em A\nSugestões de B\nBacharelado em C\nOficina"),
        ("Técnico em Redes", "3132-05 - Tec\n \nOcupação ainda não classificada\n313205 outro\nsem", None),
        ("Técnico em Solda", None, "Licenciatura em D")])
    assert rows(catalogue.course_occupation(raw), "CURSO") == [("313205", "REDES", "CHP")]
    assert rows(catalogue.course_occupation(raw, None), "MODALIDADE") == [
        ("313205", "REDES", "CHP"), ("313205", "Oficina", "FIC"), ("313205", "Bacharelado em C", "GRAD"),
        ("313205", "Especialização Técnica em A", "POSTEC")]
    assert rows(catalogue.course_occupation(raw, "GRAD"), "CBO") == [
        ("313205", "Bacharelado em C", "GRAD")]


def test_itinerary_list(spark):
    raw = feed(spark, "itinerary", [("Técnico em A",), ("TÉCNICO EM A",), ("Especialista em B",), (None,)])
    assert rows(catalogue.itinerary_list(raw), F.col("`Nome do Item`").asc_nulls_last()) == [
        ("A", "CHP"), (None, "CHP")]


def test_conform_adds_casts_and_clears_nan(spark):
    df = spark.createDataFrame([("1", float("nan"), "x")], "b string, a double, z string")
    from pyspark.sql import types as T
    got = io.conform(df, T.StructType.fromDDL("a double, b int, c string"))
    assert got.columns == ["a", "b", "c"] and tuple(got.first()) == (None, 1, None)


def test_folder_of_differing_files(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x int, y string").coalesce(1).write.parquet(str(tmp_path / "p1"))
    spark.createDataFrame([("b", 2.5)], "y string, w double").coalesce(1).write.parquet(str(tmp_path / "p2"))
    got = io.read_folder(spark, str(tmp_path / "*"), "*.parquet")
    assert sorted(tuple(r) for r in got.select("y", "x", "w").collect()) == [
        ("a", 1, None), ("b", None, 2.5)]


def test_csv_headers_are_checked(spark, tmp_path):
    import pytest
    path = str(tmp_path / "c.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,2\n")
    assert tuple(io.read_table(spark, path, "a int, b int", "csv").first()) == (1, 2)
    with pytest.raises(Exception):
        io.read_table(spark, path, "b int, a int", "csv").collect()


def test_query_errors_are_wrapped(spark):
    import pytest
    with pytest.raises(RuntimeError):
        io.run_query(spark, "SELECT nothing FROM nowhere")


def test_trim_column_names(spark):
    assert io.trim_column_names(spark.createDataFrame([(1,)], "` a ` int")).columns == ["a"]


def test_enrolment_texts_are_cleaned_per_group(spark):
    """Catalyst must not move the text functions below the first count."""
    municipality, _ = dims(spark)
    cube = feed(spark, "enrolment_cube", [cube_row(UNIDADE="X", CURSO="C", PERIODO_LETIVO="2024", CIDADE="I")])
    plan = enrolment.enrolments(cube, municipality)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("count(1) AS n#"):].split("MUNICIPIO_COD#")[0]
    assert "DENDEZEIROS" in plan and "DENDEZEIROS" not in below and "ARAÇAS" not in below
