"""Own enrolments by year, training unit and course."""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.functions.measures import age_band, fill_numeric, on_groups
from turmalina.functions.text import (
    drop_subtotals, holds_word, normalise_key, recode, strip, strip_course_prefix, strip_unit_name,
    student_key)
from turmalina.sources.tables import trim_column_names, written

KEYS = ["ANO", "UNIDADE", "CURSO"]


def enrolment_rows(cube, city_recode=None):
    """Row-level view of the cube: subtotals removed, city and year conformed."""
    rows = fill_numeric(drop_subtotals(trim_column_names(cube)))
    city = recode(F.upper(strip(F.col("CIDADE"))), city_recode or fv.CITY_RECODE)
    return (rows.withColumn("ANO", F.substring(F.col("PERIODO_LETIVO").cast("string"), 1, 4)
                            .try_cast("int"))
            .withColumn("UNIDADE", strip_unit_name(F.col("UNIDADE")))
            .withColumn("CIDADE", city)
            .withColumn("CPF_E_RA", student_key(F.col("CPF"), F.col("RA")))
            .withColumn("FAIXA_ETARIA", age_band(F.col("IDADE")))
            .withColumn("MATRICULAS", F.lit(1))
            .drop("CPF", "RA", "MUNICIPIO"))


def enrolments(cube, municipality, year_cap=fv.ENROLMENT_YEAR_CAP, city_recode=None,
               unit_recode=None):
    """Number of enrolments.

    Subtotal rows go first.  Cities are few: their texts are conformed in a table with a row per text,
    and a city keeps no rows apart.  The enrolments are counted under the raw unit and course; their
    text functions, the subtotal search included, run once per group and not once per enrolment.
    """
    counted = ["UNIDADE", "CURSO", "CIDADE"]
    others = [c for c in fv.SUBTOTAL_COLUMNS if c not in counted]
    cube = trim_column_names(cube)
    # A city listed more than once repeats its enrolments, as the lookup would.
    listed = municipality.groupBy("MUNICIPIO_COD").agg(F.count("*").alias("vezes"))
    city = recode(F.upper(strip(F.col("CIDADE"))), city_recode or fv.CITY_RECODE)
    cities = _texts(cube, "CIDADE").withColumn("MUNICIPIO_COD", normalise_key(city)).join(
        listed, "MUNICIPIO_COD", "left").select(F.col("CIDADE").alias("_cidade"), F.coalesce("vezes", F.lit(1)).alias("_vezes"))
    rows = (drop_subtotals(cube, others).dropna(subset=["UNIDADE", "CURSO"])
            .select(F.substring(F.col("PERIODO_LETIVO").cast("string"), 1, 4).alias("p"), *counted)
            .join(written(cities, "cities"), F.col("CIDADE").eqNullSafe(F.col("_cidade"))))
    raw = rows.groupBy("p", "UNIDADE", "CURSO", "_vezes").agg(F.count("*").alias("n"))
    raw = raw.filter(on_groups(F.col("n"), ~holds_word([F.col("UNIDADE"), F.col("CURSO")])))
    return (raw.select(F.col("p").try_cast("int").alias("ANO"),
                       recode(strip_unit_name(F.col("UNIDADE")), unit_recode or fv.UNIT_RECODE).alias("UNIDADE"),
                       strip_course_prefix(F.col("CURSO")).alias("CURSO"), (F.col("n") * F.col("_vezes")).alias("n"))
            .filter(on_groups(F.col("n"), F.col("ANO") <= year_cap))
            .groupBy(*KEYS).agg(F.sum("n").alias("MATRICULAS")))


def _texts(cube, column):
    """The distinct texts of a column that are no subtotals, null included."""
    texts = cube.groupBy(column).agg(F.count("*").alias("_n"))
    return texts.filter(on_groups(F.col("_n"), ~holds_word([F.col(column)]))).select(column)
