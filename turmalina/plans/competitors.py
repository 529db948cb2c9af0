"""Competing offers by year, course and training unit."""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.functions.measures import day_first_year, dependency, on_groups, recode_year
from turmalina.functions.text import (
    clean_institution, exclude_matching, first_match, ordered_rules, recode)
from turmalina.plans.geography import name_territory, unit_by_name
from turmalina.sources.tables import written

KEYS = ["ANO", "CURSO", "UNIDADE"]


def census_rows(raw):
    """Census rows in scope: course in upper case, dependency, enrolments of the three forms."""
    course = F.upper("NO_CURSO_EDUC_PROFISSIONAL")
    return raw.filter(
        (F.col("TP_LOCALIZACAO_DIFERENCIADA") == fv.CENSUS_LOCATION)
        & ~F.col("NO_ENTIDADE").like(f"%{fv.OWN_INSTITUTION}%")
        & F.col("NO_CURSO_EDUC_PROFISSIONAL").isNotNull()
        & ~course.like(fv.CENSUS_COURSE_EXCLUDED)
    ).select(
        F.col("NU_ANO_CENSO").alias("ANO"), "CO_MUNICIPIO",
        dependency(F.col("TP_DEPENDENCIA")).alias("DEPEND_ADM"), "NO_ENTIDADE",
        course.alias("CURSO"),
        (F.col("QT_MAT_CURSO_TEC_CT") + F.col("QT_MAT_CURSO_TEC_CONC")
         + F.col("QT_MAT_TEC_SUBS")).alias("QTD_MAT"))


def census_competitors(raw, territory, municipality, arms=None, accents=None):
    """One row per institution: competitor count 1 and its mean enrolments."""
    # Nearly every census row is a group of its own, so there is one aggregation, by name.
    named = name_territory(
        census_rows(raw), territory.withColumnRenamed("CO_MUN_IBGE_7", "CO_MUNICIPIO"),
        "CO_MUNICIPIO", "CO_MUNICIPIO")
    # Rows are summed under the raw institution name, then renamed, then averaged.
    by_name = (named.groupBy("ANO", "NO_MUNICIPIO", "CURSO", "NO_ENTIDADE")
               .agg(F.sum("QTD_MAT").alias("QTD_MAT_CONC")).filter("QTD_MAT_CONC > 0"))
    mapped = by_name.withColumn("NO_ENTIDADE", first_match(F.col("NO_ENTIDADE"), arms))
    units = written(unit_by_name(territory, municipality, accents), "units-by-name")
    placed = mapped.join(units, F.col("NO_MUNICIPIO").eqNullSafe(F.col("_nome")), "left")
    keys = [*KEYS, "NO_ENTIDADE"]
    return (placed.dropna(subset=keys).groupBy(*keys)
            .agg(F.avg("QTD_MAT_CONC").cast("int").alias("QTD_MAT_CONC"))
            # Distinct institutions inside a group keyed by institution are always one.
            .select(*KEYS, F.lit(1).alias("QTD_CONC"), "QTD_MAT_CONC"))


def scraped_offers(raw, year_recode=None):
    """Scraped offers of other institutions with mode and year conformed."""
    return (exclude_matching(raw, "UNIDADE_DE_ENSINO")
            .withColumn("MODALIDADE", recode(F.col("MODALIDADE"), fv.MODE_RECODE))
            .withColumn("ANO", recode_year(day_first_year(F.col("Dt_SCRAPING")),
                                           year_recode or fv.SCRAPE_YEAR_RECODE))
            .drop("Dt_SCRAPING", "AZURE_GEOLOCATOR"))


def scraped_competitors(raw, municipality, rules=None, year_recode=None):
    """Distinct competing institutions under their canonical names.

    A name is cleaned and canonised once, in a table of the distinct names, and not once per offer.
    """
    offers = scraped_offers(raw, year_recode).select("ANO", "CURSO", "MUNICIPIO", "UNIDADE_DE_ENSINO")
    # This feed is matched on the name as written, accents included.
    placed = offers.join(municipality.select("MUNICIPIO", "UNIDADE"), "MUNICIPIO", "left")
    written_as = (raw.select("UNIDADE_DE_ENSINO").dropna().groupBy("UNIDADE_DE_ENSINO").agg(F.count("*").alias("_n"))
                  .withColumn("_limpo", clean_institution(F.col("UNIDADE_DE_ENSINO"))))
    names = written_as.select("UNIDADE_DE_ENSINO", ordered_rules(F.col("_limpo"), rules).alias("_nome"))
    counted = (placed.dropna(subset=["CURSO", "UNIDADE"]).join(written(names, "institutions"), "UNIDADE_DE_ENSINO", "left")
               .groupBy(*KEYS).agg(F.count_distinct("_nome").cast("int").alias("QTD_CONC")))
    # A condition on the year alone would be moved down and read each date a second time.
    return (counted.filter(on_groups(F.col("QTD_CONC") + 1, F.col("ANO").isNotNull()))
            .withColumn("QTD_MAT_CONC", F.lit(0)))
