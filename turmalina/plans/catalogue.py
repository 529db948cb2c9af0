"""Course catalogue: which occupations a course leads to."""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.functions.text import (
    contains_any, keyword_class, keyword_repair, not_blank, occupation_code, strip, strip_titles)
from turmalina.operators.lines import explode_lines

TITLE, OCCUPATIONS, ITINERARIES = (
    "Denominação do Curso", "Ocupações CBO Associadas", "Itinerários Formativos")


def itinerary_list(raw):
    """Technical items of the itinerary list."""
    item = F.col("`Nome do Item`")
    return (raw.withColumn("MODALIDADE", keyword_class(item, fv.ITEM_CLASSES, fv.TECHNICAL))
            .withColumn("Nome do Item", strip_titles(item))
            .filter(F.col("MODALIDADE") == fv.TECHNICAL).distinct())


def _packed(raw, column):
    return (raw.drop(*fv.CATALOGUE_DROPPED)
            .select(strip_titles(F.col(f"`{TITLE}`")).alias(TITLE), column)
            .dropna().distinct())


def catalogue_occupations(raw):
    """Occupation lines of each course with their code (null where a line has none)."""
    lines = explode_lines(_packed(raw, OCCUPATIONS), [OCCUPATIONS])
    cell = F.col(f"`{OCCUPATIONS}`")
    return (lines.filter(not_blank(cell) & ~contains_any(cell, fv.UNCLASSIFIED_OCCUPATION))
            .withColumn("CBO", occupation_code(cell)).withColumn(OCCUPATIONS, strip(cell)))


def catalogue_itineraries(raw):
    """Itinerary lines of each course with their modality."""
    lines = explode_lines(_packed(raw, ITINERARIES), [ITINERARIES])
    cell = F.col(f"`{ITINERARIES}`")
    return (lines.withColumn(ITINERARIES, keyword_repair(cell))
            .withColumn("MODALIDADE",
                        keyword_class(cell, fv.ITINERARY_CLASSES, fv.ITINERARY_CLASS_OTHER))
            .filter(~contains_any(cell, fv.ITINERARY_EXCLUDED) & not_blank(cell))
            .withColumn(ITINERARIES, strip(cell)))


def course_occupation(raw, modality: str | None = fv.TECHNICAL):
    """Distinct (``CBO``, ``CURSO``, ``MODALIDADE``).

    Technical courses need the occupation lines only.  ``modality=None`` gives all
    modalities: every itinerary of a course inherits the course's occupations.
    """
    codes = (catalogue_occupations(raw).filter("CBO IS NOT NULL")
             .select(F.col(f"`{TITLE}`").alias("_titulo"), "CBO").distinct())
    technical = codes.select("CBO", F.col("_titulo").alias("CURSO"),
                             F.lit(fv.TECHNICAL).alias("MODALIDADE"))
    if modality == fv.TECHNICAL:
        return technical
    lines = catalogue_itineraries(raw).select(
        F.col(f"`{TITLE}`").alias("_titulo"), F.col(f"`{ITINERARIES}`").alias("CURSO"),
        "MODALIDADE").distinct()
    others = codes.join(lines, "_titulo").select("CBO", "CURSO", "MODALIDADE").distinct()
    everything = technical.unionByName(others)
    return everything if modality is None else everything.filter(F.col("MODALIDADE") == modality)
