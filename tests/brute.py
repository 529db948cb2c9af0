"""Plain row-by-row counterparts used to check the library on small inputs."""

from pyspark.sql import functions as F

from turmalina.functions.measures import sum0
from turmalina.plans.panel import OCCUPATION, PLACE, finish_panel
from turmalina.schemas import PANEL_COLUMNS, PANEL_KEYS


def panel_by_joins(enrolments, establishments, course_occupation, job_flow, job_links,
                   competitors, benefit):
    """The same panel with the joined rows carried out; the check of ``build_panel``."""
    joined = (enrolments.dropna(subset=PANEL_KEYS).groupBy(*PANEL_KEYS)
              .agg(F.sum("MATRICULAS").alias("MAT_PAG"))
              .join(establishments.select(*PLACE, "QTD_EMPRESAS"), PLACE, "left")
              .join(course_occupation.select("CURSO", "CBO"), "CURSO", "left")
              .withColumn("CBO_UNIDADE", F.concat("CBO", "UNIDADE"))
              .join(job_flow.select(*OCCUPATION, "SALARIO_MEDIO", "SUM_ADMITIDOS",
                                    "SUM_DESLIGADOS", "SALDO_EMPREGO"), OCCUPATION, "left")
              .join(job_links.select(*OCCUPATION, "QTD_VINCULOS"), OCCUPATION, "left")
              .join(competitors.select(*PANEL_KEYS, "QTD_CONC", "QTD_MAT_CONC"), PANEL_KEYS, "left")
              .join(benefit, PLACE, "left"))
    means = ("SALARIO_MEDIO", "VLR_MEDIO_BENEFICIO")
    sums = [c for c in PANEL_COLUMNS if c not in (*PANEL_KEYS, *means, "FAIXA_MAT")]
    return finish_panel(joined.groupBy(*PANEL_KEYS).agg(
        *[sum0(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means]))
