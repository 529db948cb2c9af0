"""Labour-market feeds at the grain of training unit and occupation.

Raw rows are aggregated on their own codes first; names, accents and units are looked up
on the aggregate.
"""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.functions.measures import lagged_year, sum0
from turmalina.functions.text import code_family
from turmalina.plans.geography import attach_unit, name_territory, restore_accents, within_years


def job_links(raw, territory, municipality, years=fv.LAGGED_YEARS, accents=None):
    """Formal job links: count, and mean over municipalities of the mean wage."""
    coded = (raw.filter(F.col("Ano").isin(list(years)))
             .groupBy("CO_MUN_IBGE_6", "CO_CBO", "Ano")
             .agg(F.count("*").alias("n"), F.sum("VL_REMUNERACAO_MEDIA_NOMINAL").alias("s")))
    named = restore_accents(name_territory(coded, territory, "CO_MUN_IBGE_6"), accents)
    by_name = (named.withColumn("ANO", lagged_year(F.col("Ano"), years))
               .groupBy("NO_MUNICIPIO", "CO_CBO", "ANO")
               .agg(F.sum("n").alias("QTD_VINCULOS"),
                    F.try_divide(F.sum("s"), F.sum("n")).alias("SALARIO_MEDIO")))
    keys = ["ANO", "UNIDADE", "CBO_UNIDADE"]
    return (attach_unit(by_name, municipality)
            .withColumn("CBO_UNIDADE", F.concat(F.col("CO_CBO").cast("string"), "UNIDADE"))
            .dropna(subset=keys).groupBy(*keys)
            .agg(sum0("QTD_VINCULOS").alias("QTD_VINCULOS"),
                 F.avg("SALARIO_MEDIO").alias("SALARIO_MEDIO")))


def establishments(raw, territory, municipality, years=fv.LAGGED_YEARS, accents=None):
    """Number of establishment rows."""
    coded = (raw.filter(F.col("Ano").isin(list(years)))
             .groupBy("COD_MUN", "Ano").agg(F.count("*").alias("QTD_EMPRESAS")))
    territory = territory.withColumnRenamed("CO_MUN_IBGE_6", "COD_MUN")
    named = restore_accents(name_territory(coded, territory, "COD_MUN", "COD_MUN"), accents)
    keys = ["ANO", "UNIDADE"]
    return (attach_unit(named.withColumn("ANO", lagged_year(F.col("Ano"), years)), municipality)
            .dropna(subset=keys).groupBy(*keys)
            .agg(sum0("QTD_EMPRESAS").alias("QTD_EMPRESAS")))


def job_flow_by_municipality(raw, years=fv.FLOW_YEARS, wage_range=fv.WAGE_RANGE,
                             excluded_category=fv.INTERMITTENT_CATEGORY):
    """Hires and separations by year, municipality and occupation."""
    def wage_if(flag):
        return F.sum(F.when(F.col(flag) > 0, F.col("salario")).otherwise(0.0))

    return (raw.filter(within_years("Data", years)
                       & F.col("salario").between(*wage_range)
                       & (F.col("categoria") != excluded_category))
            .groupBy(F.year("Data").alias("ANO"), "municipio",
                     F.col("cbo2002_ocupacao").cast("string").alias("CO_CBO"))
            .agg(wage_if("desligados").alias("SALARIO_DESLIGADOS"),
                 wage_if("admitidos").alias("SALARIO_ADMITIDOS"),
                 F.avg("salario").alias("SALARIO_MEDIO"),
                 F.sum("admitidos").alias("SUM_ADMITIDOS"),
                 F.sum("desligados").alias("SUM_DESLIGADOS"))
            .withColumn("CO_CBO_FAMILIA", code_family(F.col("CO_CBO"))))


def job_flow(raw, territory, municipality, years=fv.FLOW_YEARS, wage_range=fv.WAGE_RANGE,
             excluded_category=fv.INTERMITTENT_CATEGORY, accents=None):
    """Job flow by unit and occupation; wages are means over municipalities."""
    coded = job_flow_by_municipality(raw, years, wage_range, excluded_category)
    named = restore_accents(name_territory(coded, territory.withColumnRenamed(
        "CO_MUN_IBGE_6", "municipio"), "municipio", "municipio"),
        accents or fv.MUNICIPALITY_ACCENTS_FLOW)
    keys = ["ANO", "UNIDADE", "CO_CBO", "CBO_UNIDADE"]
    return (attach_unit(named, municipality)
            .withColumn("CBO_UNIDADE", F.concat("CO_CBO", "UNIDADE"))
            .dropna(subset=keys).groupBy(*keys)
            .agg(F.avg("SALARIO_ADMITIDOS").alias("SALARIO_ADMITIDOS"),
                 F.avg("SALARIO_DESLIGADOS").alias("SALARIO_DESLIGADOS"),
                 F.avg("SALARIO_MEDIO").alias("SALARIO_MEDIO"),
                 sum0("SUM_ADMITIDOS").alias("SUM_ADMITIDOS"),
                 sum0("SUM_DESLIGADOS").alias("SUM_DESLIGADOS"))
            .withColumn("SALDO_EMPREGO", F.col("SUM_ADMITIDOS") - F.col("SUM_DESLIGADOS")))


def family_benefit(raw, territory, municipality, years=fv.BENEFIT_YEARS, state=fv.STATE,
                   accents=None):
    """Family benefit by unit: families, transfers, and mean of the mean benefit."""
    # Sums and counts by code keep the mean over raw rows exact after the lookup.
    coded = (raw.filter(within_years("referencia", years) & (F.col("uf") == state))
             .groupBy(F.year("referencia").alias("ANO"), "CO_MUN_IBGE_6")
             .agg(F.sum("familias_pbf_pos_2023").alias("f"),
                  F.sum("valor_repasse_familias_pbf_a_partir_2023").alias("r"),
                  F.sum("valor_beneficio_medio_apos_mar_2023").alias("v"),
                  F.count("valor_beneficio_medio_apos_mar_2023").alias("n")))
    named = restore_accents(name_territory(coded, territory, "CO_MUN_IBGE_6"), accents)
    keys = ["ANO", "UNIDADE"]
    return (attach_unit(named, municipality).dropna(subset=keys).groupBy(*keys)
            .agg(sum0("f").alias("QTD_FAMILIAS"), sum0("r").alias("TOTAL_REPASSE"),
                 F.try_divide(F.sum("v"), F.sum("n")).alias("VLR_MEDIO_BENEFICIO")))
