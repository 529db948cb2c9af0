"""History replay and future scenarios."""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.operators.latest import latest_numbers_per, latest_per
from turmalina.operators.median import exact_median
from turmalina.operators.pairs import pair_keys
from turmalina.plans.scoring import band_columns, cell_label, score, with_features
from turmalina.schemas import NUMERIC

LAST = ["ANO", "CURSO", "UNIDADE"]
GLOBAL = "GLOBAL"
MEASURES = [c for c in NUMERIC if c != "ANO"]


def context_by_year(panel, unit=None, course=None):
    """Yearly context of each unit and course."""
    return (choose(panel, UNIDADE=unit, CURSO=course).groupBy("ANO", "UNIDADE", "CURSO").agg(
        F.max("QTD_CONC").alias("QTD_CONC"), F.max("QTD_EMPRESAS").alias("QTD_EMPRESAS"),
        F.avg("SALARIO_MEDIO").alias("SALARIO_MEDIO"),
        F.sum("SALDO_EMPREGO").alias("SALDO_EMPREGO"), F.sum("MAT_PAG").alias("MAT_PAG")))


def choose(df, **selection):
    """Rows equal to each given value; ``None`` and the wildcards choose everything."""
    for column, value in selection.items():
        if value is not None and value not in (GLOBAL, "TODOS"):
            df = df.filter(F.col(column) == value)
    return df


def distinct_years(panel):
    """The panel's years as one sorted array value (there are only a few)."""
    return panel.agg(F.array_sort(F.collect_set("ANO"))).scalar()


def probability_history(panel, scorer, unit=None, course=None, per_course=True):
    """The latest context of each selection, replayed at every year of the panel.

    One selection per unit and course, or per unit over all courses
    (``per_course=False``).  The benefit is no part of the context and counts as 0.
    """
    context = context_by_year(panel, unit, course)
    keys = ["UNIDADE", "CURSO"] if per_course else ["UNIDADE"]
    latest = latest_per(context, keys, ["ANO", "CURSO"]).drop("ANO")
    replay = latest.withColumn("ANO", F.explode(distinct_years(panel)))
    rows = score(with_features(replay), scorer)
    return band_columns(rows.withColumn("ANO", F.col("ANO").cast("int")), scorer) \
        .select(*(["UNIDADE", "CURSO"]), "ANO", *scorer.classes)


def factors_of(name):
    return fv.SCENARIOS.get(name, fv.SCENARIOS["base"])


def scenario_rows(rows, year=fv.FUTURE_YEAR, scenarios=tuple(fv.SCENARIOS)):
    """Each row once per scenario: future year, four measures multiplied."""
    cases = F.array(*[F.struct(F.lit(name).alias("nome"), *[
        F.lit(f).alias(m) for m, f in zip(fv.SCENARIO_MEASURES, factors_of(name))])
        for name in scenarios])
    spread = rows.withColumn("_c", F.explode(cases))
    return spread.withColumns({
        "ANO": F.lit(year), "CENARIO": F.col("_c.nome"),
        **{m: F.col(m).cast("double") * F.col(f"_c.{m}") for m in fv.SCENARIO_MEASURES},
    }).drop("_c")


def course_medians(panel):
    """Exact median competitor count of each course over all units and years."""
    return exact_median(panel, ["CURSO"], "QTD_CONC", "QTD_CONC_MEDIANA")


def course_stats(panel):
    """Mean job balance and wage of each course over all units and years."""
    return panel.groupBy("CURSO").agg(F.avg("SALDO_EMPREGO").alias("SALDO_EMPREGO_MEDIO"),
                                      F.avg("SALARIO_MEDIO").alias("SALARIO_MEDIO_MEDIO"))


def future_base(panel, units=None):
    """One row per unit and course: its last record, or the unit's last record with the
    course's median competitor count where the pair was never offered.

    The pairs never offered are the keys of the grid without those of the panel; a side's
    measures are looked up for them by its own key alone.
    """
    chosen = panel if units is None else panel.filter(F.col("UNIDADE").isin(list(units)))
    chosen = chosen.select("UNIDADE", "CURSO", *NUMERIC)
    of_pair = latest_numbers_per(chosen, ["UNIDADE", "CURSO"], MEASURES)
    of_unit = latest_per(of_pair, ["UNIDADE"], ["ANO", "CURSO"]).drop("ANO", "CURSO", "QTD_CONC")
    medians = course_medians(panel)
    doubles = [F.col(m).cast("double").alias(m) for m in MEASURES]
    known = of_pair.join(medians.select("CURSO"), "CURSO", "left_semi").select(
        "UNIDADE", "CURSO", *doubles, F.lit(True).alias("HISTORICO_NA_UNIDADE"))
    keys = pair_keys(of_unit.select("UNIDADE"), medians.select("CURSO"), "CURSO")
    never = keys.join(of_pair.select("UNIDADE", "CURSO"), ["UNIDADE", "CURSO"], "left_anti")
    filled = never.join(of_unit, "UNIDADE").join(medians.withColumnRenamed("QTD_CONC_MEDIANA", "QTD_CONC"), "CURSO")
    return known.unionByName(filled.select("UNIDADE", "CURSO", *doubles, F.lit(False).alias("HISTORICO_NA_UNIDADE")))


def future_matrix(panel, scorer, year=fv.FUTURE_YEAR, scenarios=tuple(fv.SCENARIOS), units=None):
    """Dominant band of every unit and course under every scenario, scored in one pass."""
    rows = score(scenario_rows(future_base(panel, units), year, scenarios), scorer)
    return rows.select(
        F.col("ANO").cast("int").alias("ANO_SIM"), "CENARIO", "UNIDADE", "CURSO",
        "FAIXA_DOMINANTE", "PROB_MAX",
        cell_label(F.col("FAIXA_DOMINANTE"), F.col("PROB_MAX")).alias("col_recom"),
        "HISTORICO_NA_UNIDADE")
