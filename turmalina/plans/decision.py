"""From probabilities to text and tables."""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.functions.text import constant_map
from turmalina.operators.latest import appearance
from turmalina.plans.scenario import LAST, choose, future_matrix
from turmalina.plans.scoring import by_size


def advice(band, probability):
    """Offer advice by band and probability."""
    chain = F
    for name, floor, text in fv.ADVICE:
        chain = chain.when((band == name) & (probability >= floor), F.lit(text))
    return chain.otherwise(F.lit(fv.ADVICE_OTHER))


def _shown(variables):
    table = constant_map(fv.DISPLAY_NAMES)
    return F.array_join(
        F.transform(variables, lambda x: F.coalesce(
            F.element_at(table, x["VARIAVEL"]), x["VARIAVEL"])), ", ")


def _fill(text, *values):
    return F.format_string(text, *values)


def _relevant(points):
    return F.lit(points / 100)


def executive_real(rows, floor=fv.EXECUTIVE_FLOOR, points=fv.RELEVANT_POINTS, fix_labels=False):
    """Status text and level of the real case, from its band, probability and impacts.

    The low band's label in the text rules differs from the label in the data, so low rows
    get the general text; ``fix_labels=True`` lets the low text apply.
    """
    ordered = by_size(F.col("IMPACTOS"))
    risks = F.filter(ordered, lambda x: x["IMPACTO"] < -_relevant(points))
    percent = F.col("PROB_MAX") * 100
    band = F.col("FAIXA_DOMINANTE")
    low = band == (fv.BAND_LOW if fix_labels else fv.EXECUTIVE_LOW_LABEL)
    high = (band == fv.BAND_HIGH) & (F.col("PROB_MAX") >= floor)
    text = (F.when(low, _fill(fv.TEXT_LOW, percent))
            .when(band == fv.BAND_MID, _fill(fv.TEXT_MID, percent))
            .when(high & (F.size(risks) > 0),
                  _fill(fv.TEXT_HIGH_RISK, percent, _shown(F.slice(risks, 1, 2))))
            .when(high, _fill(fv.TEXT_HIGH, percent)).otherwise(fv.TEXT_BALANCED))
    level = (F.when(low, fv.LEVEL_WARNING).when(band == fv.BAND_MID, fv.LEVEL_INFO)
             .when(high, fv.LEVEL_SUCCESS).otherwise(fv.LEVEL_INFO))
    return rows.withColumns({"TEXTO": text, "NIVEL": level})


def executive_whatif(rows, points=fv.RELEVANT_POINTS):
    """Status text and level of the what-if case."""
    ordered = by_size(F.col("IMPACTOS"))
    moved = F.filter(ordered, lambda x: F.abs(x["IMPACTO"]) > _relevant(points))
    text = F.when(F.size(moved) == 0, fv.TEXT_WHATIF_STABLE).otherwise(
        _fill(fv.TEXT_WHATIF_SHIFT, F.col("FAIXA_DOMINANTE"), _shown(F.slice(moved, 1, 2))))
    return rows.withColumns({"TEXTO": text, "NIVEL": F.lit(fv.LEVEL_INFO)})


def top_drivers(rows, keys, k: int = 5):
    """The k variables that move the probability most, with signed percentage points."""
    # As in ``shocked_rows``, the outer form keeps the impacts above the joins that choose the rows.
    listed = F.posexplode_outer(F.slice(by_size(F.col("IMPACTOS")), 1, k)).alias("i", "x")
    table = constant_map(fv.DISPLAY_NAMES)
    return rows.select(*keys, listed).filter(F.col("i").isNotNull()).select(
        *keys, (F.col("i") + 1).alias("POSICAO"), F.col("x.VARIAVEL").alias("VARIAVEL"),
        F.coalesce(F.element_at(table, F.col("x.VARIAVEL")), F.col("x.VARIAVEL")).alias("ROTULO"),
        _fill("%+.1f", F.col("x.IMPACTO") * 100).alias("PONTOS"))


CONTEXT_COLUMNS = [
    "ANO", "UNIDADE", "CURSO", "FAIXA_MAT", "MAT_PAG", "QTD_CONC", "QTD_EMPRESAS",
    "SALDO_EMPREGO", "SALARIO_MEDIO",
]


def context_table(panel, unit=None, course=None, year=None, names=None):
    """Historical context of a selection under display names, by year."""
    chosen = choose(panel, UNIDADE=unit, CURSO=course, ANO=year)
    rounded = chosen.withColumn("SALARIO_MEDIO", F.round("SALARIO_MEDIO", 2))
    return (rounded.select(*CONTEXT_COLUMNS).orderBy("ANO")
            .withColumnsRenamed(fv.DISPLAY_NAMES if names is None else names))


def recommendation_table(panel, scorer, units=None, simulated=None,
                         headers=("Base", "Conservador", "Otimista", "Simulado"),
                         year=fv.FUTURE_YEAR):
    """One row per course: its recommendation under each scenario and in the what-if.

    A course takes the first chosen unit, in order of appearance in the panel.
    ``simulated`` holds ``CURSO`` and ``RECOM_SIMULADO``; headers without a column behind
    them are left out.
    """
    matrix = future_matrix(panel, scorer, year, units=units)
    ranked = matrix.join(appearance(panel, "UNIDADE", LAST), "UNIDADE")
    wide = (ranked.groupBy("CURSO").pivot("CENARIO", list(fv.SCENARIO_HEADERS))
            .agg(F.min_by("col_recom", "APARECIMENTO"))
            .withColumnsRenamed(fv.SCENARIO_HEADERS))
    if simulated is not None:
        wide = wide.join(simulated.select("CURSO", F.col("RECOM_SIMULADO").alias(fv.WHATIF_HEADER)),
                         "CURSO", "left")
    shown = [h for h in headers if h in wide.columns]
    return wide.select(F.col("CURSO").alias(fv.COURSE_HEADER), *shown).orderBy(fv.COURSE_HEADER)


def band_profile(panel):
    """Rows and share of each band."""
    counts = panel.groupBy("FAIXA_MAT").agg(F.count("*").alias("N"))
    listed = counts.agg(F.collect_list(F.struct("FAIXA_MAT", "N")).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x["N"])
    return listed.select(total.alias("t"), F.explode("c").alias("x")).select(
        "x.FAIXA_MAT", "x.N", (F.col("x.N") / F.col("t")).alias("PARTE"))
