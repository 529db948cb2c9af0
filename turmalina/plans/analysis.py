"""Everything shown for one selection of unit, course and year, as tables."""

from turmalina.functions import fixed_values as fv
from turmalina.operators.latest import choices
from turmalina.plans import decision, scenario, whatif
from turmalina.plans.scoring import band_columns, score, with_features, with_impacts
from turmalina.schemas import CATEGORICAL, NUMERIC

KEYS = ["UNIDADE", "CURSO"]


def _lean(rows):
    return rows.select(*CATEGORICAL, *NUMERIC, "PROBS", "FAIXA_IDX", "FAIXA_DOMINANTE", "PROB_MAX")


def selection_choices(panel, unit=None, year=None):
    """Years, units of the chosen year, and courses of the chosen unit."""
    of_year = scenario.choose(panel, ANO=year)
    return {"years": choices(panel, "ANO"), "units": choices(of_year, "UNIDADE"),
            "courses": choices(scenario.choose(of_year, UNIDADE=unit), "CURSO")}


def selection_report(panel, scorer, unit, course=scenario.GLOBAL, year="TODOS", edits=None,
                     units=None, headers=("Simulado", "Otimista"), future_year=fv.FUTURE_YEAR,
                     fix_labels=False):
    """Named tables for one selection; nothing runs until one of them is read.

    ``edits`` are the what-if values; ``units`` and ``headers`` choose the recommendation
    table, by default for the selected unit.
    """
    per_course = course != scenario.GLOBAL
    picked = dict(unit=unit, course=course if per_course else None, per_course=per_course)
    real = score(with_features(whatif.real_rows(panel, **picked)), scorer)
    edited = whatif.apply_edits(whatif.real_rows(panel, **picked), edits)
    simulated = score(with_features(edited), scorer)
    real_impacts = with_impacts(_lean(real), scorer)
    sim_impacts = with_impacts(_lean(simulated), scorer)
    across = whatif.whatif_courses(panel, edited, scorer, future_year)
    return {
        "real": band_columns(real, scorer),
        "real_status": decision.executive_real(real_impacts, fix_labels=fix_labels)
        .select(*KEYS, "FAIXA_DOMINANTE", "PROB_MAX", "TEXTO", "NIVEL"),
        "history": scenario.probability_history(
            panel, scorer, unit, picked["course"], per_course).orderBy("ANO"),
        "context": decision.context_table(panel, unit, course, year),
        "whatif": band_columns(simulated, scorer),
        "whatif_status": decision.executive_whatif(sim_impacts)
        .select(*KEYS, "FAIXA_DOMINANTE", "PROB_MAX", "TEXTO", "NIVEL"),
        "drivers": decision.top_drivers(sim_impacts, KEYS).orderBy("POSICAO"),
        "recommendations": decision.recommendation_table(
            panel, scorer, units or [unit], across, headers, future_year),
        "future": scenario.future_matrix(panel, scorer, future_year, units=units or [unit]),
    }
