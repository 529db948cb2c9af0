"""A fixed scorer whose probabilities plain SQL can repeat."""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv


class LinearScorer:
    """Softmax of fixed linear scores, written as Columns.

    ``weights`` gives for each class ``(bias, {variable: weight}, unit weight, course
    weight)``; a variable enters as ``x / (|x| + scale)``, names by their length.
    """

    def __init__(self, classes, scales, weights, unit_mod=5, course_mod=7):
        self.classes, self.scales, self.weights = list(classes), scales, weights
        self.unit_mod, self.course_mod = unit_mod, course_mod

    def score(self, df):
        unit = F.length("UNIDADE") % self.unit_mod
        course = F.length("CURSO") % self.course_mod
        rows = df.withColumn("_z", F.array(*[
            F.coalesce(F.col(v).cast("double") / (F.abs(F.col(v).cast("double")) + s), F.lit(0.0))
            for v, s in self.scales.items()]))
        raw = []
        for bias, linear, by_unit, by_course in self.weights:
            total = F.lit(float(bias)) + unit * by_unit + course * by_course
            for i, v in enumerate(self.scales):
                if v in linear:
                    total = total + F.col("_z")[i] * linear[v]
            raw.append(F.exp(total))
        rows = rows.withColumn("_e", F.array(*raw))
        total = sum((F.col("_e")[k] for k in range(1, len(raw))), F.col("_e")[0])
        return rows.withColumn("_s", total).withColumn(
            "PROBS", F.transform("_e", lambda x: x / F.col("_s"))).drop("_z", "_e", "_s")


SCALES = {
    "ANO": 2000.0, "QTD_EMPRESAS": 50.0, "QTD_CONC": 5.0, "SALARIO_MEDIO": 100000.0,
    "SALDO_EMPREGO": 20.0, "VLR_MEDIO_BENEFICIO": 3000.0,
}
CLASSES = [fv.BAND_LOW, fv.BAND_HIGH, fv.BAND_MID]
WEIGHTS = [
    (0.3, {"ANO": 0.4, "QTD_EMPRESAS": -0.8, "QTD_CONC": 2.0, "SALDO_EMPREGO": -0.9}, 0.05, 0.10),
    (-1.2, {"ANO": 1.1, "QTD_EMPRESAS": 1.6, "QTD_CONC": -1.5, "SALARIO_MEDIO": 0.7,
            "SALDO_EMPREGO": 1.2, "VLR_MEDIO_BENEFICIO": -0.6}, 0.25, 0.15),
    (0.1, {"QTD_CONC": 0.4, "SALARIO_MEDIO": 0.9, "VLR_MEDIO_BENEFICIO": 0.5}, 0.10, 0.05),
]


def fixed_scorer():
    return LinearScorer(CLASSES, SCALES, WEIGHTS)
