"""Training and use of the band classifier."""

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from turmalina.operators.encoding import category_places, category_table, encode, encode_out_of_fold, with_fold
from turmalina.operators.split import in_digest_order, stratified_split, with_class_weight
from turmalina.plans.scoring import with_features
from turmalina.schemas import CATEGORICAL, NUMERIC, PANEL_KEYS
from turmalina.sources.tables import load_model, save_model, work_path, written

LABEL = "FAIXA_MAT"
SIDE_BY_SIDE = 2_000_000  # training rows up to which the bands are fitted at the same time


@dataclass
class TrainingOptions:
    """Model inputs and learner settings."""

    categorical: list = field(default_factory=lambda: list(CATEGORICAL))
    numeric: list = field(default_factory=lambda: list(NUMERIC))
    learner: str = "boosted"
    rounds: int = 1000
    rate: float = 0.006
    depth: int = 4
    min_rows: int = 2
    bins: int = 64
    smoothing: float = 10.0
    row_share: float = 0.95
    column_share: float = 0.95
    test_share: float = 0.2
    seed: int = 123


class CategorySlots(Transformer):
    """Adds ``_<column>_p``, the slot of a row's category: its place in the alphabet from 0, and 0
    for one that is not listed or null.  The places are a table that rows are joined with."""

    def __init__(self, tables):
        super().__init__()
        self.tables = tables
        self.sizes = {c: table.count() for c, table in tables.items()}

    @property
    def labelsArray(self):
        """All categories of each column on the driver, last first: for looking at small tables."""
        return [[r[0] for r in table.orderBy(F.desc("POSICAO")).select("VALOR").collect()]
                for table in self.tables.values()]

    def _transform(self, df):
        for c, table in self.tables.items():
            rows = df.alias("l").join(table.alias("r"), F.col(f"l.`{c}`").cast("string") == F.col("r.VALOR"), "left")
            df = rows.select("l.*", F.coalesce("r.POSICAO", F.lit(0)).cast("int").alias(f"_{c}_p"))
        return df


class SlotVector(Transformer):
    """Adds ``features``: the numeric inputs, then one slot per category but the first.  The vector
    is sparse, and its column tells the number of slots without a name for each."""

    def __init__(self, numeric, sizes):
        super().__init__()
        self.numeric, self.columns, self.starts, self.size = list(numeric), list(sizes), [], len(numeric)
        for n in sizes.values():
            self.starts.append(self.size - 1)
            self.size += max(n - 1, 0)

    def _transform(self, df):
        starts, size = self.starts, self.size

        def vector(numbers, slots):
            if any(x is None or x != x for x in numbers):
                raise ValueError("a numeric input is null or NaN")
            held = {i: x for i, x in enumerate(numbers) if x}
            return SparseVector(size, held | {start + p: 1.0 for start, p in zip(starts, slots) if p})

        numbers = F.array(*[F.col(c).cast("double") for c in self.numeric])
        slots = F.array(*[F.col(f"_{c}_p") for c in self.columns])
        return df.withColumn("features", F.udf(vector, VectorUDT())(numbers, slots)) \
            .withMetadata("features", {"ml_attr": {"num_attrs": size}})


def fit_features(rows, options):
    """Fitted one-hot stages: numeric inputs, then one slot per category but the first.  The
    learner takes label shares instead, whose number doesn't grow with the categories.

    A category unseen in training encodes like the first one, as all zeros.
    """
    slots = CategorySlots({c: category_places(rows, c) for c in options.categorical})
    return [slots, SlotVector(options.numeric, slots.sizes)]


def one_hot_slot(stages, column):
    """Slot of a row's category among the column's slots, from 1; 0 for the first or an unseen
    one.  ``stages`` are those of ``fit_features``."""
    return F.col(f"_{column}_p")


def _learner(options):
    common = dict(labelCol="label", featuresCol="features", weightCol="PESO",
                  maxDepth=options.depth, minInstancesPerNode=options.min_rows,
                  subsamplingRate=options.row_share, maxBins=options.bins, seed=options.seed)
    if options.learner == "forest":
        return RandomForestClassifier(numTrees=options.rounds, **common)
    if options.learner != "boosted":
        raise ValueError("learner is 'boosted' or 'forest'")
    trees = GBTClassifier(maxIter=options.rounds, stepSize=options.rate,
                          featureSubsetStrategy=str(options.column_share), **common)
    return trees


def split_panel(panel, options=None):
    options = options or TrainingOptions()
    return stratified_split(panel, LABEL, PANEL_KEYS, options.test_share, options.seed)


def _inputs(numeric, categorical, size):
    return [*numeric, *[f"_{c}_{k}" for c in categorical for k in range(size)]]


def train(panel, options=None):
    """Fit the classifier on the training part of the panel.

    A category enters as the label shares of its training rows (``operators.encoding``), out of
    fold for the training rows themselves, so a tree looks at a few bins per column however many
    courses there are.  The trees see balanced class weights.  Boosting is one binary fit per
    band; all read one written copy of the encoded rows.  A fit caches its rows several times over,
    so the fits of a large panel follow one another and those of a small one run side by side.
    The split rows are written first, so the panel is split and put in order once.
    """
    options = options or TrainingOptions()
    rows = with_features(panel, options.numeric)
    spark = rows.sparkSession
    labels = StringIndexer(inputCol=LABEL, outputCol="label",
                           stringOrderType="alphabetAsc").fit(rows)
    size = len(labels.labels)
    if size < 2:
        raise ValueError("the panel holds one band only; nothing can be learnt")
    learner = _learner(options)
    needed = list(dict.fromkeys([*PANEL_KEYS, LABEL, *options.categorical, *options.numeric]))
    split = in_digest_order(split_panel(rows, options).select(*needed, "E_TESTE"), LABEL, PANEL_KEYS, options.seed)
    training = written(split, "training").filter("NOT E_TESTE").drop("E_TESTE")
    training = with_fold(with_class_weight(training, LABEL), PANEL_KEYS, seed=options.seed)
    tables = {c: written(category_table(training, c, LABEL, labels.labels, options.smoothing), f"categories-{c}")
              for c in options.categorical}
    encoded = training
    for c, table in tables.items():
        encoded = encode_out_of_fold(encoded, table, c, f"_{c}_", size, options.smoothing)
    assembler = VectorAssembler(inputCols=_inputs(options.numeric, options.categorical, size), outputCol="features")
    encoded = written(PipelineModel([labels, assembler]).transform(encoded).select("label", "features", "PESO"),
                      "encoded")
    if options.learner == "boosted":
        learner = OneVsRest(classifier=learner, labelCol="label", featuresCol="features",
                            weightCol="PESO", parallelism=size if encoded.count() <= SIDE_BY_SIDE else 1)
    tables = {c: table.select("VALOR", "PARTES") for c, table in tables.items()}
    return BandModel(PipelineModel([labels, assembler, learner.fit(encoded)]), tables, spark)


class BandModel:
    """A fitted classifier as a scorer."""

    def __init__(self, pipeline, tables, spark):
        self.pipeline, self.tables = pipeline, tables
        self.classes = list(pipeline.stages[0].labels)
        self.numeric = [c for c in pipeline.stages[1].getInputCols() if not c.startswith("_")]
        # A category that was not learnt counts as the first one, as where all its slots are zero.
        self.absent = {c: F.array(*map(F.lit, table.agg(F.min_by("PARTES", "VALOR")).first()[0]))
                       for c, table in tables.items()}

    def prepare(self, df):
        """Rows with the label shares of their categories, which many scorings can share."""
        for c, table in self.tables.items():
            if f"_{c}_0" not in df.columns:
                df = encode(df, table, c, f"_{c}_", len(self.classes), self.absent[c])
        return df

    def features(self, df):
        """Rows with the assembled ``features`` vector."""
        return self.pipeline.stages[1].transform(self.prepare(with_features(df, self.numeric)))

    def score(self, df):
        """Add ``PROBS``, one probability per class, summing to 1."""
        rows, model = self.features(df), self.pipeline.stages[-1]
        if isinstance(model, OneVsRestModel):
            for k, binary in enumerate(model.models):
                one = binary.copy().setProbabilityCol(f"_p{k}").setRawPredictionCol("") \
                    .setPredictionCol("")
                rows = one.transform(rows)
            raw = F.array(*[vector_to_array(F.col(f"_p{k}"))[1] for k in range(len(self.classes))])
        else:
            rows = model.copy().setProbabilityCol("_p").setRawPredictionCol("") \
                .setPredictionCol("").transform(rows)
            raw = vector_to_array(F.col("_p"))
        rows = rows.withColumn("_raw", raw)
        parts = [F.col("_raw")[k] for k in range(len(self.classes))]
        rows = rows.withColumn("_total", reduce(lambda a, b: a + b, parts, F.lit(0.0)))
        return rows.withColumn("PROBS", F.array(*[x / F.col("_total") for x in parts])).select(*df.columns, "PROBS")

    def save(self, path):
        save_model(self.pipeline, f"{path}/pipeline")
        for c, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/categories/{c}")

    @classmethod
    def load(cls, path, spark=None):
        spark = spark or SparkSession.active()
        pipeline = load_model(f"{path}/pipeline")
        coded = dict.fromkeys(c[1:].rsplit("_", 1)[0] for c in pipeline.stages[1].getInputCols() if c.startswith("_"))
        return cls(pipeline, {c: spark.read.parquet(f"{path}/categories/{c}") for c in coded}, spark)


def _share_loss(rows):
    """A column: the loss of always telling the class shares of the training part."""
    # One entry per class.
    shares = rows.filter("NOT E_TESTE").groupBy(LABEL).agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct(LABEL, "n"))).alias("m"),
        F.sum("n").alias("t")).select(F.struct("m", "t")).scalar()
    return shares, F.element_at(F.col("_s.m"), F.col(LABEL)) / F.col("_s.t")


def _loss(p):
    return -F.ln(F.greatest(p, F.lit(1e-15)))


def evaluate(panel, model, options=None):
    """Log-loss on the held-out part, beside that of always telling the class shares."""
    rows = split_panel(panel, options)
    shares, prior = _share_loss(rows)
    names = F.array(*[F.lit(c) for c in model.classes])
    scored = model.score(rows.filter("E_TESTE")).withColumn("_s", shares)
    told = F.element_at("PROBS", F.array_position(names, F.col(LABEL)).cast("int"))
    return scored.agg(F.count("*").alias("N_TESTE"), F.avg(_loss(told)).alias("LOGLOSS"),
                      F.avg(_loss(prior)).alias("LOGLOSS_PARTES"))


def boosted_trees(model):
    """The trees of a boosted model as a table: class, round, tree weight, and the nodes."""
    binaries = model.pipeline.stages[-1]
    if not isinstance(binaries, OneVsRestModel):
        raise ValueError("only a boosted model has rounds")
    tables = []
    for k, binary in enumerate(binaries.models):
        spark = SparkSession.active()
        path = work_path(spark, f"trees-{k}")
        binary.write().overwrite().save(path)
        nodes = spark.read.parquet(f"{path}/data").groupBy("treeID").agg(F.array_sort(F.collect_list(F.struct(
            F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("value"),
            F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")))).alias("nodes"))
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "_meta", "weight")
        tables.append(nodes.join(weights, "treeID").select(F.lit(k).alias("k"), "treeID", "weight", "nodes"))
    return reduce(lambda a, b: a.union(b), tables)


def _tree_arrays(trees, size):
    """All rounds' trees as arrays, node by node; their size is rounds x classes x 2 ** depth."""
    trees = trees.orderBy("k", "treeID").collect()
    width = max(len(t["nodes"]) for t in trees)
    shape = (len(trees), width)
    out = {n: np.zeros(shape, np.int32) for n in ("feature", "left", "right")}
    out |= {n: np.zeros(shape) for n in ("threshold", "value")}
    for i, t in enumerate(trees):
        for n in t["nodes"]:
            at, leaf = (i, n["id"]), n["left"] < 0
            out["feature"][at], out["threshold"][at] = (0, 0) if leaf else (n["feature"], n["threshold"])
            out["left"][at], out["right"][at] = (n["id"], n["id"]) if leaf else (n["left"], n["right"])
            out["value"][at] = n["value"] * t["weight"]
    return out | {"size": size, "rounds": len(trees) // size, "depth": max(1, width.bit_length())}


def evaluate_rounds(panel, model, options=None):
    """One row per boosting round: test rows, log-loss after that round, and that of always
    telling the class shares.

    The test part is read once: a task follows the trees in order, keeps the running margins of
    its rows, and hands on one sum per round.
    """
    rows = split_panel(panel, options)
    spark = rows.sparkSession
    shares, prior = _share_loss(rows)
    trees = spark.sparkContext.broadcast(_tree_arrays(boosted_trees(model), len(model.classes)))
    names = F.array(*[F.lit(c) for c in model.classes])
    test = model.features(rows.filter("E_TESTE")).withColumn("_s", shares).select(
        vector_to_array("features").alias("features"), _loss(prior).alias("prior"),
        (F.array_position(names, F.col(LABEL)) - 1).cast("int").alias("label"))

    def losses(t, features, label):
        """The rows' summed log-loss after each round."""
        rows, loss = np.arange(len(features)), []
        margin = np.zeros((t["size"], len(features)))
        for r in range(t["rounds"]):
            for k in range(t["size"]):
                i, at = k * t["rounds"] + r, np.zeros(len(features), np.int32)
                for _ in range(t["depth"]):
                    low = features[rows, t["feature"][i][at]] <= t["threshold"][i][at]
                    at = np.where(low, t["left"][i][at], t["right"][i][at])
                margin[k] += t["value"][i][at]
            raw = 1 / (1 + np.exp(-2 * margin))
            loss.append(-np.log(np.maximum(raw[label, rows] / raw.sum(0), 1e-15)).sum())
        return loss

    # The tasks' functions and data need no module of this package.
    def staged(batches):
        for batch in batches:
            if batch.num_rows:
                features = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
                loss = losses(trees.value, features, batch.column("label").to_numpy())
                n = len(loss)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(1, n + 1), pa.int32()), pa.array([batch.num_rows] * n, pa.int64()), pa.array(loss),
                     pa.array([float(np.sum(batch.column("prior").to_numpy()))] * n)], ["RODADA", "n", "loss", "prior"])

    sums = test.mapInArrow(staged, "RODADA int, n bigint, loss double, prior double")
    return sums.groupBy("RODADA").agg(
        F.sum("n").alias("N_TESTE"), (F.sum("loss") / F.sum("n")).alias("LOGLOSS"),
        (F.sum("prior") / F.sum("n")).alias("LOGLOSS_PARTES"))
