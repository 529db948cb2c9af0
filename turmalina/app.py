"""The three steps as jobs: build the panel, train the classifier, write the analysis.

    python -m turmalina.app panel   FEEDS_DIR PANEL_DIR [--ready READY_DIR] [--year Y ...]
    python -m turmalina.app train   PANEL_DIR MODEL_DIR [--rounds 1000] [--rate 0.006]
    python -m turmalina.app analyse PANEL_DIR MODEL_DIR OUT_DIR [--year 2026]
                                    [--unit U [--course C] [--edit MEASURE=VALUE ...]]

``FEEDS_DIR`` holds one table per feed, named as in ``schemas.FEED_SCHEMAS``.  ``READY_DIR`` holds
feeds conformed before (``job_links``, ``establishments``, ``job_flow``, ``census_competitors``,
``benefit``; any of them), as one Parquet table each: they are taken as they are, and their raw
feeds need not exist.  With ``--year`` the panel's folders of those years are rebuilt and the others
stay.  With ``--unit`` the tables of one selection are written as well, under
``OUT_DIR/selection``: its real and what-if case, context, drivers and recommendations.
"""

import argparse
import os

from pyspark.sql import SparkSession

from turmalina.functions import fixed_values as fv
from turmalina.plans import catalogue, competitors, enrolment, geography, labour, scenario, whatif
from turmalina.plans.analysis import selection_report
from turmalina.plans.decision import executive_real, recommendation_table
from turmalina.plans.panel import build_panel
from turmalina.plans.scoring import score, sensitivity, with_features, with_impacts
from turmalina.plans.training import BandModel, TrainingOptions, train
from turmalina.schemas import CATEGORICAL, EDITABLE, FEED_SCHEMAS, NUMERIC
from turmalina.session import SETTINGS
from turmalina.sources.tables import (
    conform, read_panel, read_table, trim_column_names, union_by_name, write_panel)


# The conformed feeds, and the raw feed that each is made of.
CONFORMED = {
    "job_links": "job_links_raw", "establishments": "establishments_raw", "job_flow": "job_flow_raw",
    "census_competitors": "school_census_raw", "benefit": "benefit_raw",
}


def read_feeds(spark, folder, fmt="parquet", without=()):
    """Every feed of the folder but those ``without``, conformed to its schema.

    The files of a Parquet feed may differ in columns; a column that no file has is null.
    """
    feeds = {}
    for name, schema in FEED_SCHEMAS.items():
        if name == "itinerary" or name in without:
            continue
        options = {"mergeSchema": "true"} if fmt == "parquet" else {"schema": schema}
        feeds[name] = conform(read_table(spark, os.path.join(folder, name), fmt=fmt, **options), schema)
    return feeds


def read_ready(spark, folder):
    """The conformed feeds that the folder holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    held = {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    unknown = held - set(CONFORMED)
    if unknown:
        raise ValueError(f"not a conformed feed: {sorted(unknown)}")
    return {name: trim_column_names(read_table(spark, os.path.join(folder, name))) for name in sorted(held)}


def panel_from_feeds(feeds, ready=None, dedupe=False):
    """The panel from raw feeds; ``ready`` holds feeds conformed before."""
    ready = ready or {}
    municipality = geography.municipality_dimension(feeds["municipality_unit"])
    territory = feeds["territory"]

    def conformed(name, job):
        return ready[name] if name in ready else job(feeds[CONFORMED[name]], territory, municipality)

    census = conformed("census_competitors", competitors.census_competitors)
    scraped = competitors.scraped_competitors(feeds["competitors_scraped"], municipality)
    return build_panel(
        enrolment.enrolments(feeds["enrolment_cube"], municipality),
        conformed("establishments", labour.establishments),
        catalogue.course_occupation(feeds["course_catalogue"]),
        conformed("job_flow", labour.job_flow),
        conformed("job_links", labour.job_links),
        union_by_name(census, scraped),
        conformed("benefit", labour.family_benefit), dedupe)


def write_analysis(panel, scorer, out, year=fv.FUTURE_YEAR):
    """History, sensitivity, status, future matrix and recommendations of every selection."""
    real = whatif.real_rows(panel)
    scored = score(with_features(real), scorer)
    lean = scored.select(*CATEGORICAL, *NUMERIC, "PROBS", "FAIXA_IDX", "FAIXA_DOMINANTE", "PROB_MAX")
    keys = ["UNIDADE", "CURSO"]
    tables = {
        "history": scenario.probability_history(panel, scorer),
        "sensitivity": sensitivity(real, scorer, keys),
        "status": executive_real(with_impacts(lean, scorer)).drop("PROBS", "IMPACTOS"),
        "future": scenario.future_matrix(panel, scorer, year),
        "recommendations": recommendation_table(panel, scorer, year=year),
    }
    write_tables(tables, out)


def write_tables(tables, out):
    """Each table under its name; Parquet takes no blanks in column names."""
    for name, df in tables.items():
        df.withColumnsRenamed({c: c.replace(" ", "_").replace("(", "").replace(")", "") for c in df.columns}) \
            .write.mode("overwrite").parquet(os.path.join(out, name))


def edits_of(texts):
    """``MEASURE=VALUE`` texts as a dict."""
    edits = {}
    for text in texts or ():
        name, _, value = text.partition("=")
        if name not in EDITABLE:
            raise ValueError(f"{name} cannot be edited; choose from {EDITABLE}")
        edits[name] = float(value)
    return edits


def main(argv=None):
    parser = argparse.ArgumentParser(prog="turmalina")
    steps = parser.add_subparsers(dest="step", required=True)
    for name, paths in (("panel", ["feeds", "panel"]), ("train", ["panel", "model"]),
                        ("analyse", ["panel", "model", "out"])):
        step = steps.add_parser(name)
        for path in paths:
            step.add_argument(path)
        if name == "panel":
            step.add_argument("--format", default="parquet")
            step.add_argument("--dedupe", action="store_true")
            step.add_argument("--ready", help="folder of conformed feeds")
            step.add_argument("--year", type=int, action="append", help="rebuild this year's folder only")
        if name == "train":
            step.add_argument("--rounds", type=int, default=TrainingOptions.rounds)
            step.add_argument("--rate", type=float, default=TrainingOptions.rate)
            step.add_argument("--learner", default=TrainingOptions.learner)
        if name == "analyse":
            step.add_argument("--year", type=int, default=fv.FUTURE_YEAR)
            step.add_argument("--unit")
            step.add_argument("--course", default=scenario.GLOBAL)
            step.add_argument("--edit", action="append", metavar="MEASURE=VALUE")
    args = parser.parse_args(argv)

    builder = SparkSession.builder.appName(f"turmalina-{args.step}")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if args.step == "panel":
        ready = read_ready(spark, args.ready) if args.ready else {}
        feeds = read_feeds(spark, args.feeds, args.format, without={CONFORMED[name] for name in ready})
        write_panel(panel_from_feeds(feeds, ready, args.dedupe), args.panel, args.year)
    elif args.step == "train":
        train(read_panel(spark, args.panel),
              TrainingOptions(rounds=args.rounds, rate=args.rate, learner=args.learner)).save(args.model)
    else:
        panel, model = read_panel(spark, args.panel), BandModel.load(args.model)
        write_analysis(panel, model, args.out, args.year)
        if args.unit:
            write_tables(selection_report(panel, model, args.unit, args.course, edits=edits_of(args.edit),
                                          future_year=args.year), os.path.join(args.out, "selection"))


if __name__ == "__main__":
    main()
