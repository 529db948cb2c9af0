import random

import pytest
from test_training import PANEL

import __spark_entry__
from turmalina import app
from turmalina.fixtures.scorer import fixed_scorer
from turmalina.fixtures.tables import Feeds
from turmalina.functions import fixed_values as fv
from turmalina.plans.analysis import selection_choices, selection_report
from turmalina.schemas import FEED_SCHEMAS
from turmalina.sources.tables import read_panel

SF = "/root/testdata/sf0.001"


def small_panel(spark):
    rng = random.Random(3)
    bands = [fv.BAND_LOW, fv.BAND_MID, fv.BAND_HIGH]
    rows = [(2022 + y, f"C{c}", f"U{u}", 5, 10 * b + rng.randint(0, 5), rng.randint(1, 40), rng.randint(-5, 5),
             900.0 + c, 50.0, bands[b]) for y in range(3) for c in range(6) for u in range(4)
            for b in [(c + u) % 3]]
    return spark.createDataFrame(rows, PANEL)


@pytest.fixture(scope="module")
def feeds_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feeds")
    feeds = Feeds(spark, SF)
    for name in FEED_SCHEMAS:
        getattr(feeds, name)().write.parquet(str(folder / name))
    return str(folder)


def test_panel_job_from_raw_feeds(spark, feeds_dir, tmp_path):
    app.main(["panel", feeds_dir, str(tmp_path / "panel")])
    got = read_panel(spark, str(tmp_path / "panel"))
    assert got.count() == __spark_entry__.queries()["panel"](spark, SF).count() > 0
    totals = got.groupBy().sum("MAT_PAG", "QTD_CONC").first()
    assert totals[0] > 0 and totals[1] > 0


def test_feeds_conformed_before_are_used(spark, feeds_dir):
    feeds = app.read_feeds(spark, feeds_dir)
    ready = spark.createDataFrame([(1996, "ASIA", 7)], "ANO int, UNIDADE string, QTD_EMPRESAS long")
    got = app.panel_from_feeds(feeds, {"establishments": ready}, dedupe=True)
    assert {(r.ANO, r.UNIDADE, r.QTD_EMPRESAS) for r in got.filter("QTD_EMPRESAS > 0").collect()} == {
        (1996, "ASIA", 7)}


def test_train_and_analyse_jobs(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("panel", "model", "out")]
    small_panel(spark).write.partitionBy("ANO").parquet(paths[0])
    app.main(["train", paths[0], paths[1], "--rounds", "2"])
    app.main(["analyse", *paths])
    counts = {n: spark.read.parquet(f"{paths[2]}/{n}").count()
              for n in ("history", "sensitivity", "status", "future", "recommendations")}
    assert counts == {"history": 72, "sensitivity": 144, "status": 24, "future": 72, "recommendations": 6}


def test_selection_report(spark):
    panel = small_panel(spark)
    report = selection_report(panel, fixed_scorer(), "U1", "C2", edits={"QTD_CONC": 3}, units=["U1", "U2"],
                              headers=("Simulado", "Base"))
    assert report["history"].count() == 3 and report["context"].count() == 3
    assert report["real"].count() == 1 and report["drivers"].count() == 5
    assert report["whatif"].first().QTD_CONC == 3.0
    assert report["recommendations"].columns == ["Curso Técnico", "Simulado", "Base"]
    assert report["recommendations"].count() == 6 and report["future"].count() == 36
    overall = selection_report(panel, fixed_scorer(), "U1")
    assert overall["real_status"].count() == 1 and overall["real"].first().CURSO == "C5"
    lists = selection_choices(panel, "U1", 2023)
    assert [r[0] for r in lists["years"].collect()] == [2022, 2023, 2024] and lists["courses"].count() == 6
