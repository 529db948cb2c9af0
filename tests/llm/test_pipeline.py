"""The pipeline's stages, each on what the one before it kept, and the registered queries."""

import pytest

import __spark_entry__
import corpus_pipeline
from turmalina.llm import decontamination, ngram_jaccard_join, pii
from turmalina.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs = written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
    assert kept["language_id"].count() == 200  # clean documents stay
    comps = ngram_jaccard_join.jaccard_components(kept["language_id"], width=5, percent=80)
    assert ({r.doc_id for r in kept["near_duplicates"].collect()}
            == {r.component_id for r in comps.select("component_id").distinct().collect()})
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.report(kept["decontamination"], items).filter("contaminated").count() == 0
    before = {r.doc_id: r.text for r in kept["decontamination"].collect()}
    for r in kept["personal_data"].collect():
        assert (r.text == before[r.doc_id]) == (not pii.base_spans(before[r.doc_id]))
    assert ({r.doc_id for r in kept["packing"].select("doc_id").distinct().collect()} == set(before))


@pytest.mark.parametrize("rows", [0, 1])
def test_small_tables(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert (docs.count() > 0) == (rows > 0)


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_near_duplicates_by_five_words_and_080(spark):
    """The stage keeps what comparing all pairs at its own values keeps."""
    base = [f"w{i}" for i in range(200)]
    rows = [(d, " ".join(base + [f"x{i}" for i in range(more)])) for d, more in enumerate((0, 40, 60, 120))]
    other = [f"v{i}" for i in range(200)]
    rows += [(10, " ".join(other)), (11, " ".join(w if i % 30 else "y" for i, w in enumerate(other)))]
    sets = {d: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = {d: group[a] if g == group[b] else g for d, g in group.items()}
    assert group[0] == group[1]  # 0.83
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(d for d in group if group[d] == g) for g in group.values()})
