"""Every stage of the pipeline alone, on rows with nulls, empty and very long texts, repeats, ties and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import AWKWARD, documents

LABELS = "doc_id long, quality int, toxic int"
PLAIN = [(100 + i, f"the river runs {i} miles past stone {i % 7} and the tree number {i * 3}", "en", f"s{i % 3}") for i in range(40)]
ODD = [*AWKWARD, (4, "same words in the same order here", "de", "s"), (4, "other words under the same id", "en", None), *PLAIN]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    labels = [(r[0], int(r[0] % 4 != 0), 0) for r in PLAIN] + [(None, 1, 1), (4, None, None), (999, 0, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, folder, name, stage, extra):
    docs = documents(spark, ODD, extra)
    found = stage(spark, docs, folder)
    rows = found.collect()
    if stage is corpus_pipeline.packing:
        # One first piece for each row, repeats included, told apart by `row`.
        assert sum(r["piece"] == 0 for r in rows) == len(ODD) and len({(r["row"], r["piece"]) for r in rows}) == len(rows)
    else:
        assert found.columns == docs.columns
        assert not extra or {r["block"] for r in rows} <= {"clash"}
        texts = {r[1] for r in ODD}
        if stage is not corpus_pipeline.mixing:
            assert {r["text"] for r in rows} <= texts and len(rows) <= len(ODD)
    if stage is corpus_pipeline.language:
        assert {1, 2, 3, 6}.isdisjoint(r["doc_id"] for r in rows) and sum(r["doc_id"] is None for r in rows) == 1
    if stage is corpus_pipeline.near_duplicates:
        # The empty ones are one group, the repeats another; what has no like stays.
        assert [r["doc_id"] for r in rows].count(4) == 2 and {5, 2, 3}.isdisjoint(r["doc_id"] for r in rows) and {1, 7, 8, 9, None} <= {r["doc_id"] for r in rows}
    if stage is corpus_pipeline.mixing:
        assert {1, 2, 3}.isdisjoint(r["doc_id"] for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, folder, name, stage):
    docs = documents(spark, [], True)
    found = stage(spark, docs, folder)
    assert found.count() == 0 and (stage is corpus_pipeline.packing or found.columns == docs.columns)


def test_reruns_agree(spark, folder):
    """Rows in another order and other partitions give the same documents."""
    docs = documents(spark, ODD)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.mixing):
        key = lambda r: repr(tuple(r))
        one, two = (sorted(map(key, stage(spark, d, folder).collect())) for d in (docs, docs.orderBy(F.desc("text")).repartition(3, "lang")))
        assert one == two
