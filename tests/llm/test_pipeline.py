import importlib.util
import os
import re

import pytest

import corpus_pipeline
from rasterflow.llm import queries

from .conftest import make
from .test_text_ops import groups, hits, removed


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory, odd_docs):
    """Tables for the stages: odd documents, labels and a benchmark."""
    out = str(tmp_path_factory.mktemp("tables"))
    odd_docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, "own start"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_keep_columns_and_take_effect(spark, folder, odd_rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stage(name)(spark, docs, folder).dtypes == docs.dtypes, name
    pairs = [r[:2] for r in odd_rows]
    ids = lambda df: sorted((str(r.doc_id) for r in df.collect()))
    assert ids(stage("near_dedup")(spark, docs, folder)) == sorted(str(i) for i, _, _, kept in groups(pairs) if kept)
    assert ids(stage("decontamination")(spark, docs, folder)) == sorted(str(i) for i, _, n, _ in hits(pairs, [(1, "own start")]) if not n)
    lost = {str(i): n for i, _, n, _, _ in removed(pairs)}
    out = stage("suffix_dedup")(spark, docs, folder)
    assert all(len((r.text or "").encode()) == len((dict(pairs)[r.doc_id] or "").encode()) - lost[str(r.doc_id)] for r in out.collect() if r.doc_id in (1, 2, 3, 9, 10, 11))
    assert out.count() == len(odd_rows)


def test_run_passes_each_stage_what_the_one_before_kept(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(found.columns)
    ids = {r.doc_id for r in found.collect()}
    assert {1, 4, 5} <= ids and not {2, 3, 9} & ids


def test_stages_of_nothing(spark, no_docs, folder):
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, no_docs, folder).count() == 0, name


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    for name in queries.ORACLE_SQL:
        assert name in queries.QUERIES


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(importlib.util.find_spec("rasterflow").origin)
    for at, _, names in os.walk(root):
        if "llm" in os.path.relpath(at, root).split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                assert "llm" not in open(os.path.join(at, n), encoding="utf-8").read(), n


def test_repeated_rows_survive_near_dedup(spark):
    docs = make(spark, [(5, "a b c d e f", None)] * 2 + [(7, "a b c d e f", None)])
    assert [r.doc_id for r in stage("near_dedup")(spark, docs, "").collect()] == [5, 5]
