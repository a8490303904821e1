import duckdb
import pytest

import corpus_pipeline
from qualis.llm import queries

from . import cases
from .test_decontaminate import plain as contaminated
from .test_simhash import kept_ids

NAMES = {f"op{n}_" for n in range(1, 14)}


def test_one_query_for_each_operator():
    assert len(queries.QUERIES) == 13 and {q.split("_")[0] + "_" for q in queries.QUERIES} == NAMES
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "BPE encoding and decoding"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert cases.bag(got.select(*names).collect()) == cases.bag(want.fetchall())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = cases.texts()
    cases.docs(spark).write.parquet(f"{path}/documents.parquet")
    cases.bench(spark).write.parquet(f"{path}/benchmark.parquet")
    cases.labels(spark, [(d, int(not (t or "").startswith("same")), 0) for d, t in rows if d is not None]).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_after_another(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(out := str(tmp_path / str(k)))
        docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == cases.COLUMNS, name
        after = [(r.doc_id, getattr(r, "text", None)) for r in docs.collect()]
        if k == 0:
            assert set(after) <= set(before) and len(after) >= 0.8 * len(before)
        if k == 1:
            assert sorted(repr(d) for d, _ in after) == sorted(map(repr, kept_ids(before)))
            assert set(after) <= set(before)
        if k == 2:
            assert cases.bag(after) == cases.bag(x for x in before if not contaminated([x], cases.BENCH)[0][-1])
        if k in (3, 4):
            assert cases.bag((d,) for d, _ in after) == cases.bag((d,) for d, _ in before)
        if k == 3:
            assert not any("@mail.example.com" in (t or "") for _, t in after)


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_empty_documents(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    cases.bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    cases.labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
