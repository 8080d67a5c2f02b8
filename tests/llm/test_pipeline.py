"""The pipeline's stages one by one against plain versions of their decisions."""

import corpus_pipeline
import pytest

from linkloom.llm import exact, quality, secrets, simhash
from linkloom.llm.queries import secret_model

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows that every stage got and gave, each written and read again."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    work = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{work}/{name}")
        given = docs
        docs = spark.read.parquet(f"{work}/{name}")
        out.append((name, given, docs))
    return out


def test_stages(spark, steps):
    names = [n for n, _, _ in steps]
    assert names == ["quality", "exact", "near", "secrets", "pack"]
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(d.columns == columns for _, _, d in steps[:-1])
    ids = [{r.doc_id for r in d.collect()} for _, _, d in steps]
    _, given, _ = steps[0]
    model = quality.fit(given, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert ids[0] == {r.doc_id for r in quality.score(given, model).filter("score >= 0.3").collect()}
    last: dict[bytes, int] = {}
    for r in steps[1][1].collect():
        key = r.text.encode().lower()
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert ids[1] == {*last.values()}
    groups = simhash.near_groups(steps[2][1]).collect()
    assert ids[2] == {r.component_id for r in groups} and len(groups) == len(ids[1])
    before = {r.doc_id: r.text for r in steps[3][1].collect()}
    known, forest = secret_model(steps[3][1])
    bad = {r.doc_id for r in secrets.scan(steps[3][1], known, forest).filter("is_secret").collect()}
    after = {r.doc_id: r.text for r in steps[3][2].collect()}
    assert ids[3] == ids[2] == ids[4] and bad == {i for i in before if before[i] != after[i]} and bad
    assert all("[SECRET]" in after[i] for i in bad)


def test_clean_labelled_documents_stay(spark, steps):
    marks = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1").collect()}
    kept = {r.doc_id for r in steps[0][2].collect()}
    given = {r.doc_id for r in steps[0][1].collect()}
    assert len(marks & given & kept) >= 0.99 * len(marks & given)
    assert exact.exact_groups(steps[1][2]).filter("group_size > 1").count() == 0


def test_run(spark, steps):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == steps[-1][2].columns
    assert rows.count() == steps[-1][2].count()
