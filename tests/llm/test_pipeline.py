"""The pipeline's stages, each judged on its own input, and the registered queries on the test tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe, mixing, quality, secrets
from factloom.llm.queries import ORACLES, QUERIES
from test_near_copies import kept_by_jaccard

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, docs, tokenizer):
    columns = docs.columns
    now = docs.where("doc_id is not null")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, "").persist()
        if name == "quality rules":
            kept = {r.id for r in quality.quality_rules(now).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept and {100 + 10 * n for n in range(12)} <= kept
        elif name == "simhash near-dedup":
            # five-word Jaccard similarity, as stages on word shingles take it where no contract says otherwise
            assert sorted(r.doc_id for r in out.collect()) == kept_by_jaccard([(r.doc_id, r.text) for r in now.collect()])
            assert not {102 + 10 * n for n in range(12)} & {r.doc_id for r in out.collect()}
        elif name == "secret scans":
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in now.collect())
            assert secrets.secret_spans(out).where("size(spans) > 0").count() == 0
            clean = {r.id for r in secrets.secret_spans(now).where("size(spans) = 0").collect()}
            before = {r.doc_id: r.text for r in now.collect()}
            assert all(r.text == before[r.doc_id] for r in out.collect() if r.doc_id in clean)
        elif name == "source mixing":
            uses = Counter(r.id for r in mixing.mix(spark, now).collect())
            assert Counter(r.doc_id for r in out.collect()) == uses and set(uses) == {r.doc_id for r in now.collect()}
        else:
            own = bpe.loaded(bpe.read_spec(tokenizer))
            texts = {r.doc_id: r.text for r in now.collect()}
            assert all(bytes(r.ids) == own.encode_bytes(texts[r.doc_id]) and r.n_tokens == len(r.ids) // 4 for r in out.collect())
            assert out.count() == now.count()
            return
        assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        now = out


def test_an_empty_corpus_goes_through(spark, docs, tokenizer):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    import duckdb

    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    found = duckdb.sql(ORACLES[name])
    order = sorted(df.columns)
    assert sorted(found.columns) == order
    got = Counter(tuple(r[c] for c in order) for r in df.collect())
    at = [found.columns.index(c) for c in order]
    assert got == Counter(tuple(r[i] for i in at) for r in found.fetchall()) and got


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_rows_of_clashing_names_come_back(spark, clashing):
    out = corpus_pipeline.quality(spark, clashing, "")
    assert out.columns == clashing.columns and out.where(F.col("row") != "clash").count() == 0


def test_staged_tables_can_be_removed(spark, docs):
    from factloom.llm import _common

    out = _common.staged(spark, docs.select("doc_id"), "x")
    assert out.count() == docs.count() and _common.run_dir(spark).startswith(_common.shared_dir(spark))
    _common.clean(spark)
    assert not os.path.exists(_common.run_dir(spark).removeprefix("file://"))


def test_a_run_leaves_only_what_its_result_reads(spark, docs, tokenizer, tmp_path):
    from factloom.llm import _common

    _common.clean(spark)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.count() > 0
    left = {os.path.basename(f) for f in os.listdir(_common.run_dir(spark).removeprefix("file://"))}
    assert not any(x.startswith(("pipeline-1", "pipeline-2", "pipeline-3", "nodes", "shared")) for x in left) and any(x.startswith("pipeline-4") for x in left)
