"""Each stage on its own input, against plain versions."""

import re

import corpus_pipeline
import pytest

from ebbtide.llm import blobs
from ebbtide.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    work = Workspace(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(work.keep(stage(spark, out[-1], SF)))
    return out


def test_all_stages_but_the_last_return_documents(steps):
    assert [s.columns for s in steps[:-1]] == [steps[0].columns] * 5
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_each_stage_does_its_part(steps):
    docs, clean, single, masked, mixed, packed = steps
    assert clean.subtract(docs).isEmpty() and 0 < clean.count() <= docs.count()
    assert single.subtract(clean).isEmpty()
    shingles = []
    for r in single.collect():
        w = (r["text"] or "").lower().split()
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i, a in enumerate(shingles):
        assert all(len(a & b) < 0.8 * len(a | b) for b in shingles[:i] if a and b)
    assert masked.count() == single.count()
    assert blobs.secrets(masked).where("size(spans) > 0").isEmpty()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] or "[SECRET]" in r["text"]
        pieces = [re.escape(x) for x in r["text"].split("[SECRET]")]
        assert re.fullmatch(".+".join(pieces), before[r["doc_id"]], re.S)
    assert {r["doc_id"] for r in mixed.collect()} == set(before) and mixed.count() >= masked.count()
    assert {r["doc_id"] for r in packed.collect()} == set(before)


def test_run_is_all_stages(spark, steps):
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*keys).collect())) == sorted(map(tuple, steps[-1].select(*keys).collect()))
