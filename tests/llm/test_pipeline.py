"""The pipeline's stages, each against what its operator says of its own input."""

import pytest

import corpus_pipeline as pipeline
from lattica.llm import neardup, quality, toxicity
from lattica.llm.common import release

from .helpers import SF, clashing, documents, empty, odd


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Inputs of all stages and the last one's output, each written and read again."""
    tables = [documents(spark)]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, tables[-1], SF).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_toxicity_stage(spark, stages):
    index = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    low = [r.doc_id for r in toxicity.score(stages[0], index).collect() if r.score < 0.5]
    assert ids(stages[1]) == sorted(low) and len(low) > 0.9 * stages[0].count()


def test_quality_stage(stages):
    assert ids(stages[2]) == sorted(r.doc_id for r in quality.judge(stages[1]).collect() if r.kept)


def test_near_duplicate_stage(stages):
    found = neardup.near_duplicates(stages[2]).collect()
    assert ids(stages[3]) == sorted({r.class_id for r in found})


def test_packing_stage(stages):
    pieces = stages[4].collect()
    assert {p.doc_id for p in pieces} == set(ids(stages[3]))
    total = {p.doc_id: p.doc_tokens for p in pieces}
    assert sum(p.length for p in pieces) == sum(total.values())


def test_columns_stay(stages):
    assert all(t.columns == stages[0].columns for t in stages[1:4])


def test_run_is_its_stages(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    key = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert key(pipeline.run(spark, SF)) == key(stages[4])


def test_odd_and_empty_tables(spark):
    for docs in (clashing(odd(spark)), empty(spark)):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.count()


def test_workers_give_back_the_memory_of_texts_that_are_gone():
    """What a stage frees leaves the process, also below what stays; a worker that keeps it has it on top of the next stage's."""

    def held() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon:"))

    release()
    texts = ["x" * 20_000 + str(i) for i in range(6_000)]
    stays = "y" * 20_000 + str(len(texts))
    most = held()
    del texts
    release()
    assert stays and most - held() > 90_000  # kB, of 120,000
