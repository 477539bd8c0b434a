"""Stages of the pipeline on nulls, repeats, an empty table, long texts and columns named like the operators' results."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import prose

SCHEMA = "doc_id long, text string, n_chars int, quality_score string, n_lines string, n_lines_removed string, secrets string, kept string, n string, base string, lost string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    labels = [(1, 1), (2, 0), (3, 1), (4, 0), (5, 1), (6, 1), (None, 0), (7, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    text = prose(rng, 60)
    texts = [(1, text), (1, text), (2, None), (3, ""), (None, text), (None, None), (4, text + " end"), (5, "password=abc123def\n" + prose(rng, 20)), (6, "x" * 200_000)]
    return spark.createDataFrame([(d, t, None if t is None else len(t), *"abcdefgh") for d, t in texts], SCHEMA).repartition(3).cache()


def test_stages_keep_columns_and_defined_cases(spark, docs, folder):
    before = sorted(map(str, docs.select("doc_id", "quality_score", "n_lines", "n_lines_removed", "secrets", "kept", "n", "base", "lost").distinct().collect()))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        rows = out.collect()
        assert {tuple(r)[3:] for r in rows} == {tuple("abcdefgh")}, name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        if name == "secrets":
            assert sorted({str(r) for r in out.select("doc_id", "quality_score", "n_lines", "n_lines_removed", "secrets", "kept", "n", "base", "lost").collect()}) == before
    good = corpus_pipeline.keep_good(spark, docs, folder)
    assert good.columns == docs.columns and {tuple(r)[3:] for r in good.collect()} <= {tuple("abcdefgh")}
    lines = sorted((r.doc_id or 0, r.text or "-") for r in corpus_pipeline.drop_lines(spark, docs, folder).where("doc_id < 5 or doc_id is null").collect())
    text = docs.where("doc_id = 1").first().text
    assert lines == sorted([(0, "-"), (0, text), (1, text), (1, text), (2, "-"), (3, "-")])  # 4 repeats a line of 1 and has no other
    kept = sorted(r.doc_id or 0 for r in corpus_pipeline.keep_one(spark, docs, folder).collect())
    assert kept == [0, 0, 1, 1, 2, 3, 5, 6]
    hidden = corpus_pipeline.hide_secrets(spark, docs, folder).where("doc_id in (2, 5)").orderBy("doc_id").collect()
    assert hidden[0].text is None and hidden[1].text.startswith("[SECRET]\n")
    packed = corpus_pipeline.to_sequences(spark, docs, folder)
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_stages_of_an_empty_table(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_stages_in_turn_on_planted_copies(spark, tmp_path):
    """Each stage on what the one before kept: copies go once, and no emptied document is packed."""
    rng = random.Random(8)
    whole = [[prose(rng, 25) for _ in range(4)] for _ in range(6)]
    texts = {10 * k: "\n".join(x) for k, x in enumerate(whole)}
    texts |= {10 * k + 1: "\n".join(x) for k, x in enumerate(whole[:3])}  # exact copies
    texts |= {10 * k + 2: "\n".join([x[0] + " end", *x[1:]]) for k, x in enumerate(whole[:3])}  # an edited line
    texts |= {10 * k + 3: "\n".join([*x, prose(rng, 25)]) for k, x in enumerate(whole[:2])}  # a line of its own
    texts |= {10 * k + 4: " ".join(x) for k, x in enumerate(whole[3:5], 3)}  # other line breaks: a near duplicate still
    texts |= {70: "", 71: None, 72: "--\n--", 73: "password=abc123def and " + prose(rng, 20)}
    docs = spark.createDataFrame([(d, t, 0 if t is None else len(t)) for d, t in texts.items()], "doc_id long, text string, n_chars int")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, kept, "").write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        got = {r.doc_id: r.text for r in kept.collect()}
        if name == "lines":
            assert set(texts) - set(got) == {1, 2, 11, 12, 21, 22}
            assert got[3] == texts[3].split("\n")[-1] and all(got[d] == texts[d] for d in (0, 50, 34, 44, 70, 71, 72))
        if name == "near_duplicates":
            assert set(got) == set(texts) - {1, 2, 11, 12, 21, 22, 34, 44}
    assert got[73].startswith("[SECRET] and")
    packed = corpus_pipeline.to_sequences(spark, kept, "")
    lone = {r.doc_id for r in packed.where("doc_tokens = 1").collect()}
    assert lone == {70, 71} and {r.doc_id for r in packed.collect()} == set(got)


def test_checkpoints_go_with_their_frames(spark, docs):
    import gc
    import time

    from tracklore.llm.runtime import cut, prepare

    prepare(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir"))
    system = path.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    folders = lambda: {f.getPath().getName() for f in system.listStatus(path)}
    held = cut(docs.select("doc_id"))
    before = folders()
    gone = cut(docs.select("text"))
    (mine,) = folders() - before
    assert gone.count() == held.count()
    del gone
    for _ in range(60):
        gc.collect()
        spark._jvm.System.gc()
        if mine not in folders():
            break
        time.sleep(0.5)
    assert mine not in folders() and held.count() == docs.count()
