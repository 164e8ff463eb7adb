import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from blockloom.llm import packing, pii, toxicity
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input of each stage, and the last one's output, written and read again."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in C.STAGES:
        stage(spark, docs[-1], SF).write.parquet(f"{folder}/{name}")
        docs.append(spark.read.parquet(f"{folder}/{name}"))
    return docs


def test_columns(steps):
    for before, after in zip(steps[:4], steps[1:5]):
        assert after.dtypes == before.dtypes


def test_toxicity(spark, steps):
    fold = ~toxicity.in_fold("doc_id")
    model = toxicity.train(steps[0].where(fold), spark.read.parquet(f"{SF}/labels.parquet").where(fold))
    docs = steps[0].toPandas()
    want = docs[model.score(docs.text.tolist()) < 0.7]
    assert sorted(steps[1].toPandas().itertuples(index=False)) == sorted(want.itertuples(index=False))
    assert 0 < len(want) < len(docs)


def test_language_keeps_clean_documents(steps):
    gone = steps[1].join(steps[2], "doc_id", "left_anti").collect()
    assert all(not any(c.isalpha() for c in r.text) for r in gone)


def test_one_of_each_group(steps):
    docs = steps[2].collect()
    classes = brute([r.doc_id for r in docs], [r.text for r in docs])
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted({c for _, c, _ in classes})


def test_personal_data_is_masked(steps):
    before = {r.doc_id: r.text for r in steps[3].collect()}
    found = pii.find(list(before.values()), pii.default_field())
    want = {i: pii.mask(t, spans) for (i, t), (_, spans) in zip(before.items(), found)}
    after = steps[4].collect()
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    assert any(a != b for a, b in zip(before.values(), want.values()))


def test_packing_holds_all(spark, steps):
    out = steps[5].toPandas()
    assert sorted(out.doc_id.unique()) == sorted(r.doc_id for r in steps[4].collect())
    assert out.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_run_is_the_stages_one_after_the_other(spark, steps):
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert rows(C.run(spark, SF)) == rows(steps[5])


@pytest.mark.parametrize("stage", range(5))
def test_null_empty_repeated_long_and_clashing(spark, stage):
    text = "and the there of in this or with " * 8
    rows = [(1, text, None, None, "a"), (1, text, None, None, "a"), (2, None, "en", "s", None), (None, "", "en", "s", "b"), (3, "the and " * 40_000 + "a@b.de", "en", "s", "c"), (4, "12 34", None, "s", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, spans string")
    name, function = C.STAGES[stage]
    out = function(spark, docs, SF)
    assert function(spark, docs.limit(0), SF).count() == 0
    if stage == 4:
        assert out.select(F.count_distinct("sequence_id"), F.sum("length")).first()[1] > 40_000
        return
    assert out.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text)
    assert {"toxicity": 4, "language": 3, "near_duplicates": 3, "personal_data": 4}[name] == len(kept)
    if name == "personal_data":
        assert kept[2][1].endswith("the and <email>")
