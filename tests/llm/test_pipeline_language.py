"""The language stage rejects planted texts of no learned language and keeps all real ones."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

ITALIAN = "I bambini giocano nel parco mentre i loro genitori siedono su una panchina a parlare del tempo e dei programmi per il fine settimana. "
FINNISH = "Lapset leikkivät puistossa, kun heidän vanhempansa istuvat penkillä ja juttelevat säästä ja viikonlopun suunnitelmista. "
SWAHILI = "Watoto wanacheza katika bustani wakati wazazi wao wameketi kwenye benchi wakizungumza kuhusu hali ya hewa. "
CODE = 'static int parse_args(int argc, char **argv) { for (int i = 1; i < argc; i++) { if (!strcmp(argv[i], "-v")) verbose++; } return 0; } '


def gibberish(n, rng=random.Random(3)):
    return "".join(rng.choice("bcdfghjklmnpqrstvwxzaeiouy     ") for _ in range(n))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_planted_go_and_real_ones_stay(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = [ITALIAN * 4, FINNISH, SWAHILI, CODE * 3, FINNISH * 9, *(gibberish(n) for n in (60, 120, 180, 300, 1_000))]
    planted = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "id long, t string")
    row = docs.limit(1).drop("doc_id", "text", "lang").crossJoin(planted)
    row = row.withColumns({"doc_id": F.col("id").cast(docs.schema["doc_id"].dataType), "text": F.col("t"), "lang": F.lit(None).cast("string")})
    out = C.drop_without_language(spark, docs.unionByName(row.select(docs.columns)), "")
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_without_any_language_all_with_a_letter_stay(spark):
    rows = [(1, "and the there of in this or with " * 8, None), (2, "été", None), (3, "12 34", None), (4, None, None), (5, gibberish(300), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in C.drop_without_language(spark, docs, "").collect()) == [1, 2, 5]
