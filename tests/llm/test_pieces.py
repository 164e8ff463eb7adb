import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from blockloom.llm import pieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return S.PieceTable(PATH, max_chunks=200)


def odd_texts():
    rng = random.Random(4)
    letters = " ▁abcdetnoéñ.\n0Ａ日本語😀\x00\t"
    pool = [LIB.id_to_piece(i) for i in range(259, 32000)]
    for k in range(6000):
        if k % 2:
            s = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        else:
            s = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 8))).replace("▁", " ")
        yield s.replace("a", " " * rng.randrange(40)) if rng.random() < 0.3 else s
    yield from ["", " ", "  ", "</s> <unk> <0x41>", "a" * 5000, "ab" * 3000, "퟿"]


def test_equals_the_library(own):
    for s in odd_texts():
        ids = LIB.encode(s)
        assert own.encode(s) == ids, s
        assert own.decode([*ids, 2]) == LIB.decode([*ids, 2]), s
        n, a, b = own.digest(s)
        assert n == len(ids) + 1
        assert a == hashlib.sha256(" ".join(map(str, [*ids, 2])).encode()).hexdigest()
        assert b == hashlib.sha256(LIB.decode([*ids, 2]).encode()).hexdigest()


def test_decodes_any_ids(own):
    rng = random.Random(6)
    for _ in range(4000):
        ids = [rng.choice((rng.randrange(32000), rng.randrange(259), rng.randrange(230, 259))) for _ in range(rng.randrange(6))]
        if ids[:1] in ([1], [2]) or 0 in ids:
            continue
        assert own.decode(ids) == LIB.decode(ids), ids


def test_compatible_is_what_encoding_both_gives(own):
    rng, ids = random.Random(8), list(own.id.values())
    for _ in range(5000):
        a, b = rng.choice(ids), rng.choice(ids)
        both = [own.id[c] for c in own.text[a] + own.text[b]]
        while True:
            merges = [(own.rank[own.joined[p]], at) for at, p in enumerate(zip(both, both[1:])) if p in own.joined]
            if not merges:
                break
            at = min(merges)[1]
            both[at : at + 2] = [own.joined[both[at], both[at + 1]]]
        assert own.compatible(a, b) == (both == [a, b])


def test_whole_table(spark, sf):
    out = S.op4_prefix_table_pieces(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(out) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = [*LIB.encode(text or ""), 2]
        want = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), LIB.decode(ids))))
        assert tuple(out.loc[doc_id]) == want


def test_null_empty_repeated_and_clashing(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "to be " * 30_000, None), (3, "Hi", "c"), (3, "Hi", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded_sha256 string")
    ids = S.encode_texts(docs, PATH, ["doc_id"])
    assert [len(r.ids) for r in ids.collect()] == [1, 1, len(LIB.encode(rows[2][1])) + 1, 3 - 1, 2]
    back = S.decode_ids(ids, PATH, ["doc_id"]).collect()
    assert [r.decoded for r in back] == ["", "", rows[2][1], "Hi", "Hi"]
    assert S.decode_ids(ids.withColumn("ids", F.lit(None)), PATH, ["doc_id"]).first().decoded == ""
    assert S.round_trips(docs.limit(0), PATH, ["doc_id"]).count() == 0
    assert [r.n_tokens for r in S.round_trips(docs, PATH, ["doc_id"]).collect()][:2] == [1, 1]
