import re

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from blockloom.llm import _shared, langid, ngram_join, packing, pieces


def test_slices_join_to_the_text():
    cut = re.compile(r"\s")
    for text in ("", "ab", "ab cd  ef\ngh " * 9, "x" * 50):
        for size in (1, 3, 10, 1000):
            parts = list(_shared.slices(text, cut, size))
            assert "".join(parts) == text and all(p[:1].isspace() for p in parts[1:])


def test_long_texts_are_read_in_parts_with_the_same_result(monkeypatch):
    text = "Où  est   le ▁ chat? It's 12 o'clock\n\n so  what  ▁▁ then. " * 40
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table, words = pieces.PieceTable(public_tokenizers.path("piece_bpe_32k.model")), packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    plain = text.replace("▁", "_")
    want = table.digest(text), words.encode(plain), ngram_join.shingles(text)
    real = _shared.slices
    small = lambda t, cut, size=0: real(t, cut, 37)
    for m in (pieces, packing, ngram_join):
        monkeypatch.setattr(m, "slices", small)
    assert table.encode(text) == lib.encode(text) and table.digest(text) == want[0]
    assert words.encode(plain) == want[1] and (ngram_join.shingles(text) == want[2]).all()
    for n in (1, 2, 3, 5):
        for t in (text, "a " * 60, "1 " * 60, "1 " * 60 + "b"):
            assert [x.tolist() for x in langid.gram_counts(t, n, 40)] == [x.tolist() for x in langid.gram_counts(t, n)]


def test_written_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert _shared.written(spark.range(5), "x").count() == 5
    (app,) = (tmp_path / "blockloom").iterdir()
    _shared.clear_written(spark)
    assert not app.exists()


def test_lookup_with_heavy_keys_is_a_join(spark):
    left = spark.range(1_000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10).where("k <> 4")
    want = sorted(map(tuple, left.join(right, "k").select("k", "id", "n", "v").collect()))
    for heavy in (F.col("n") > 100, F.lit(False), F.lit(True), F.col("n") > F.lit(None)):
        assert sorted(map(tuple, _shared.lookup(left, right, ["k"], heavy).select("k", "id", "n", "v").collect())) == want
    assert all(n // _shared.heavy_limit(n) <= 1_000 for n in (0, 99, 1_000, 10**6, 10**9 + 7))


def test_tasks_read_batches_in_parts_and_drop_what_other_operators_keep():
    kept, own = {"a": 1}, {"b": 2}
    _shared.keeps("test-other", kept.clear)
    _shared.keeps("test-own", own.clear)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["x"]) for n in (1_300, 0, 2)]
    found = list(_shared.parts(iter(batches), "test-own", 512))
    assert [b.num_rows for b in found] == [512, 512, 276, 0, 2]
    assert [x for b in found for x in b.column(0).to_pylist()] == [*range(1_300), 0, 1]
    assert not kept and own


def test_a_kept_text_is_sent_once(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "c", 7)], "doc_id long, text string, n int")
    inner = docs.select(F.struct(*docs.columns).alias("doc"))
    for rows, keep, col, columns in ((docs, ["doc_id", "text"], "text", 2), (inner, ["doc"], "doc.text", 1), (docs, ["doc_id"], "text", 2), (docs, ["doc_id", "n"], "n", 3)):
        sent, text = _shared.with_text(rows, keep, col)
        assert len(sent.columns) == columns
        want = ["5", "6", "7"] if col == "n" else ["a b", None, "c"]
        assert [x for b in sent.toArrow().to_batches() for x in text(b.slice(0)).to_pylist()] == want
        (whole,) = sent.toArrow().combine_chunks().to_batches()
        assert text(whole.slice(1)).to_pylist() == want[1:]
