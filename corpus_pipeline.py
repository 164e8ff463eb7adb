"""A corpus pipeline: toxic documents go, documents in no language go, one of each near-duplicate group stays,
personal data is masked, and what is left is packed into sequences of tokens.

Every stage takes the documents that its predecessor kept and reads all of them. All but the last return the columns
of their input, in its order. The same cases have the same results in every stage: a null text counts as an empty one
(the language stage rejects it, as it has no letter); equal rows are treated alike but for the near-duplicate stage,
of which one stays; nulls in other columns pass; columns beside doc_id and text are handed on, whatever their names;
an empty table stays empty.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import langid, ngram_join, packing, pii, toxicity
from blockloom.llm._shared import written

#: A text of at least so many characters is in no learned language below this cosine with every profile. The least of
#: the documents measured: 0.196 of 200 characters or more, 0.132 of 40 to 199, 0.070 of 20 to 39; of shorter ones 0.04.
LEAST_COSINES = ((200, 0.18), (40, 0.12), (20, 0.05))


def added(name: str) -> str:
    """A column name that no table has."""
    return f"pipeline__{name}_{uuid.uuid4().hex[:8]}"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of a toxicity of 0.7 or more. Labels are learned from the same rows as in query op3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.where(~toxicity.in_fold("doc_id")), labels.where(~toxicity.in_fold("doc_id")))
    score = added("score")
    return toxicity.score(docs, model, docs.columns, score_col=score).where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def drop_without_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, and those of 20 characters or more that are like none of the languages
    of the table. Where no language can be learned, as with lang null in every row, all with a letter stay."""
    profiles = langid.train(docs, langid.Space())
    learned = bool(profiles.langs)
    if not learned:
        profiles = langid.Profiles(profiles.space, ["any"], np.zeros((1, profiles.space.dim)))
    tagged = langid.identify(docs.select(F.struct(*docs.columns).alias("doc")), profiles, ["doc"], text_col="doc.text")
    length = F.length(F.col("doc.text").cast("string"))
    least = F.coalesce(*[F.when(length >= n, cosine) for n, cosine in LEAST_COSINES if learned], F.lit(-1.0))
    return tagged.where((F.col("lang_pred") != "und") & (F.col("lang_cosine") >= least)).select("doc.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents that near copies connect: that of the least doc_id."""
    text_hash, same = added("hash"), added("same")
    classes = written(ngram_join.jaccard_join(docs), "pipeline-classes")
    kept = classes.where("kept").select(F.col("doc_id").alias(same), F.col("text_hash").alias(text_hash))
    # The hash is the operator's own, of the text as a string.
    hashed = docs.withColumn(text_hash, F.xxhash64(F.col("text").cast("string")))
    left = hashed.join(kept, (hashed["doc_id"].eqNullSafe(kept[same])) & (hashed[text_hash] == kept[text_hash]), "left_semi")
    # Rows with one id and one text: only one of them is kept. Without any, no shuffle is spent on them.
    if not classes.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", text_hash])
    return left.drop(text_hash)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With each span of personal data replaced by its kind, and n_chars, if it is there, after it."""
    found = pii.detect(docs.select(F.struct(*docs.columns).alias("doc")), ["doc"], text_col="doc.text", masked=True)
    put = {"text": F.col("masked"), "n_chars": F.length("masked").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return found.select(*[F.coalesce(put[c], F.col(f"doc.`{c}`")).alias(c) if c in put else F.col(f"doc.`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048: one row per piece of a document."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_without_language),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Trained models and token files are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each one's rows written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
