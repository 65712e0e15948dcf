"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again before the next stage; all but the last return the columns of ``docs``.
What a stage decides takes effect: rejected documents and later members of a group
of near duplicates go, repeated passages and secrets are taken out of the texts,
and the last stage packs what is left.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.language_id import predict_language, train_language_model
from inkstone.llm.ngram_join import similar_documents
from inkstone.llm.packing import pack_documents
from inkstone.llm.secret_scan import redact_secrets
from inkstone.llm.substring_dedup import remove_repeats
from inkstone.session import drop_scratch, materialize, scratch_base, scratch_tables

#: A document goes if its language can't be told (no text, no letter) or is a mere guess.
LEAST_LANGUAGE_SCORE = 0.4

#: Scratch tables of the latest stage; its result has been written when the next one starts.
_used: list[str] = []


def _stage(work):  # noqa: ANN001, ANN202
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        known = scratch_tables(spark)
        drop_scratch(spark, [x for x in _used if x in known])
        before = set(scratch_tables(spark))
        out = work(docs)
        _used[:] = [x for x in scratch_tables(spark) if x not in before]
        return out

    return stage


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars, where there is one, that of the changed text."""
    kinds = dict(docs.dtypes)
    return docs.select(*[F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def identify_language(docs: DataFrame) -> DataFrame:
    """Documents in a language that the model tells; those without a letter go, and a null ``lang`` becomes the language told.

    Where no row with a letter has a ``lang`` there is nothing to learn from: then every
    document with a letter stays as it is. Where all rows have one language, all that
    have a letter are of it.
    """
    model = train_language_model(docs, held_out=None)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = ("_pipeline_lang", "_pipeline_score")
    scored = predict_language(docs, model, to=found)
    kept = scored.where((F.col(found[0]) != "und") & (F.col(found[1]) >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.coalesce("lang", F.col(found[0])).alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The row with the least (doc_id, digest of the text) of each group of similar texts; rows without an id stay.

    Rows are numbered and linked by their texts alone, so different texts under one
    doc_id all stay. Texts without words are similar to none; of equal ones under one
    doc_id one row stays.
    """
    rows = materialize(docs.where(F.col("doc_id").isNotNull()).withColumn("_pipeline_row", F.monotonically_increasing_id()), "rows")
    classes = similar_documents(rows.select(F.col("_pipeline_row").alias("doc_id"), "text"))
    classes = classes.select(F.col("doc_id").alias("_pipeline_row"), F.col("class_id").alias("_pipeline_class"))
    named = rows.select("_pipeline_row", "doc_id", F.sha2("text", 256).alias("_pipeline_digest")).join(classes, "_pipeline_row")
    lead = F.min(F.struct("doc_id", "_pipeline_digest", "_pipeline_row")).alias("lead")
    leads = named.groupBy("_pipeline_class").agg(lead).select("lead.*")
    kept = leads.groupBy("doc_id", "_pipeline_digest").agg(F.min("_pipeline_row").alias("_pipeline_row")).select("_pipeline_row")
    return rows.join(kept, "_pipeline_row", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """Texts without passages of 50 words or more that start in an earlier document; every document stays."""
    return _with_length(remove_repeats(docs), docs.columns)


def drop_secrets(docs: DataFrame) -> DataFrame:
    """Texts with each secret replaced by a mark; every document stays."""
    return _with_length(redact_secrets(docs), docs.columns)


def pack(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", _stage(identify_language)),
    ("n-gram Jaccard join", _stage(drop_near_duplicates)),
    ("substring dedup", _stage(drop_repeated_passages)),
    ("secret scans", _stage(drop_secrets)),
    ("best-fit packing", _stage(pack)),
]

#: SQL can't express the trained language model nor the tokenizer; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and the one before it deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, earlier = f"{scratch_base(spark)}/pipeline-{uuid.uuid4().hex[:12]}", None
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if earlier:
            drop_scratch(spark, [earlier])
        earlier = f"{base}/{k}"
    return docs
