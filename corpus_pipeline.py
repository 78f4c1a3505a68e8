"""A training-data pipeline over `documents`: language, repeated passages, near duplicates, mix, tokens."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vestigo.llm import jaccard, language, linededup, mixing, pieces
from vestigo.llm.joins import small_side, unused_name
from vestigo.session import checkpoint_dir, release, stash, stashed, tune

#: A document is rejected when it has no letter or no language has this share of the odds.
MIN_LANGUAGE_SCORE = 0.5


def vocabulary() -> str:
    """Path of the piece vocabulary."""
    return public_tokenizers.path("piece_bpe_32k.model")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_SCRATCH: dict[str, list[str]] = {}


def _stage(fn: Stage) -> Stage:
    """A stage's own scratch tables go when the next stage begins: by then its result is written."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark)
        application = spark.sparkContext.applicationId
        release(spark, _SCRATCH.pop(application, []))
        before = set(stashed(spark))
        out = fn(spark, docs, sf_dir)
        _SCRATCH[application] = [p for p in stashed(spark) if p not in before]
        return out

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language."""
    model = language.fit(docs)
    p = unused_name(docs.columns, "_p")
    guessed = docs.withColumn(p, language.identify(docs, model))
    return guessed.where((F.col(f"{p}.lang_pred") != language.UNDETERMINED) & (F.col(f"{p}.score") >= MIN_LANGUAGE_SCORE)).drop(p)


@_stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later occurrences of passages of 50 words or more; documents with nothing left go."""
    lines = unused_name(docs.columns, "_cut")
    cut = linededup.without_repeats(docs, cut=lines)
    emptied = (F.col(lines) > 0) & F.regexp_like("text", F.lit(r"^[\x20\x09-\x0D]*$"))
    kept = cut.where(~F.coalesce(emptied, F.lit(False))).drop(lines)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by word 5-grams at a Jaccard similarity of 0.8, the smallest doc_id stays."""
    groups = jaccard.jaccard_components(docs, words=5, similarity=(80, 100))
    dropped = stash(groups.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-dropped")
    return docs.join(small_side(dropped), "doc_id", "left_anti")


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents by source up to its target, repeated where the target is larger than the source."""
    return mixing.mixed_documents(docs)


@_stage
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every remaining document."""
    return pieces.round_trip(docs, vocabulary())


STAGES = [
    ("language", identify_language),
    ("line dedup", cut_repeated_passages),
    ("near duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]
#: SQL cannot say the language model, near-duplicate components or encoding; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read by the next, whose end deletes
    it; the last stage's folder holds the result and stays."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            release(spark, [f"{folder}/{number - 1}"])
    return docs
