"""The corpus pipeline: language, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``. Between stages the rows are
a Parquet table in the shared folder, so a lost executor costs one stage at most.

Edge cases: a null, empty or letterless text has no language and goes at the first
stage; a row without doc_id takes no part in the near duplicates and stays; of
repeated rows one stays; texts without a source are mixed as a source of their own;
a very long text is one row of each stage until it is cut into pieces; ties go as
each operator states; an empty table gives no rows; further columns are carried
along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard_join, language_id, mixing, packing, surrogates
from tessera.llm.queries import tokenizer_file
from tessera.llm.shared import fewer_files, table, written

#: Words whose ids a worker keeps in the last stage, where it lives on beside the others.
REMEMBERED = 150_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return fewer_files(language_id.accepted(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return fewer_files(jaccard_join.one_of_each(docs), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in the texts become surrogates."""
    return fewer_files(surrogates.with_surrogates(docs), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources appear by their target weights: rows are repeated, cut to chosen blocks or left out."""
    return fewer_files(mixing.mixed_documents(docs), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in their sequences, with their ids; ``document`` tells apart the uses the mixture makes of one doc_id."""
    return fewer_files(packing.pack(packing.pieces(docs, tokenizer_file(), remembered=REMEMBERED)), docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: Trained networks, sampled joins and keyed surrogates are not SQL; stages are
#: tested against plain versions of themselves instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
