"""A training-data pipeline over ``documents``.

Five stages, each an operator of ``packloom.llm`` on all that its predecessor
kept: language identification drops documents whose language it cannot tell and
writes the language that it found; the similarity join keeps one document of each
group; documents that leak benchmark items go; personal data is replaced in the
texts that are left; these are encoded to byte-level BPE ids and decoded again.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm import bpe, decontam, langid, neardup, pii
from packloom.runtime import drop_table, scratch, table

#: A document stays if this share of its words has its language.
LEAST_LANGUAGE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: drops texts that are null or have no letter, and those whose best
    language has too small a share; ``lang`` becomes the language found."""
    model = langid.fit(docs, where=langid.spread("doc_id", 3) != 1)
    # Columns go by place, so that one of documents may have any name.
    names = docs.columns
    place = [f"c{i}" for i in range(len(names))]
    seen = langid.predict(docs, model, names).toDF(*place, "lang_pred", "score")
    kept = seen.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_LANGUAGE))
    return kept.select(*("lang_pred" if n == "lang" else c for n, c in zip(names, place))).toDF(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: keeps the document with the smallest id of each group."""
    return neardup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: drops documents that hold a benchmark item."""
    return decontam.remove_leaking(docs, table(spark, sf_dir, "benchmark"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: replaces personal data and the terms that disclose it; ``n_chars``
    follows the text."""
    names = docs.columns
    place = [f"c{i}" for i in range(len(names))]
    n_chars = F.coalesce(F.length(place[names.index("text")]), F.lit(0)).cast("long")
    return pii.sanitise(docs).toDF(*place).select(*(n_chars if n == "n_chars" else F.col(c) for n, c in zip(names, place))).toDF(*names)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the number of ids, and digests of ids and decoded bytes."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", sanitise_personal_data),
    ("byte_bpe", encode_and_decode),
]

#: The stages train models and use hash functions that SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read
    again, and what its stage wrote on the way, and its input, are deleted."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
