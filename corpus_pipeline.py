"""From raw documents to token ids: five stages over the documents table.

Each stage works on all that its predecessor kept and hands on rows with the
columns of documents; the last gives ids.

Defined cases, for every stage: an empty table gives an empty result. A null
text is an empty one and a null source is a source of its own. Very long texts
are worked on whole. Further columns are carried through the first four stages
untouched, whatever their names but for those that begin with two underscores.
Each stage says what else it does with nulls, ties and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curbside.llm import digest_index, mixing, near_dedup, quality, sp_tokenizers
from curbside.runtime import cut

WEIGHTS, SHARE, CAP, SEED = [5, 2, 1], 1.0, 2.0, 17


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or score too low against the trusted ones.

    Null and blank texts fail. Repeated rows are judged alike and each stays or
    goes; a null id is never a trusted one. Nulls in the labels trust nobody.
    """
    weights = quality.fit(docs, quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.keep(docs, weights)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, A-Z lower-cased: the one with the largest id.

    A null id is below every other. Of rows that tie in id and text one stays.
    """
    index = digest_index.fresh_index(spark, docs.count())
    kept = digest_index.deduplicate(docs, index, "all")
    index.forget()
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 80 % of five-word shingles: the one with the smallest id.

    A null id is above every other. Documents without words are linked with
    nothing and stay. Of rows that tie in id and text one stays.
    """
    return near_dedup.deduplicate(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the sources to their target weights; documents leave or appear twice.

    Documents without words count for nothing and stay only where their source
    takes whole copies or ranks them within its cut. Repeated rows are told apart
    by a number; rows that tie in their rank go by id and size.
    """
    return mixing.mix(docs, WEIGHTS, SHARE, CAP, SEED)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, ids, n_tokens, round_trip.

    A null text has no ids. Repeated rows are encoded alike. Other columns end here.
    """
    return sp_tokenizers.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), verify_every=sp_tokenizers.VERIFY_EVERY)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: SentencePiece can't be expressed in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
