"""A training corpus from documents: language ID, exact dedup, near-dedup, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm.bpe import encode
from sheafline.llm.common import discard, settled, table
from sheafline.llm.exact_dedup import keep_first
from sheafline.llm.langid import held_out, keep_known, train
from sheafline.llm.mixing import keep_mixed
from sheafline.llm.queries import MIX_WEIGHTS, mix_domain
from sheafline.llm.simhash import keep_one

#: The share of the near-deduplicated corpus' tokens that the mix spends.
MIX_SHARE = 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those in which no language is likelier than all others together.

    Where no row says its language, nothing can be learned and every text with a letter stays.
    """
    return keep_known(docs, train(docs.where(~held_out())))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without blanks, keeps one row: the most code points, then the smallest id, null last, then any.

    Null texts are equal to empty ones. Ids may be null and repeat; an empty table stays empty.
    """
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose SimHash prints link, keeps one row, of the smallest id, null last.

    Null and empty texts have one print and are one group. Ids may be null and repeat; an empty table stays empty.
    """
    return keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what a mix of MIX_SHARE of all tokens takes, each document at most once.

    Null sources and languages are leaves of their own; texts without a token are not taken. Ids may be null and repeat; an
    empty table stays empty.
    """
    return keep_mixed(docs, total=F.col("tokens") * MIX_SHARE, weights=MIX_WEIGHTS, domain=mix_domain())


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of every document; a null text is an empty one, repeats stay."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("encoded", encoded)]

#: No SQL: the models, fingerprints and the vocabulary have none. tests/llm tests each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from all documents; a stage's scratch tables go when it ends."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023  called at once
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
