"""A corpus pipeline: clean, deduplicate, mix and tokenise ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Stages
meet through tables in the shared folder, so each one's lineage is a scan and its work survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, exact_dedup, mixing, ngram_join, queries, toxicity
from strandline.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from labels that are not held out. Null and empty texts have
    the score of no words at all; long texts are scored whole; repeated rows, and texts with equal words, share their fate; an
    empty table stays empty. Columns of any names are kept as they are."""
    return materialize(toxicity.keep_clean(docs, queries.toxicity_model(docs, table(spark, sf_dir, "labels"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id, or one of those where rows repeat. Null and
    empty texts are one group; a null id loses to any other; long texts are compared whole; an empty table stays empty.
    Columns of any names are kept as they are."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id (null last), or one of those where rows repeat.
    Null texts and texts without words are near to nothing and stay; long texts are compared whole; an empty table stays
    empty. Columns of any names are kept as they are."""
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, three times at most. A null source is a source; texts without words,
    null or not, have no size and are not taken; a long text counts with all its words; of equal sizes a hash of the id decides;
    repeated rows share their repeats; an empty table stays empty. Columns of any names are kept as they are."""
    return mixing.mix_documents(docs, queries.contract_targets, queries.words("text"), F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document, a row for a row. A null text is encoded as an empty one,
    without ids; long texts whole; repeated rows alike; an empty table gives an empty result. Other columns are not read."""
    return materialize(bpe.encode(docs, queries.vocabulary_path()).withColumnRenamed("id", "doc_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_to_target_weights", mix_sources),
    ("bpe_encoding", encode),
]

#: A trained classifier is no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
