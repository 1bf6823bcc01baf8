"""A training corpus from `documents`: stages in order, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from climaspark.llm import jaccard, mixing, packing, secret_scan, toxicity
from climaspark.llm.common import done, quoted, written
from climaspark.llm.queries import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't predict toxic; the others go.

    The score depends on the text alone: rows of one text stay or go together, a null text is an empty one, and null ids have no label.
    An empty table stays empty; without labels the seed lexicon decides.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least doc_id, null before all others.

    Rows of the same words are copies, null and empty texts among them; of rows of one doc_id and the same words one stays.
    """
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too; secrets in their texts are replaced by a mark and n_chars follows. A null text stays null."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as equal weights of all sources ask for, in shuffled order. A null source is a source; rows of one doc_id share their count."""
    return mixing.mix(docs).select(*quoted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of a power of two tokens of all rows; a null or empty text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("secret scans", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: The tokenizer, the trained models and the hashing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces. Each stage's documents are written, and removed when the next stage's are."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        done(before)
    return STAGES[-1][1](spark, docs, sf_dir)
