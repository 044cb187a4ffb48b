"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return documents with
the columns they came with. ``run`` writes each stage's table to the shared folder and reads it again,
so a lost executor never reaches further back than the stage it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactscope.llm.common import stored, table
from contactscope.llm.digest_index import drop_copies
from contactscope.llm.mix_sources import mixed_documents
from contactscope.llm.ngram_join import keep_one
from contactscope.llm.pack import pack, pieces
from contactscope.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels come from the folder."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, apart from white space."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: sets of five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, n=5, num=8, den=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: the words drawn, as documents."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in a sequence."""
    return pack(pieces(docs))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: The stages learn a lexicon, close links into components and tokenise: not SQL. Tested otherwise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
