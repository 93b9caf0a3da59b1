"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs.  The runner may write each result as Parquet and
read it again as the next stage's docs.

Null and empty texts, texts without words and rows without an id are clean
documents: they go through all stages, but rows equal in id and text leave the
join as one, and packing gives each its end token alone.  A text whose lines all
recur stays as an empty row.  Other columns are kept as they are, whatever their
names, until packing returns its own.  Without labels of both classes nothing is
toxic; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import linededup, ngram_join, packing, toxicity
from lodestone.llm.common import table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity scores below one half."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template an earlier document has."""
    return linededup.drop_recurring_lines(docs, count_col=None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 on five words."""
    return ngram_join.keep_one(docs, ngram_join.Similarity(words=5, percent=80))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic_documents), ("line_dedup", recurring_lines), ("ngram_join", near_duplicates), ("packing", sequences)]

#: The classifier and the tokenizer are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each on all that the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
