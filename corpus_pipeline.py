"""The corpus pipeline: language ID, quality rules, line dedup, MinHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
for the next. All but the last return the columns of documents. Stages work on whole texts with the
production parameters of their operators.

What holds in every stage but the last: an empty table stays empty; further columns pass unchanged, whatever
their names; rows that repeat are judged alike (and are one document for near-dedup); a null lang or source means
nothing to a stage. A null text has no language, so the first stage drops it, and alone it is dropped by quality
rules, unchanged by line dedup, and kept by near-dedup, as an empty text is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formicary.llm import language, lines, neardup, packing, quality
from formicary.llm.queries import vocabulary
from formicary.llm.shared import settle, unused, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or whose two nearest languages are about as near.

    The classifier learns from a bounded sample of the labelled rows of docs; null ids are told apart by their
    texts. Without any labelled row, every text with a letter stays.
    """
    return language.keep_identified(docs, language.fit(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents below the fixed minimum and those that the learned list rejects.

    Null and empty texts are below the minimum. Null ids have no label but are judged; an id with several labels
    or texts teaches with each pair of them. Without labels only the minimum counts.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; n_chars follows the text.

    Of equal lines those of the largest id stay; rows without an id count as one document, which keeps none; rows
    with equal ids are one document. A text that loses every line is empty and stays as a row; a null text and its
    n_chars stay as they are, as does n_chars of a text that loses nothing.
    """
    n_lines = unused("__n_lines", docs.columns)
    n_dropped = unused("__n_dropped", docs.columns)
    out = lines.dedup_lines(docs, n_lines=n_lines, n_dropped=n_dropped)
    length = F.when(F.col(n_dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (5 words, 0.8).

    Rows that repeat an id are told apart by their texts, and one stays of those that are alike. Rows without an id
    and texts without words stay.
    """
    return neardup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a row for each piece.

    An empty or null text is one piece, the closing 0; null ids stay null; rows that repeat are packed each. The
    columns are the pieces', so others of docs are left out.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("best-fit packing", pack_sequences),
]

#: Classifiers, MinHash and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written out before the next; what it read is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name.replace(" ", "-"), since)
    return docs
