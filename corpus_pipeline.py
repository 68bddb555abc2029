"""A corpus pipeline of five operators: each stage reads what the one before it wrote.

Each stage takes a table with a ``doc_id`` and a ``text`` and whatever other columns, keeps all of them whatever their names (the last
one returns its own), and gives an empty table for an empty one. Texts are used whole, however long. What nulls, empty texts, ties
and repeated rows become is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalist.llm import bpe, exact_dedup, mixing, near_dedup, quality
from stratalist.llm.shared import materialize, table

#: Shares of the tokens after mixing. Junk is gone by then but for what the classifier lets through.
MIX_TARGETS = {"plain": 0.93, "toxic": 0.05, "junk": 0.02}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    Null and empty texts score 0 and go; repeated rows are kept or go alike; of an id with several labels the lowest counts.
    """
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays.

    A null text equals an empty one; of repeated rows, and of rows without an id, one stays where no other id is left.
    """
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8 or more) the one with the smallest id stays.

    Texts without words, null ones too, are near to none and stay; of repeated rows one stays; of one id with several texts of one group
    one stays, in order of a hash of the text.
    """
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says.

    Null and empty texts have no tokens and are rated by their statistics; repeated rows are rated and drawn alike; a row without an id
    is drawn as one of a fixed id.
    """
    return mixing.mix(docs, mixing.labelled_domains(table(spark, sf_dir, "labels")), MIX_TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as digests, of each row that is left. A null text counts as empty; repeated rows give repeated results."""
    return bpe.bpe_encode(docs, bpe.tokenizer_path("word_bpe_49k.json"), full=False)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("encode", encode)]

#: The classifier, the sketches and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
