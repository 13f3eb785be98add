"""A corpus pipeline of five stages over ``documents``; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm import decontam, langid, line_dedup, piece, simhash
from plexus.llm.queries import piece_model
from plexus.llm.rows import numbered, place
from plexus.plans.scratch import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go."""
    return langid.keep_known(docs)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur in two or more different texts go, short ones by their exact text; every document stays. n_chars follows the text."""
    out = line_dedup.drop_recurring(docs, min_docs=2, short=True)
    rows, names = numbered(out), out.columns[:-1]
    text, size, dropped = (F.col(f"c{place(out, c)}") for c in ("text", "n_chars", "n_dropped"))
    at = place(out, "n_chars")
    follow = F.when(dropped > 0, F.char_length(text).cast(out.schema[at].dataType)).otherwise(size)
    return rows.select(*(follow if i == at else F.col(f"c{i}") for i in range(len(names)))).toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return piece.encode_decode(docs, piece_model())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL can't express the language model's, the fingerprints' and the encoder's results.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = materialise(numbered(kept), name).toDF(*kept.columns)  # a file's columns can't differ in case alone
    return STAGES[-1][1](spark, docs, sf_dir)
