"""Columns by their exact names, whatever else a table calls its columns.

Spark takes names without regard to case and reads a dot as a path. The
operators find a column's place by its exact name (or else by the only one that
differs in case), work on numbered columns, and give the names back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(docs: DataFrame, name: str) -> int:
    """Where a column stands: the first of its exact name, else the only one that differs in case."""
    names = docs.columns
    if name in names:
        return names.index(name)
    alike = [i for i, c in enumerate(names) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"{len(alike)} columns are called {name}")
    return alike[0]


def numbered(docs: DataFrame) -> DataFrame:
    """The same rows; columns are called c0, c1, ..."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def pick(docs: DataFrame, **names: str) -> DataFrame:
    """The columns of these names alone, under the names of the arguments."""
    return numbered(docs).select(*(F.col(f"c{place(docs, name)}").alias(to) for to, name in names.items()))


def identity(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's id and text, nulls told from other values; rows that repeat both are one document."""
    parts = (doc_id.isNull(), text.isNull(), doc_id, text)
    return F.xxhash64(F.lit("a"), *parts), F.xxhash64(F.lit("b"), *parts)
