"""Line deduplication by a log-template tree.

Each line goes down a tree of fixed depth: first by its number of tokens, then
by its leading tokens. Tokens with a digit are variable fields from the start
("<*>"). In a leaf, the tokens behind the leading ones are compared in
``fields`` slices. A template fixes the share ``similarity`` of the slices and
leaves the others variable; all choices of slices are tried, so lines that
agree in enough of them share a template whatever else is in the leaf.

The lines of a template that recurs in ``min_docs`` or more different texts are
dropped from all of them but the first (that of the smallest doc_id), so that
no content leaves the corpus altogether. Equal texts count once and are
treated alike. Lines of fewer than ``min_tokens`` tokens have no template; with
``short`` they recur by their exact text, except that lines in scripts without
spaces take their characters as tokens and go down the tree.

Leaves, slices, templates and texts are known by two independent 64-bit hashes
each, so that different ones don't meet even among 10^15 lines.

DataFrame operations only; the leaves and templates are plain aggregates, so
the result does not depend on the order of the lines.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexus.llm.rows import numbered, pick, place
from plexus.plans.scratch import materialise, settled

#: A character of a script that is written without spaces.
SPACELESS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
TEXT = ["text_a", "text_b"]


def two(name: str, *parts: Column | str) -> list[Column]:
    """Two hashes of the same, as name_a and name_b."""
    return [F.xxhash64(F.lit(x), *parts).alias(f"{name}_{x}") for x in "ab"]


def parse(docs: DataFrame, doc_id: str, text: str, depth: int, fields: int, min_tokens: int = 3, short: bool = False) -> DataFrame:
    """Rows (doc_id, text, line, n, leaf, f0..), hashes twice: a line's way down the tree; the leaf of a short line is its exact text."""
    # Cut first, explode the lines alone: a text beside its lines would be copied for each of them.
    rows = pick(docs, doc_id=doc_id, text=text).where("text is not null")
    lines = rows.select("doc_id", *two("text", "text"), F.split("text", "\n").alias("lines")).select("doc_id", *TEXT, F.posexplode("lines").alias("line", "raw"))
    # Most lines have single spaces and no digit, and are split as they stand.
    plain = F.regexp_replace(F.trim(F.regexp_replace("raw", r"[\s]+", " ")), r"(?<!\S)[^\s0-9]*+[0-9]\S*", "<*>")
    masked = F.when(F.col("raw").rlike(r"[0-9\t\r\x0B\f]|  |\A | \z"), plain).otherwise(F.col("raw"))
    tokens = lines.select("doc_id", *TEXT, "line", *(["raw"] if short else []), F.split(masked, " ").alias("t"))
    leaf = two("leaf", "n", F.slice("t", 1, depth))
    if short:
        # Only lines of few tokens and of more bytes than symbols are looked at for such scripts.
        bare = F.regexp_replace(F.regexp_replace("raw", r"\s+", ""), "[0-9]+", "0")
        spaceless = (F.size("t") < min_tokens) & (F.octet_length("raw") > F.char_length("raw")) & F.col("raw").rlike(SPACELESS)
        tokens = tokens.withColumn("t", F.when(spaceless, F.split(bare, "")).otherwise(F.col("t")))
        exact = F.trim(F.regexp_replace("raw", r"\s+", " "))
        leaf = [F.when(F.col("n") < min_tokens, F.xxhash64(F.lit(f"exact {x}"), exact)).otherwise(y).alias(f"leaf_{x}") for x, y in zip("ab", leaf, strict=True)]
    tokens = tokens.withColumn("n", F.when(F.element_at("t", 1) == "", 0).otherwise(F.size("t")))
    rest = F.greatest(F.col("n") - depth, F.lit(0))
    cut = lambda i: F.lit(depth) + F.floor(rest * i / fields).cast("int")
    slices = [c for i in range(fields) for c in two(f"f{i}", F.slice("t", cut(i) + 1, cut(i + 1) - cut(i)))]
    return tokens.select("doc_id", *TEXT, "line", "n", *leaf, *slices)


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 4, fields: int = 4, similarity: float = 0.5, min_docs: int = 3, min_tokens: int = 3, short: bool = False) -> DataFrame:
    """Rows (doc_id, text_a, text_b, line) of the lines to drop; line counts from 0. Lines without tokens stay."""
    lines = materialise(parse(docs, doc_id, text, depth, fields, min_tokens, short).where(F.col("n") >= (1 if short else min_tokens)), "lines")
    # A template cannot recur in a leaf that has fewer lines; most lines go no further.
    leaf, key = ["leaf_a", "leaf_b"], ["key_a", "key_b"]
    busy = lines.groupBy(leaf).agg(F.count("*").alias("lines")).where(F.col("lines") >= min_docs).select(leaf)
    busy = settled(busy, "busy").hint("merge")  # a written table, so that the join can split a leaf of very many lines
    fixed = [F.struct(*two("key", F.lit(i), *leaf, *(f"f{j}_{x}" for j in c for x in "ab"))) for i, c in enumerate(combinations(range(fields), math.ceil(similarity * fields)))]
    templates = F.array_distinct(F.array(*fixed))
    if short:
        templates = F.when(F.col("n") < min_tokens, F.array(F.struct(F.col("leaf_a").alias("key_a"), F.col("leaf_b").alias("key_b")))).otherwise(templates)
    keyed = materialise(lines.join(busy, leaf).select("doc_id", *TEXT, "line", F.explode(templates).alias("key")).select("doc_id", *TEXT, "line", "key.*"), "templates")
    texts = keyed.groupBy(*key, *TEXT).agg(F.min("doc_id").alias("doc_id"))
    often = (
        texts.groupBy(key)
        .agg(F.count("*").alias("n_docs"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *TEXT)).alias("first"))
        .where(F.col("n_docs") >= min_docs)
        .select(*key, F.col("first.text_a").alias("first_a"), F.col("first.text_b").alias("first_b"))
    )
    # From a written table both sides reach the join straight from a shuffle, so a template of very many lines can be split.
    often = settled(often, "often").hint("merge")
    return keyed.join(often, key).where("text_a <> first_a or text_b <> first_b").select("doc_id", *TEXT, "line").distinct()


def drop_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All rows and columns of ``docs``, with the recurring lines gone from the texts, and a column n_dropped.

    Texts without a recurring line are unchanged to the byte; null stays null,
    and a text whose lines all go is empty. Lines of fewer than min_tokens
    tokens stay unless ``short``; lines without tokens always stay. Rows that
    repeat a doc_id and text are cut alike; null ids are allowed, ids may be of
    any type. An empty table gives an empty one. Columns of ``docs`` may have
    any names but n_dropped, which is replaced.
    """
    lost = recurring_lines(docs, doc_id, text, **how).groupBy("doc_id", *TEXT).agg(F.collect_set("line").alias("gone"))
    # The join shuffles at every size; which side is small depends on the corpus.
    lost = materialise(lost, "gone").hint("merge").select(F.col("doc_id").alias("own_id"), *TEXT, "gone")
    rows, at = numbered(docs), place(docs, text)
    keyed = rows.select("*", *two("row", F.col(f"c{at}")))
    joined = keyed.join(lost, (F.col("row_a") == F.col("text_a")) & (F.col("row_b") == F.col("text_b")) & F.col(f"c{place(docs, doc_id)}").eqNullSafe(F.col("own_id")), "left")
    left = F.array_join(F.filter(F.split(F.col(f"c{at}"), "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    stay = [i for i, c in enumerate(docs.columns) if c.lower() != "n_dropped"]
    return joined.select(
        *(F.when(F.col("gone").isNull(), F.col(f"c{i}")).otherwise(left) if i == at else F.col(f"c{i}") for i in stay),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long"),
    ).toDF(*(docs.columns[i] for i in stay), "n_dropped")
