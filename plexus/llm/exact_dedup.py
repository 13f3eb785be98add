"""Exact deduplication by Grace hashing.

1. Every input task drops its own repeats first, so a text crosses the network
   at most once per task however many copies there are.
2. The distinct texts are partitioned by hash. Each task partitions its share
   again, recursively and by other bits of the hash, into spill files private
   to the task attempt, until a bucket fits the memory bound; there an
   open-addressing table compares complete contents.
3. The verdicts, one row per distinct text, are joined to the rows by the
   text's SHA-256 (its equality stands for the equality the tables have found);
   a hot text's rows can be split between tasks because the verdict side is unique.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plexus.llm.rows import pick
from plexus.plans.scratch import small_batches

def records(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("h", T.LongType()), T.StructField("text", T.StringType()), T.StructField("largest", id_type), T.StructField("n", T.LongType())])


def verdict_rows(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("text_sha256", T.StringType()), T.StructField("keep_id", id_type), T.StructField("group_size", T.LongType())])


class Table:
    """Open addressing with linear probing; entries are equal only if their complete contents are."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[str] = []
        self.largest: list[int | None] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, h: int, text: str, largest: int | None, n: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.texts[k] == text:
                if largest is not None and (self.largest[k] is None or largest > self.largest[k]):
                    self.largest[k] = largest
                self.counts[k] += n
                return
            at = at + 1 & mask
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.largest.append(largest)
        self.counts.append(n)
        self.bytes += 4 * len(text) + 200
        if 2 * len(self.texts) > len(self.slots):
            self.grow()

    def grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = at + 1 & mask
            self.slots[at] = k

    def rows(self):
        return zip(self.hashes, self.texts, self.largest, self.counts, strict=True)


def grace(records, memory: int, fan_out: int = 16, level: int = 0):
    """Yield the full tables of the buckets of ``records`` (h, text, largest, n).

    A table that passes ``memory`` bytes is poured out into ``fan_out`` spill
    files by the level's four bits of the hash, with all that follows; each
    file is then handled alike by the next bits. Sixteen levels use up the
    hash: what is left then are texts of one hash, which one table holds.
    """
    table, files = Table(), None
    for r in records:
        if files is None:
            table.add(*r)
            if table.bytes > memory and level < 15:
                files = [tempfile.TemporaryFile(prefix="plexus-grace-") for _ in range(fan_out)]
                for x in table.rows():
                    pickle.dump(x, files[x[0] >> 4 * (15 - level) & fan_out - 1])
                table = Table()
        else:
            pickle.dump(r, files[r[0] >> 4 * (15 - level) & fan_out - 1])
    if files is None:
        yield table
        return
    for f in files:
        f.seek(0)
        yield from grace(spilled(f), memory, fan_out, level + 1)
        f.close()


def spilled(f):
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def batches_of(table: Table, id_type: pa.DataType, size: int = 500):
    rows = list(table.rows())
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows[i : i + size], strict=True), (pa.int64(), pa.string(), id_type, pa.int64()), strict=True)], names=["h", "text", "largest", "n"])


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise=lambda c: c, memory: int = 48_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    normalise: a Column function that texts are compared after (none by
    default). Null texts are as empty. Of equal texts the row with the largest
    doc_id stays; rows that repeat that doc_id stay with it, and null ids count
    as the smallest (a group of null ids only has keep_id null and keeps all
    its rows). Ids may be numbers or strings, other columns may have any names.
    An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text)
    content: Column = F.coalesce(normalise(F.col("text")), F.lit(""))
    rows = rows.select("doc_id", content.alias("text"))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def own_repeats(batches):
        table = Table()
        for b in batches:
            for h, t, i in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                table.add(h, t, i, 1)
            if table.bytes > memory:
                yield from batches_of(table, id_type)
                table = Table()
        yield from batches_of(table, id_type)

    def verdicts(batches):
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        for table in grace(rows, memory):
            if table.texts:
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t.encode()).hexdigest() for t in table.texts], type=pa.string()), pa.array(table.largest, type=id_type), pa.array(table.counts, type=pa.int64())], names=["text_sha256", "keep_id", "group_size"])

    distinct = rows.select(F.xxhash64("text").alias("h"), "text", "doc_id").mapInArrow(own_repeats, records(kind))
    found = distinct.repartition("h").mapInArrow(verdicts, verdict_rows(kind))
    return (
        rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
        .join(found, "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
    )
