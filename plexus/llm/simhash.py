"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are linked at ``threshold`` or fewer differing bits.
The anchors are the words of a covering code on 46 of the bits: the product of
two perfect binary Golay codes (23, 12), each of covering radius 3. Every
fingerprint goes to every anchor within the covering radius plus the threshold
(taken per block: 3 + i bits in one block and 3 + j in the other, i + j at most
the threshold); about 61 of 16.8 million anchors for threshold 2. A linked
pair meets at the nearest anchor of either, so each anchor only compares those
that are nearest to it (its home) with all that came.

An anchor's links are emitted as spanning forests of the rows that are compared
at a time. Homes come first, so that members pass by them in a stream and no
anchor's members are ever collected. An anchor with a crowded home is divided exactly: of threshold + 1
bit blocks of a linked pair at least one is equal, so its members are dealt
again by anchor, block number and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexus.llm.rows import identity, numbered, pick, place
from plexus.plans.components import connected_components
from plexus.plans.scratch import bounded, held, lean, materialise, settled, small_batches

GOLAY = 0b110001110101  # fixed value: a generator polynomial of the (23, 12) code
RADIUS = 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Of words without white space, A-Z lower-cased; repeats of shingles count. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only 09-0D and 20 divide
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp, ka, kb) of all rows; fp holds the 64 bits as a signed long, ka and kb are hashes of id and text."""
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text)
    ka, kb = identity(F.col("doc_id"), F.col("text"))
    rows = rows.select("doc_id", ka.alias("ka"), kb.alias("kb"), "text")

    def over(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(3).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(1), b.column(2)], names=["doc_id", "fp", "ka", "kb"])

    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("fp", "ka", "kb"))])
    return rows.mapInArrow(lambda b: lean(over(b)), schema)


def syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    v = v.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GOLAY << (bit - 11), 0)
    return v


class Covering:
    """For each syndrome: the ways to a code word, as changes of its 12 message bits, by weight."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        words = np.arange(1 << 23, dtype=np.int32)
        weight = np.bitwise_count(words)
        near = words[weight <= RADIUS + threshold]
        weight = weight[near]
        s = syndromes(near)
        order = np.lexsort((weight, s))
        self.change = (near[order] >> 11).astype(np.int32)
        s, weight = s[order], weight[order]
        # reach[w][s]: where the ways of weight RADIUS + w or less of syndrome s end
        self.start = np.searchsorted(s, np.arange(2048))
        self.reach = [self.start + np.bincount(s[weight <= RADIUS + w], minlength=2048) for w in range(threshold + 1)]

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the fingerprint, anchor, home) of all replicas of unsigned fingerprints."""
        low, high = (fps & np.uint64(0x7FFFFF)).astype(np.int64), (fps >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
        s, t = syndromes(low), syndromes(high)
        parts = []
        for i in range(self.threshold + 1):
            # ways of weight RADIUS + i in the low block (at i = 0 also all lighter ones), with all of RADIUS + threshold - i in the high block
            a = self.start[s] if i == 0 else self.reach[i - 1][s]
            n, m = self.reach[i][s] - a, self.reach[self.threshold - i][t] - self.start[t]
            each = n * m
            who = np.repeat(np.arange(len(fps)), each)
            k = np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each)
            x, y = self.change[a[who] + k // m[who]], self.change[self.start[t][who] + k % m[who]]
            anchor = ((low >> 11)[who] ^ x) << 12 | ((high >> 11)[who] ^ y)
            # the first way of each block is the lightest; the code is perfect, so it alone is within the radius
            parts.append((who, anchor, (k == 0) if i == 0 else np.zeros(len(k), dtype=bool)))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def forest(home: np.ndarray, members: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between members of one anchor that suffice to connect all pairs (home, member) within the threshold."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    out = []
    for x in home.tolist():
        for y in members[np.bitwise_count(members ^ np.uint64(x)) <= threshold].tolist():
            if (a := top(x)) != (b := top(y)):
                root[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def gathered(batches, rows: int = 50_000):
    """The columns of batches as arrays (key, fp, home), of about ``rows`` rows at a time."""
    have, size = [], 0
    for b in batches:
        have.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)))
        size += b.num_rows
        if size >= rows:
            yield tuple(np.concatenate(x) for x in zip(*have, strict=True))
            have, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*have, strict=True))


def links_of(batches, threshold: int):
    """Streams rows (key, fp, home) sorted by key, homes first; yields the links of each key's group.

    Of a group that goes on in the next rows only the homes are kept, as those are compared with all that comes.
    """
    last, homes = None, np.zeros(0, dtype=np.uint64)
    for key, fp, home in gathered(batches):
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        n = np.add.reduceat(home.astype(np.int64), starts)
        found = []
        todo = np.flatnonzero((n > 0) & (ends - starts > 1))
        if key[0] == last:  # this group has begun before
            f, h = fp[: ends[0]], home[: ends[0]]
            new = f[h]
            found += forest(homes, f, threshold) + (forest(new, f, threshold) if len(new) else [])
            homes = np.concatenate((homes, new))
            todo = todo[todo > 0]
        for k in todo:
            f, h = fp[starts[k] : ends[k]], home[starts[k] : ends[k]]
            found += forest(f[h], f, threshold)
        if len(starts) > 1 or key[0] != last:
            last, homes = key[-1], fp[starts[-1] :][home[starts[-1] :]]
        a = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def fingerprint_links(distinct: DataFrame, threshold: int = 2, crowd: int = 4096) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` exactly as all pairs within ``threshold`` do."""

    def replicas(batches):
        code = None
        for b in batches:
            code = code or Covering(threshold)
            fps = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 2000):
                who, anchor, home = code.anchors(fps[i : i + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[i : i + 2000][who].view(np.int64)), pa.array(home)], names=["key", "fp", "home"])

    def homes(batches):
        code = None
        for b in batches:
            code = code or Covering(0)
            _, anchor, _ = code.anchors(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor)], names=["key"])

    rows = distinct.select("fp").mapInArrow(lambda b: lean(replicas(b)), "key long, fp long, home boolean")
    crowded = held(distinct.select("fp").mapInArrow(lambda b: lean(homes(b)), "key long").groupBy("key").count().where(F.col("count") > crowd).select("key"))
    if not crowded.isEmpty():
        width = -(-64 // (threshold + 1))
        block = F.expr(f"shiftrightunsigned(fp, cast(j * {width} as int)) & {(1 << width) - 1}L")
        divided = rows.join(crowded, "key").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(threshold)))).select(F.xxhash64("key", "j", block).alias("key"), "fp", "home")
        rows = rows.join(crowded, "key", "left_anti").unionByName(divided)
    return rows.repartition("key").sortWithinPartitions("key", F.desc("home")).mapInArrow(lambda b: lean(links_of(b, threshold)), "a long, b long")


def grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, threshold: int) -> DataFrame:
    """Rows (doc_id, fp, ka, kb, first) of all rows; first (none, doc_id, ka, kb) is the least of the row's component."""
    rows = materialise(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = held(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ka", "kb")).alias("least")))
    labels = connected_components(fingerprint_links(distinct, threshold))
    member = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = member.groupBy("label").agg(F.min("least").alias("first"))
    return rows.join(member.join(named, "label").select("fp", "first"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Components follow links of ``threshold`` or fewer differing bits between
    fingerprints, over any number of steps; component_id is the smallest doc_id
    of the component. Texts without words, null and empty ones among them, have
    fingerprint zero and are linked like any other. Null ids are never a
    component's id unless all its ids are null (then null). Repeated rows
    give repeated results; ids may be of any type that has an order; other
    columns may have any names; an empty table gives an empty result.
    """
    found = grouped(docs, doc_id, text, shingle, threshold)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """The rows of ``docs`` that are the first of their component.

    That is the smallest doc_id (null ids come last), and of several texts of
    that id the one with the least hash. Rows that repeat id and text are one
    document and stay or go together; another text of the same id is judged on
    its own. Columns may have any names.
    """
    found = grouped(docs, "doc_id", "text", shingle, threshold)
    away = settled(found.where("ka <> first.ka or kb <> first.kb").select("ka", "kb").distinct(), "copies")
    rows = numbered(docs)
    ka, kb = identity(F.col(f"c{place(docs, 'doc_id')}"), F.col(f"c{place(docs, 'text')}"))
    return rows.select("*", ka.alias("ka"), kb.alias("kb")).join(bounded(away), ["ka", "kb"], "left_anti").select(rows.columns).toDF(*docs.columns)
