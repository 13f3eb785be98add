"""Quality by an interpolated modified Kneser-Ney model of byte 4-grams.

The model is trained on the trusted texts but one in ten (by a hash of the
text), which set the thresholds. Counts of grams are summed per task, then by
gram. The lower orders count the bytes that a gram was seen behind; each order
has three discounts estimated from its own counts of counts, and leaves its
discounts to the order below; the last one leaves them to the uniform
distribution. Orders four and three are DataFrame aggregates.

Scoring is a count join in shards. The middle two bytes of a 4-gram decide its
shard, and every table that its probability needs shares them: the gram abcd,
the weight of its context abc, the gram bcd and the weight of bc. Orders two
and one (65,536 entries at most) go along with the tasks. Each task packs the
documents it reads into chunks; a chunk sends each shard its distinct grams
with documents and counts. Chunks are dealt to groups, and each group gets its
own copy of a shard of the model, so a gram that every document holds is not
counted by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plexus.llm.rows import pick
from plexus.plans.scratch import bounded, held, lean, materialise, small_batches

ORDER = 4


def grams(text: str) -> np.ndarray:
    """A byte's gram is it and the three before it; zeros stand before the text."""
    b = np.frombuffer(b"\0\0\0" + text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def gram_counts(texts: DataFrame) -> DataFrame:
    """Rows (gram, c) over all texts of the one column."""

    def over(batches):
        seen, counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        for b in batches:
            own = [grams(t) for t in b.column(0).to_pylist() if t]
            if own:
                g, c = np.unique(np.concatenate(own), return_counts=True)
                seen, at = np.unique(np.concatenate([seen, g]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, c]), minlength=len(seen)).astype(np.int64)
                if len(seen) > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts)], names=["gram", "c"])
                    seen, counts = seen[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts)], names=["gram", "c"])

    return texts.mapInArrow(lambda b: lean(over(b)), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> list[float]:
    """The discounts of counts of one, two, and three or more; n: how many grams have counts of one to four.

    Where an estimate is undefined (a corpus of few grams) it is half the
    count, and it is kept from 0.05 to the count, so that each order leaves
    something to the one below.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [max(0.05, min(k, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]


def smoothed(counts: DataFrame, low: int) -> tuple[DataFrame, DataFrame]:
    """(gram, p): the discounted share of a gram after its context; (context, g): the weight left to the lower order.

    low: bits of the gram that are its last byte (always 8); the context is the rest.
    """
    n = counts.agg(*(F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4))).first()
    d = discounts(list(n))
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    context = F.shiftright("gram", low)
    sums = counts.groupBy(context.alias("context")).agg(F.sum("c").alias("t"), F.sum(cut).alias("cut"))
    p = counts.withColumn("context", context).join(sums, "context").select("gram", ((F.col("c") - cut) / F.col("t")).alias("p"))
    return p, sums.select("context", (F.col("cut") / F.col("t")).alias("g"))


def lowest(two: np.ndarray) -> np.ndarray:
    """The interpolated probabilities of order two from its counts; order one counts the grams of two that end in a byte."""

    def cut_of(c: np.ndarray) -> np.ndarray:
        d = discounts([int((c == k).sum()) for k in (1, 2, 3, 4)])
        return np.choose(np.minimum(c, 3).astype(int), [0.0, *d])

    one = (two > 0).sum(axis=0).astype(float)
    cut = cut_of(one)
    p1 = (one - cut) / one.sum() + cut.sum() / one.sum() / 256 if one.sum() else np.full(256, 1 / 256)
    cut, total = cut_of(two), two.sum(axis=1, keepdims=True)
    return np.where(total > 0, (two - cut) / np.maximum(total, 1) + cut.sum(axis=1, keepdims=True) / np.maximum(total, 1) * p1, p1)


def shard_of(middle, shards: int):
    """middle: the two bytes that all entries of a shard share. The high bits of the product decide, as those follow from both bytes."""
    return (middle * 40503 & 0xFFFF) * shards >> 16


def train(texts: DataFrame, shards: int) -> tuple[DataFrame, np.ndarray]:
    """The shards' rows (shard, kind, key, value), and the probabilities of order two by (byte, byte)."""
    c4 = materialise(gram_counts(texts), "grams")
    c3 = materialise(c4.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.count("*").alias("c")), "grams3")
    c2 = c3.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.count("*").alias("c"))
    two = np.zeros((256, 256))
    for r in c2.collect():  # 65,536 rows at most
        two[r["gram"] >> 8, r["gram"] & 255] = r["c"]
    p4, g3 = smoothed(c4, 8)
    p3, g2 = smoothed(c3, 8)
    entry = lambda df, kind, key, value, middle: df.select(shard_of_column(F.expr(middle), shards).alias("shard"), F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(value).alias("value"))
    rows = entry(p4, 4, "gram", "p", "shiftright(gram, 8) & 65535")
    rows = rows.unionByName(entry(g3, 3, "context", "g", "context & 65535"))
    rows = rows.unionByName(entry(p3, 2, "gram", "p", "shiftright(gram, 8)"))
    rows = rows.unionByName(entry(g2, 1, "context", "g", "context"))
    return materialise(rows, "model"), lowest(two)


def shard_of_column(middle, shards: int):
    return F.shiftright((middle.cast("long") * 40503).bitwiseAND(0xFFFF) * shards, 16).cast("int")


def pack(texts: list[str], shards: int):
    """(shard, packed grams, documents and counts) of a chunk."""
    own = [grams(t) for t in texts]
    doc = np.repeat(np.arange(len(own), dtype=np.uint64), [len(g) for g in own])
    g = np.concatenate(own).astype(np.uint64) if own else np.zeros(0, dtype=np.uint64)
    key, c = np.unique(g << np.uint64(16) | doc, return_counts=True)
    gram, doc = (key >> np.uint64(16)).astype(np.uint32), (key & np.uint64(0xFFFF)).astype(np.uint16)
    shard = shard_of((gram >> 8 & 0xFFFF).astype(np.int64), shards)
    z = zstandard.ZstdCompressor(level=1)
    for s in np.unique(shard).tolist():
        at = shard == s
        x, d, n = gram[at], doc[at], c[at]
        new = np.flatnonzero(np.diff(x, prepend=x[0] ^ 1))
        step = np.diff(d, prepend=d[:1])
        step[new] = d[new]
        parts = [x[new], np.diff(np.append(new, len(x))).astype(np.uint16), step.view(np.uint8).reshape(-1, 2)[:, 0].copy(), step.view(np.uint8).reshape(-1, 2)[:, 1].copy(), np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.uint32)]
        yield s, [z.compress(p.tobytes()) for p in parts]


def unpack(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams, index of the gram, document, count) as packed."""
    z = zstandard.ZstdDecompressor()
    raw = [z.decompress(p) for p in parts]
    x, m = np.frombuffer(raw[0], dtype=np.uint32), np.frombuffer(raw[1], dtype=np.uint16).astype(np.int64)
    step = np.frombuffer(raw[2], dtype=np.uint8).astype(np.int64) + (np.frombuffer(raw[3], dtype=np.uint8).astype(np.int64) << 8)
    n = np.frombuffer(raw[4], dtype=np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(raw[5], dtype=np.uint32)
    which = np.repeat(np.arange(len(x)), m)
    first = np.cumsum(m) - m
    run = np.cumsum(step)
    return x, which, run - np.repeat(run[first] - step[first], m), n


def log_probabilities(x: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]], p2: np.ndarray) -> np.ndarray:
    """Natural logarithms of the interpolated probabilities of 4-grams."""

    def look(kind: int, key: np.ndarray, missing: float) -> np.ndarray:
        keys, values = tables.get(kind, (np.zeros(0, dtype=np.int64), np.zeros(0)))
        if not len(keys):
            return np.full(len(key), missing)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], missing)

    x = x.astype(np.int64)
    p = p2[x >> 8 & 255, x & 255]
    p = look(2, x & 0xFFFFFF, 0.0) + look(1, x >> 8 & 0xFFFF, 1.0) * p
    return np.log(np.maximum(look(4, x, 0.0) + look(3, x >> 8, 1.0) * p, 1e-12))


def perplexities(docs: DataFrame, trusted: DataFrame, shards: int = 64, chunk_bytes: int = 4_000_000, groups: int | None = None) -> DataFrame:
    """Rows (doc_id, lang, mark, perplexity per byte) for every row of ``docs``; null where the text is null or empty.

    docs: doc_id, lang, mark (a boolean that goes along), text. trusted: texts
    in one column, all of which are counted. groups: copies of the model's
    shards, by default one for four partitions of ``docs``. A task gets several
    of the shards * groups parts; the more there are, the more even are tasks.
    """
    docs = docs.select("doc_id", "lang", "mark", "text")
    id_type = docs.schema["doc_id"].dataType
    own = to_arrow_type(id_type)
    ids = T.ArrayType(id_type).simpleString()
    heads = f"ids {ids}, langs array<string>, marks array<boolean>, sizes array<long>"
    head_types = (pa.list_(own), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
    small_batches(docs.sparkSession)
    model, p2 = train(trusted, shards)
    groups = groups or max(1, docs.rdd.getNumPartitions() // 4)

    def chunks(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0

        def sent(ids, langs, flags, texts):
            chunk = part << 24 | k
            head = (chunk, -1, None, ids, langs, flags, [len(t.encode("utf-8", "surrogatepass")) for t in texts])
            rows = [head, *((chunk, s, p, None, None, None, None) for s, p in pack(texts, shards))]
            c = list(zip(*rows, strict=True))
            group = [(part + 7919 * k) % groups] * len(rows)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), *head_types)
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip((c[0], c[1], group, *c[2:]), kinds, strict=True)], names=["chunk", "shard", "grp", "parts", "ids", "langs", "marks", "sizes"])

        have, size = ([], [], [], []), 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for to, v in zip(have, (*row[:3], row[3] or ""), strict=True):
                    to.append(v)
                size += len(have[3][-1])
                if size >= chunk_bytes or len(have[3]) == 65_000:
                    yield sent(*have)
                    have, size, k = ([], [], [], []), 0, k + 1
        if have[0]:
            yield sent(*have)

    def score(packed: pa.Table, entries: pa.Table) -> pa.Table:
        kind, key, value = (entries.column(c).to_numpy() for c in ("kind", "key", "value"))
        tables = {}
        for i in (1, 2, 3, 4):
            at = np.flatnonzero(kind == i)
            at = at[np.argsort(key[at])]
            tables[i] = key[at], value[at]
        out = {"chunk": [], "sums": [], "ids": [], "langs": [], "marks": [], "sizes": []}
        for r in packed.drop_columns(["grp"]).to_pylist():
            sums = None
            if r["shard"] >= 0:
                x, which, doc, n = unpack(r["parts"])
                sums = np.bincount(doc, weights=n * log_probabilities(x, tables, p2)[which]).tolist()
            for c in out:
                out[c].append(sums if c == "sums" else r[c])
        kinds = (pa.int64(), pa.list_(pa.float64()), *head_types)
        return pa.table([pa.array(v, type=t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def finish(chunk: pa.Table) -> pa.Table:
        head, total = None, np.zeros(0)
        for r in chunk.to_pylist():
            if r["ids"] is not None:
                head = r
            else:
                n = max(len(total), len(r["sums"]))
                total = np.pad(total, (0, n - len(total))) + np.pad(np.array(r["sums"]), (0, n - len(r["sums"])))
        sizes = np.array(head["sizes"])
        total = np.pad(total, (0, len(sizes) - len(total)))
        ppl = [float(np.exp(-t / s)) if s else None for t, s in zip(total, sizes, strict=True)]
        return pa.table([pa.array(head["ids"], type=own), pa.array(head["langs"], type=pa.string()), pa.array(head["marks"], type=pa.bool_()), pa.array(ppl, type=pa.float64())], names=["doc_id", "lang", "mark", "perplexity"])

    packed = docs.mapInArrow(lambda b: lean(chunks(b)), f"chunk long, shard int, grp int, parts array<binary>, {heads}")
    copies = model.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    scored = packed.groupBy("shard", "grp").cogroup(copies.groupBy("shard", "grp")).applyInArrow(score, f"chunk long, sums array<double>, {heads}")
    return scored.groupBy("chunk").applyInArrow(finish, T.StructType([T.StructField("doc_id", id_type), T.StructField("lang", T.StringType()), T.StructField("mark", T.BooleanType()), T.StructField("perplexity", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, one_in: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, perplexity, threshold, kept.

    Trusted are the texts that ``labels`` (doc_id, quality, toxic) call good
    and not toxic. The model is trained on them but for one in ``one_in`` (by a
    hash of the text, so that copies go together); a language's threshold is the
    ``quantile`` of the perplexities of these, or that of all of them where it
    has none. A row is kept if its perplexity is not above its threshold. Null
    and empty texts have no perplexity and aren't kept; a null lang is a
    language of its own; rows and labels may repeat; without trusted texts held
    out nothing has a threshold and all rows with a text are kept. Ids may be
    of any type that labels share, other columns may have any names. An empty
    table gives an empty result.
    """
    known = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    good = bounded(held(known.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()))
    tested = F.pmod(F.xxhash64(F.lit("tested"), F.coalesce(F.col("text"), F.lit(""))), F.lit(one_in)) == 0
    rows = pick(docs, doc_id="doc_id", lang="lang", text="text").withColumn("mark", tested)
    trained = rows.where("not mark and text <> ''").join(good, "doc_id", "left_semi").select("text")
    scored = materialise(perplexities(rows, trained), "perplexities")
    pick_of = F.percentile_approx("perplexity", quantile, 10_000)
    sure = held(scored.where("mark and perplexity is not null").join(good, "doc_id", "left_semi").select("lang", "perplexity"))
    by_lang = sure.groupBy(F.col("lang").alias("l")).agg(pick_of.alias("own"))
    out = scored.join(bounded(held(by_lang)), F.col("lang").eqNullSafe(F.col("l")), "left")
    overall = sure.agg(pick_of.alias("overall")).first()["overall"]
    return out.select("doc_id", "lang", "perplexity", F.coalesce("own", F.lit(overall).cast("double")).alias("threshold")).withColumn("kept", F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))))
