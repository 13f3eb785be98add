"""Language identification in two steps: first the family, then the language within it.

Both steps are one-versus-one linear support vector machines over hashed byte
n-grams of the whole text. They are fitted on the driver on a bounded sample:
at most ``sample`` labelled texts of each language and ``total`` of all, those
with the smallest hashes of id and text. The features of whole texts are
computed by the executors; only those (a few KB a text) go to the driver.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexus.llm.rows import identity, numbered, pick, place
from plexus.plans.scratch import bounded, held, lean, settled, small_batches

LETTER = re.compile(r"[^\W\d_]")
BITS = 13
#: Families of languages; one that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr"),
}


def family_of(lang: str) -> str:
    return next((f for f, of in FAMILIES.items() if lang in of), lang)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 1- to 3-grams, of unit length."""
    b = np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    total = np.zeros(1 << BITS)
    for i in range(0, len(b), 1 << 20):
        part = b[i : i + (1 << 20) + 3].astype(np.uint32)
        gram = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, 4):
            gram = gram[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :] if n > 1 else part
            end = min(len(gram), 1 << 20)
            total += np.bincount((gram[:end] * np.uint32(2654435769) + np.uint32(n)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    v = np.sqrt(total)
    return v / max(np.linalg.norm(v), 1e-12)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear SVM (hinge loss, y of -1 and 1) by dual coordinate descent; the bias is a constant feature."""
    w, bias, alpha, norm = np.zeros(x.shape[1]), 0.0, np.zeros(len(x)), np.einsum("ij,ij->i", x, x) + 1
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i] + bias) - 1) / norm[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                bias += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, float(bias)


class Votes:
    """One-versus-one machines between classes; the winner has most votes, then most margin."""

    def __init__(self, x: np.ndarray, y: list[str]):
        self.classes = sorted(set(y))
        own = np.array(y)
        self.pairs = []
        w, bias = [], []
        for a, b in combinations(range(len(self.classes)), 2):
            at = np.flatnonzero((own == self.classes[a]) | (own == self.classes[b]))
            v, c = fit_svm(x[at], np.where(own[at] == self.classes[a], 1.0, -1.0))
            w.append(v)
            bias.append(c)
            self.pairs.append((a, b))
        self.w = np.array(w, dtype=np.float32).reshape(len(w), x.shape[1])
        self.bias = np.array(bias)

    def of(self, v: np.ndarray) -> tuple[str, float]:
        """(class, a score from 0 to 1: the least certain of the winner's machines)."""
        if not self.pairs:
            return self.classes[0], 1.0
        margin = self.w @ v + self.bias
        votes = np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, margin, strict=True):
            votes[a if m >= 0 else b] += 1 + np.tanh(abs(m)) / len(self.pairs) / 2
        best = int(np.argmax(votes))
        won = min(m if a == best else -m for (a, b), m in zip(self.pairs, margin, strict=True) if best in (a, b))
        return self.classes[best], float(1 / (1 + np.exp(-np.clip(4 * won, -50, 50))))


class Model:
    """Machines between families, and between the languages of each family; a class of its own needs none."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        """x: a row of features for each text."""
        self.family = None
        if langs:
            kin = [family_of(k) for k in langs]
            self.family = Votes(x, kin)
            at = {f: [i for i, k in enumerate(kin) if k == f] for f in set(kin)}
            self.within = {f: Votes(x[i], [langs[k] for k in i]) for f, i in at.items()}

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or self.family is None or not LETTER.search(text):
            return "und", 0.0
        v = features(text).astype(np.float32)
        f, p = self.family.of(v)
        lang, q = self.within[f].of(v)
        return lang, min(1.0, max(0.0, p * q))


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def spread(parts: tuple[bytes, bytes]) -> np.ndarray:
    """Features from their places and values."""
    x = np.zeros(1 << BITS, dtype=np.float32)
    x[np.frombuffer(parts[0], dtype="<u2")] = np.frombuffer(parts[1], dtype="<f4")
    return x


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 300, total: int = 20_000) -> Model:
    """Fit on texts that aren't held out and have a language and a letter: at most ``sample`` a language, and ``total`` in all.

    The bound is on texts, each of which is learned from as a whole; rows that
    repeat an id and a text are one. With over total / sample languages each
    has an equal share of ``total``, but no fewer than 30. The driver gets the
    features of these texts (under 50 KB each) and no text.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, id=doc_id, t=text, l=lang)
    ka, kb = identity(F.col("id"), F.col("t"))
    usable = rows.where(~held_out(F.col("id")) & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}")).select("l", "t", ka.alias("ka"), kb.alias("kb"))
    # A hash's place in the range of all hashes, by powers of two: 64 estimates a language tell up to which power the sample
    # reaches, so the rows that are ranked are about as many as the sample at every size of the corpus.
    power = F.floor(F.log2(F.greatest(F.col("ka") / 2.0**64 + 0.5, F.lit(2.0**-63))))
    sizes = held(usable.groupBy("l", power.alias("p")).agg(F.approx_count_distinct("ka", 0.02).alias("n")))
    sample = max(min(sample, 30), min(sample, total // max(1, sizes.select("l").distinct().count())))
    so_far = Window.partitionBy("l").orderBy("p")
    reach = settled(sizes.withColumn("n", F.sum("n").over(so_far)).groupBy("l").agg(F.coalesce(F.min(F.when(F.col("n") >= 1.2 * sample, F.col("p"))), F.lit(0)).alias("reach")), "reach")
    near = usable.select("l", "ka", "kb", power.alias("p")).join(bounded(reach), "l").where("p <= reach").select("l", "ka", "kb").distinct()
    chosen = settled(near.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("ka", "kb"))).where(F.col("k") <= sample).drop("k"), "chosen")

    def over(batches):
        for b in batches:
            x = [features(t).astype("<f4") for t in b.column(3).to_pylist()]
            at = [np.flatnonzero(v) for v in x]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([a.astype("<u2").tobytes() for a in at], type=pa.binary()), pa.array([v[a].tobytes() for v, a in zip(x, at, strict=True)], type=pa.binary())], names=["l", "ka", "kb", "at", "x"])

    picked = usable.join(bounded(chosen), ["l", "ka", "kb"], "left_semi").select("l", "ka", "kb", "t")
    picked = picked.mapInArrow(lambda b: lean(over(b)), T.StructType([*picked.schema.fields[:3], T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType())]))
    # Repeats have the same features; those of one task meet in a partial aggregate, and the sample bounds what is left.
    learned = sorted((tuple(r) for r in picked.groupBy("l", "ka", "kb").agg(F.min("at").alias("at"), F.min("x").alias("x")).collect()), key=lambda r: r[:3])
    x = np.zeros((len(learned), 1 << BITS), dtype=np.float32)
    for i, r in enumerate(learned):
        x[i] = spread(r[3:])
    return Model(x, [r[0] for r in learned])


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = (), **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns of ``keep``, held_out, lang_pred, score.

    lang_pred is a learned language, or ``und`` with score 0 if the text is
    null, has no letter, or nothing could be learned; with one language (or one
    in a family) there is nothing to decide there, and its part of the score is
    1. The whole text is read; no other column is an input. Repeated rows give
    repeated results; ids may be null or of any type, other columns may have
    any names; an empty table gives an empty one.
    """
    model = fit(docs, doc_id, text, lang, **how)
    by = numbered(docs)
    wanted = [f"c{place(docs, c)}" for c in (doc_id, *keep)]
    rows = by.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(wanted)), held_out(F.col(wanted[0])).alias("held_out"), F.col(f"c{place(docs, text)}").alias("t"))
    return predicted(rows, model).toDF("doc_id", *keep, "held_out", "lang_pred", "score")


def predicted(rows: DataFrame, model: Model) -> DataFrame:
    """All columns of ``rows`` but the last, a text, then lang_pred and score of it."""
    small_batches(rows.sparkSession)
    fields = rows.schema.fields[:-1]
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def over(batches):
        for b in batches:
            found = [model.predict(t) for t in b.column(len(fields)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(fields))), pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())], names=[f.name for f in [*fields, *new]])

    return rows.mapInArrow(lambda b: lean(over(b)), T.StructType([*fields, *new]))


def keep_known(docs: DataFrame, min_score: float = 0.1) -> DataFrame:
    """The rows and columns of ``docs`` whose language is told; ``und`` and scores under ``min_score`` go. lang becomes the prediction where it is null.

    Columns may have any names and repeat; doc_id, text and lang are found by their exact names.
    """
    rows, text, lang = numbered(docs), f"c{place(docs, 'text')}", f"c{place(docs, 'lang')}"
    seen = predicted(rows.select("*", F.col(text).alias("t")), fit(docs))
    known = seen.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return known.select(*(F.coalesce(c, "lang_pred").alias(c) if c == lang else c for c in rows.columns)).toDF(*docs.columns)
