"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

``Pieces`` reads a model file and encodes by a score-ordered agenda: of all
adjacent symbol pairs that form a piece, the one of the best score, then of the
first position, is merged until none is left. A long run keeps its agenda in a
heap; the short runs of a batch keep theirs as the rows of one matrix, and each
step merges the best pair of every row. No piece of
such a vocabulary goes over from a non-space symbol to the space mark (checked
when the file is read; otherwise texts are encoded whole), so the runs of
"space marks, then other symbols" of a text are independent and remembered.
Every Arrow batch holds the ids of all its whole texts against the
sentencepiece library's and stops the job at a difference.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import types
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexus.llm.rows import numbered, place
from plexus.plans.scratch import lean, small_batches

MARK = "▁"
RUNS = re.compile(f"{MARK}+[^{MARK}]*")


#: The longest run, in symbols, that goes into the matrix.
SHORT = 32
#: Bytes that Python takes for an entry of a dictionary, a short string and a bytes object.
ENTRY = 180


def packed(ids) -> bytes:
    return array("i", ids).tobytes()


class Pairs:
    """The pairs of pieces that form a piece, in an open-addressing table, and agendas as rows of a matrix."""

    def __init__(self, ids: dict[str, int], rank: dict[str, float], outside):
        self.outside = outside
        of = [(ids[p[:k]] << 20 | ids[p[k:]], rank[p], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.bits = max(4, (6 * len(of)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, np.inf, dtype=np.float32)  # scores of merges are whole numbers that it holds exactly
        self.merged = np.zeros(1 << self.bits, dtype=np.int32)
        left = np.array([x[0] for x in of], dtype=np.int64)
        for key, rank_, i, at in zip(left.tolist(), (x[1] for x in of), (x[2] for x in of), self.slot(left).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = at + 1 & (1 << self.bits) - 1
            self.keys[at], self.ranks[at], self.merged[at] = key, rank_, i
        self.symbols = np.full(0x110000, -1, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; infinity where they form no piece."""
        key = np.where((a < 0) | (b < 0), -2, a.astype(np.int64) << 20 | b)
        at = self.slot(key)
        rest = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        while len(rest):
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
            rest = rest[(self.keys[at[rest]] != key[rest]) & (self.keys[at[rest]] != -1)]
        return self.ranks[at], self.merged[at]

    def encode(self, runs: list[str]):
        """The packed ids of runs of two to SHORT symbols."""
        n = np.array([len(r) for r in runs])
        width = int(n.max())
        code = np.array(runs, dtype=f"<U{width}").view(np.uint32).reshape(len(runs), width)
        known = self.symbols[code]
        # A symbol outside the vocabulary merges with nothing; its code point goes along below zero.
        sym = np.where(np.arange(width) < n[:, None], np.where(known >= 0, known, -2 - code.astype(np.int32)), np.int32(-1))
        odd = (sym < -1).any(axis=1).tolist()
        n, alive = n.copy(), np.arange(len(runs))
        out = sym.copy()
        rank, new = (x.reshape(len(runs), width - 1) for x in self.look(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        while len(alive):
            k = np.arange(len(alive))
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(alive), dtype=np.int64)
            go = rank[k, at] < np.inf if rank.shape[1] else np.zeros(len(alive), dtype=bool)
            if not go.all():
                out[alive[~go], : sym.shape[1]] = sym[~go]
                sym, rank, new, alive, at = sym[go], rank[go], new[go], alive[go], at[go]
                k = k[: len(alive)]
                if not len(alive):
                    break
            n[alive] -= 1
            piece = new[k, at]
            # Every row merges one pair, so all rows are a symbol shorter: what stands behind the pair moves up by one.
            column, place = np.arange(sym.shape[1] - 1, dtype=np.int32), at.astype(np.int32)[:, None]
            sym = np.where(column > place, sym[:, 1:], sym[:, :-1])
            sym[k, at] = piece
            behind = column[:-1] >= place
            rank, new = np.where(behind, rank[:, 1:], rank[:, :-1]), np.where(behind, new[:, 1:], new[:, :-1])
            right = np.flatnonzero(at + 1 < sym.shape[1])
            rank[right, at[right]], new[right, at[right]] = self.look(sym[right, at[right]], sym[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1], new[left, at[left] - 1] = self.look(sym[left, at[left] - 1], sym[left, at[left]])
        flat = out[np.arange(width) < n[:, None]].astype(np.int32).tobytes()
        ends = np.cumsum(4 * n).tolist()
        return [packed(self.outside(np.frombuffer(flat[a:b], dtype=np.int32).tolist())) if o else flat[a:b] for a, b, o in zip([0, *ends], ends, odd, strict=False)]


class Pieces:
    """A BPE vocabulary with byte fallback, identity normalisation and a leading space mark."""

    def __init__(self, model: bytes, remember: int = 45_000_000):
        """remember: bytes of runs and ids that are kept, with Python's own for each entry."""
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.vocab_size()
        kinds = {i: self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(n)}
        self.eos = self.library.eos_id()
        self.unknown = self.library.unk_id()
        self.bytes = {int(self.library.id_to_piece(i)[3:5], 16): i for i in range(n) if self.library.is_byte(i)}
        self.ids = {self.library.id_to_piece(i): i for i in range(n) if not kinds[i]}
        self.rank = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        if self.library.normalize("a  bÅﬁ") != f"{MARK}a{MARK}{MARK}bÅﬁ":
            raise ValueError("only vocabularies with identity normalisation and a leading space mark are supported")
        self.remember = remember
        self.matrix = Pairs(self.ids, self.rank, self.outside) if all(c in self.ids for p in self.ids for c in p) else None
        self.known: dict[str, bytes] = {}  # of packed ids
        self.size = 0  # bytes of known

    def run(self, s: str) -> tuple[int, ...]:
        """The ids of one independent run of symbols, by the agenda."""
        rank, n = self.rank, len(s)
        sym = list(s)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = s[i : i + 2]
            if pair in rank:
                agenda.append((rank[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            left = sym[i]
            if not left:
                continue
            j = nxt[i]
            if j >= n or len(left) + len(sym[j]) != len(piece) or left + sym[j] != piece:
                continue
            sym[i], sym[j] = piece, ""
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (pair := piece + sym[k]) in rank:
                    heapq.heappush(agenda, (rank[pair], i, pair))
            if (h := prv[i]) >= 0 and (pair := sym[h] + piece) in rank:
                heapq.heappush(agenda, (rank[pair], h, pair))
        return self.outside([self.ids.get(piece, -2 - ord(piece[0])) for piece in sym if piece])

    def outside(self, symbols: list[int]) -> tuple[int, ...]:
        """Ids, with bytes (or else the unknown id, once in a row) for symbols outside the vocabulary (-2 less the code point)."""
        out: list[int] = []
        for i in symbols:
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-2 - i).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def runs(self, text: str) -> list[str]:
        """The independent runs of a text, each without its first space mark."""
        if not text:
            return []
        if self.separable and "  " not in text and text[0] != " " and MARK not in text:
            return text.split(" ")
        marked = MARK + text.replace(" ", MARK)
        return [r[1:] for r in RUNS.findall(marked)] if self.separable else [marked[1:]]

    def packed_ids(self, runs: list[str], fresh: dict[str, bytes]) -> bytes:
        """The packed ids of runs, one after the other."""
        if not fresh:
            return b"".join(map(self.known.__getitem__, runs))
        known = self.known
        return b"".join([known.get(r) or fresh[r] for r in runs])

    def encode(self, text: str | None) -> list[int]:
        """All ids of a whole text, the end id last; null is as empty."""
        runs = self.runs(text or "")
        return [*np.frombuffer(self.packed_ids(runs, self.learn([runs])), dtype=np.int32).tolist(), self.eos]

    def trim(self) -> None:
        """Keep half of what may be remembered: what came first, which is what comes often."""
        self.size, stay = 0, 0
        for r, ids in self.known.items():
            if self.size > self.remember // 2:
                break
            self.size += len(r) + len(ids) + ENTRY
            stay += 1
        self.known = dict(islice(self.known.items(), stay))

    def learn(self, texts: list[list[str]]) -> dict[str, bytes]:
        """Encode the runs of a batch that are not yet remembered; long runs come back and are not remembered."""
        new = set(chain.from_iterable(texts)).difference(self.known)
        if self.size > self.remember:
            self.trim()
            new = set(chain.from_iterable(texts)).difference(self.known)
        by_length: dict[int, list[str]] = {}
        for r in new:
            by_length.setdefault(min(len(r), SHORT) + 4 >> 2, []).append(r)
        long = {r: packed(self.run(MARK + r)) for r in by_length.pop(SHORT + 4 >> 2, ())}
        for some in by_length.values():
            for i in range(0, len(some), 20_000):
                part = some[i : i + 20_000]
                ids = self.matrix.encode([MARK + r for r in part]) if self.matrix else [packed(self.run(MARK + r)) for r in part]
                self.known.update(zip(part, ids, strict=True))
                self.size += sum(map(len, part)) + sum(map(len, ids)) + ENTRY * len(part)
        return long

    def checked(self, texts: list[str], own: list[bytes]) -> list[list[int]]:
        """The ids of whole texts (without the end id), held against the library's."""
        its = self.library.encode(texts)
        for text, a, b in zip(texts, own, its, strict=True):
            if a != packed(b):
                raise AssertionError(f"the agenda and the library differ on a text of {len(text)} symbols")
        return its


def portions(batch: pa.RecordBatch, column: int, size: int = 2_000_000):
    """Parts of a batch of about ``size`` bytes of text, or one row if its text is longer."""
    start = total = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if total and total + (n or 0) > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def load(model_path: str) -> bytes:
    with open(model_path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = False) -> DataFrame:
    """Encode and decode every whole text; one row per row of ``docs``, no shuffle.

    Returns the columns of ``keep`` (by their exact names; others may have any
    names), then n_tokens, ids_sha256, decoded_sha256; with ``full`` also ids array<int> and
    decoded string. Null texts are as empty: the end id alone, decoded to "".
    Repeated rows give repeated results; an empty table gives an empty one.
    The model file (well under 10 MB, checked) goes along with the tasks.
    """
    small_batches(docs.sparkSession)
    model = load(model_path)
    if len(model) > 10_000_000:
        raise ValueError("a vocabulary of over 10 MB isn't shipped with the tasks")
    rows = numbered(docs).select(*(F.col(f"c{place(docs, c)}").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"c{place(docs, text)}").alias("t"))
    fields = rows.schema.fields[:-1]
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if full:
        new += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def over(batches):
        # Workers that take further tasks keep the vocabulary and the runs that came first.
        kept = vars(sys.modules.setdefault("plexus_worker_state", types.ModuleType("plexus_worker_state"))).setdefault("pieces", {})
        pieces = kept.get(model) or kept.setdefault(model, Pieces(model))
        spelled = [str(i) for i in range(pieces.library.vocab_size())].__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in (part for b in batches for part in portions(b, len(fields))):
            texts = [t or "" for t in batch.column(len(fields)).to_pylist()]
            cut = [pieces.runs(t) for t in texts]
            fresh = pieces.learn(cut)
            rows, plain = [], []
            for ids in pieces.checked(texts, [pieces.packed_ids(t, fresh) for t in cut]):
                ids.append(pieces.eos)
                decoded = pieces.library.decode(ids)
                rows.append((len(ids), sha(" ".join(map(spelled, ids))), sha(decoded)))
                if full:
                    plain.append((ids, decoded))
            columns = [*(batch.column(i) for i in range(len(fields))), *(pa.array([r[i] for r in rows], type=k) for i, k in enumerate((pa.int64(), pa.string(), pa.string())))]
            if full:
                columns += [pa.array([p[0] for p in plain], type=pa.list_(pa.int32())), pa.array([p[1] for p in plain], type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + [f.name for f in new])
        pieces.trim()

    return rows.mapInArrow(lambda b: lean(over(b)), T.StructType([*fields, *new])).toDF(*keep, *(f.name for f in new))
