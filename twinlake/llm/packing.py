"""Sequence packing along a space-filling curve.

Each document becomes a hashed bag of token ids, projected to three dimensions; the Hilbert
key of that point puts similar documents next to each other. Documents are cut every 1024
ids; whole pieces fill a sequence each, the remainders of neighbours on the curve share
sequences by best fit. Only pieces (a few numbers each) are range-sorted, never the ids.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm._stage import shuffle_partitions, stage

DIMS, BITS, BUCKETS = 3, 10, 256
PIECES = "doc_id long, key long, tie long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(1)
def encoder(json_path: str):
    """Text to ids, as ``tokenizers`` gives them without special tokens.

    The ids come from the same vocabulary's rank file, which lies beside ``json_path``,
    by tiktoken: the same ids in a fifth of the time. A text that its pattern engine gives up
    on (white space by the million), or a vocabulary without a rank file, goes to ``tokenizers``.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    ranks = json_path.removesuffix(".json") + ".tiktoken"

    @lru_cache(1)
    def plain():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    if not os.path.exists(ranks):
        return lambda text: np.array(plain().encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # the pattern engine's own limits
            return np.array(plain().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (n, d) below 2**bits, by Skilling's transposed form (2004)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Keys of hashed bags (n, BUCKETS): square roots, unit length, a fixed random projection to DIMS."""
    v = np.sqrt(counts.astype(np.float64))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    axes = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
    axes /= np.linalg.norm(axes, axis=0)
    cells = np.clip((v @ axes + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64), BITS)


class Fitter:
    """Best fit into open sequences; a sequence closes when full or when too many are open."""

    def __init__(self, size: int, first: int, most_open: int = 256):
        self.size, self.next, self.most_open = size, first, most_open
        self.room: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        above = self.mask >> length
        if above and length:
            room = length + (above & -above).bit_length() - 1
            seq = self.room[room].pop()
            if not self.room[room]:
                self.mask &= ~(1 << room)
            self.open -= 1
        else:
            room, seq = self.size, self.next
            self.next += 1
        left = room - length
        if left:
            self.room[left].append(seq)
            self.mask |= 1 << left
            self.open += 1
        return seq, self.size - room

    def trim(self) -> None:
        """Close the fullest open sequences beyond the most that may stay open."""
        room = 1
        while self.open > self.most_open:
            n = min(len(self.room[room]), self.open - self.most_open)
            if n:
                del self.room[room][:n]
                self.open -= n
                if not self.room[room]:
                    self.mask &= ~(1 << room)
            room += 1


def pieces(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """Documents as pieces of at most ``size`` ids, each with its document's curve key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            rows, counts, which = [], np.zeros((b.num_rows, BUCKETS), np.int32), []
            for k, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                counts[k] = np.bincount(ids & (BUCKETS - 1), minlength=BUCKETS)
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    rows.append((at, len(part), zlib.crc32(part.tobytes()), len(ids)))
                    which.append(k)
            if not rows:
                continue
            at = pa.array(which, pa.int64())
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), pa.array(curve_keys(counts)).take(at), b.column("tie").take(at), *cols], names=["doc_id", "key", "tie", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, window: int = 4096) -> DataFrame:
    """Pack all rows into sequences of at most ``size`` ids; one row a piece.

    A document is its ids, then id 0. Returns doc_id, start (its ids before the piece),
    length, ids_crc32 (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset
    (gapless from 0 in each sequence). Remainders are fitted, the longest first, in windows of
    ``window`` neighbours on the curve, so sequences are nearly full; what is left open at the end
    of a task is padded. Null and empty texts are the single id 0; null ids are kept; repeated
    rows are packed each; an empty table gives no sequences. Equal documents have equal keys;
    a tie-break by a hash of the id spreads a key that many documents share over several tasks.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("tie"))
    cut = stage(pieces(own, tokenizer, size), "pieces")
    tasks = int(max(1, min(shuffle_partitions(docs.sparkSession), cut.count() // (2 * window))))
    order = ["key", "tie", "doc_id", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = Fitter(size, TaskContext.get().partitionId() << 32)
        for b in batches:
            for at in range(0, b.num_rows, window):
                part = b.slice(at, window)
                length = part.column("length").to_numpy()
                seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
                for i in np.argsort(-length, kind="stable").tolist():
                    seq[i], off[i] = fit.place(int(length[i]))
                fit.trim()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(seq), pa.array(off)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return cut.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, PACKED)
