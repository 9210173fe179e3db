"""Moving many small integer records between tasks as packed columns.

A window hash with its place in a document is a dozen bytes; as a row of its own it would
cost three times that. Here a task packs all records that go to one fragment into a few
binary rows: document ids as differences, run lengths per document, then plain columns.
Fragments are ranges of the hash order, so their sizes are even whatever the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlake.llm._stage import discard, stage

U = np.uint64
ROUTED = "dest int, payload binary"
ROUTED_ARROW = pa.schema([("dest", pa.int32()), ("payload", pa.binary())])
#: Rows on their way: those with a kind of 0 or more need no work in the fragment, and go on to the task of that number.
SEGMENTS = "dest int, kind int, payload binary"
SEGMENTS_ARROW = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def pack(*columns: np.ndarray) -> bytes:
    head = [len(columns)]
    for c in columns:
        head += [ord(c.dtype.kind) * 256 + c.dtype.itemsize, len(c)]
    return b"".join([np.array(head, np.int64).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def unpack(data) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for i in range(n):
        kind, size, count = chr(head[2 * i] // 256), int(head[2 * i] % 256), int(head[2 * i + 1])
        out.append(np.frombuffer(data, np.dtype(f"{kind}{size}"), count, at))
        at += size * count
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in 16 bits where they fit, else 32."""
    return x.astype(np.uint16 if not len(x) or int(x.max()) < 1 << 16 else np.uint32)


def pack_records(rid: np.ndarray, *columns: np.ndarray) -> bytes:
    """Records in runs of one document; the ids are kept once a run."""
    cut = np.flatnonzero(rid[1:] != rid[:-1]) + 1 if len(rid) else np.empty(0, np.int64)
    first = np.concatenate(([0], cut)) if len(rid) else cut
    ids = rid[first].astype(np.int64)
    return pack(np.diff(ids, prepend=np.int64(0)), narrow(np.diff(np.append(first, len(rid)))), *columns)


def unpack_records(data) -> list[np.ndarray]:
    ids, counts, *columns = unpack(data)
    return [np.repeat(np.cumsum(ids), counts.astype(np.int64)), *columns]


def gather(payloads: list, kinds: list) -> list[np.ndarray]:
    """The records of many payloads, one array a column; kinds are the dtypes to give them."""
    parts = [unpack_records(p) for p in payloads]
    return [np.concatenate([p[i] for p in parts]).astype(k, copy=False) if parts else np.empty(0, k) for i, k in enumerate(kinds)]


def fragment_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the hash order holds h."""
    return (((h >> U(32)) * U(n)) >> U(32)).astype(np.int32)


def spread(rid: np.ndarray, n: int) -> np.ndarray:
    """The task of a document; the same as spread_column."""
    r = rid.astype(np.int64).view(U)
    return ((r ^ (r >> U(9)) ^ (r >> U(21))).view(np.int64) % n).astype(np.int32)


def spread_column(rid: str, n: int):
    return F.expr(f"cast(pmod({rid} ^ shiftrightunsigned({rid}, 9) ^ shiftrightunsigned({rid}, 21), {n}L) as int)")


def split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each key, in order."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)])) if len(k) else [0]
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield int(k[i]), order[i:j]


def batched(records: Iterator[tuple[np.ndarray, ...]], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of many small groups of records as fewer large ones, so that what a fragment gets from a task is worth a row."""
    held, n = [], 0
    for r in records:
        held.append(r)
        n += len(r[0])
        if n >= most:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def routed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=ROUTED_ARROW)


def segments(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=SEGMENTS_ARROW)


def row_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (id, text and others) with ``rid``, a distinct long a row whose order is that of the ids.

    Where the ids are whole numbers, distinct and not null, they serve themselves. Else rows are
    numbered in the order of id (null first), then text, and the numbered table is written down:
    a range sort, whose ties a row number spreads, then each partition's rows after those of
    the partitions before it.
    """
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    twice = docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1)
    if whole and not twice.take(1):
        return docs.withColumn("rid", F.col(id_col).cast("long"))
    tied = docs.withColumn("_tie", F.monotonically_increasing_id()).orderBy(F.col(id_col).asc_nulls_first(), F.col("text").asc_nulls_first(), "_tie")
    placed = stage(tied.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    rid = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = stage(placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*docs.columns, rid.alias("rid")), "row-ids")  # a row a partition
    discard(placed)
    return out


def in_fragments(df: DataFrame, n: int, work: Callable[[list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Send routed rows to their fragment and run ``work`` on the payloads of each, one fragment a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, p in zip(b.column(0).to_numpy(), b.column(1), strict=True):
                held.setdefault(int(d), []).append(p.as_buffer())
        for d in sorted(held):
            yield from work(held.pop(d))

    return df.repartitionById(n, F.col("dest")).mapInArrow(run, schema)


def through_fragments(df: DataFrame, n: int, work: Callable[[list], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Send segments to their fragment and run ``work`` on the payloads there; what needs no work passes. Routed rows come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            done = np.flatnonzero(kind >= 0)
            if len(done):
                yield pa.RecordBatch.from_arrays([b.column("kind").take(pa.array(done)), b.column("payload").take(pa.array(done))], schema=ROUTED_ARROW)
            held += [b.column("payload")[int(i)].as_buffer() for i in np.flatnonzero(kind < 0)]
        yield from work(held)

    return df.repartitionById(n, F.col("dest")).mapInArrow(run, ROUTED)


def beside_texts(marks: DataFrame, docs: DataFrame, n: int, work: Callable[[list, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring routed rows to the documents they are about.

    Rows of ``docs`` (rid, text) and of ``marks`` (routed by :func:`spread` of the rid) meet in
    n tasks; in each the marks come first, so that texts stream past them and are never held.
    """
    left = marks.select("dest", F.lit(0).alias("kind"), "payload", F.lit(None).cast("long").alias("rid"), F.lit(None).cast("string").alias("text"))
    right = docs.select(spread_column("rid", n).alias("dest"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("payload"), "rid", "text")
    both = left.unionByName(right).repartitionById(n, F.col("dest")).sortWithinPartitions("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def texts() -> Iterator[pa.RecordBatch]:
            if ahead is not None:
                yield ahead
            for b in batches:
                yield b.select(["rid", "text"])

        ahead = None
        for b in batches:
            kind = b.column("kind").to_numpy()
            k = int(np.searchsorted(kind, 1))
            held += [p.as_buffer() for p in b.column("payload")[:k]]
            if k < len(kind):
                ahead = b.slice(k).select(["rid", "text"])
                break
        yield from work(held, texts())

    return both.mapInArrow(run, schema)
