"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of BLOCK words; their hashes are the index.
Every window of BLOCK words, at any position, probes it. A repeat of SPAN words holds a whole
block of its earlier copy (SPAN >= 2 * BLOCK - 1), so it is found by a probe. Hits are then
extended: the SPAN-word windows around a hit are compared by 128 bits of hash, and all but the
first of equal ones are repeats; together they cover the maximal exact repeats.

Phases: probes by fragment -> hits by document -> windows by fragment -> repeats by
document -> texts. Texts are shuffled twice, probes once as packed columns. What a task can
settle among its own windows goes straight to its documents, with one of them sent for the
others to meet; so a passage in a third of all documents costs its fragment a record a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm import _hashing as H
from twinlake.llm._fragments import ROUTED, SEGMENTS, batched, beside_texts, fragment_of, gather, narrow, pack_records, routed, row_ids, segments, split, spread, through_fragments
from twinlake.llm._stage import discard, release, stage, tasks_for

U = np.uint64


def _words(chunk: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a chunk of (rid, text): bytes, word starts and ends, text number and position of each word, rids."""
    data, at = H.buffer(chunk.column("text"))
    start, end, doc = H.words(data, at)
    first = np.searchsorted(doc, np.arange(len(at) - 1))
    return data, start, end, doc, np.arange(len(doc)) - first[doc] if len(doc) else doc, chunk.column("rid").to_numpy()


def _by_document(rid: np.ndarray, pos: np.ndarray, tasks: int) -> Iterator[tuple[int, bytes]]:
    """Marks as rows, by the task of their document."""
    order = np.lexsort((pos, rid))
    rid, pos = rid[order], pos[order]
    for k, i in split(spread(rid, tasks)):
        yield k, pack_records(rid[i], narrow(pos[i]))


def _settled(rid: np.ndarray, pos: np.ndarray, tasks: int, frags: int) -> list[tuple[int, int, bytes]]:
    """The same as segments that pass through any fragment."""
    return [(k % frags, k, x) for k, x in _by_document(rid, pos, tasks)]


def _places(held: list) -> tuple[np.ndarray, np.ndarray]:
    """(rid, pos) of all marks, by rid."""
    rid, pos = gather(held, [np.int64, np.int64])
    order = np.argsort(rid, kind="stable")
    return rid[order], pos[order]


def covered(pos: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in [p, p + size) for some p."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, pos, 1)
    np.add.at(d, np.minimum(pos + size, n), -1)
    return np.cumsum(d[:-1]) > 0


def repeated_windows(docs: DataFrame, span: int, block: int, tasks: int) -> DataFrame:
    """Routed (rid, pos) of every window of ``span`` words whose words also start earlier."""
    if span < 2 * block - 1:
        raise ValueError("a window must hold a whole block")
    frags = max(8, tasks)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                for chunk in H.chunks(b, "text"):
                    data, start, end, doc, pos, rid = _words(chunk)
                    g = H.windows(H.word_hashes(data, start, end), block)
                    whole = np.flatnonzero(doc[: len(g)] == doc[block - 1 :]) if len(g) else np.empty(0, np.int64)
                    yield g[whole], rid[doc[whole]], pos[whole].astype(np.uint32)

        for g, rid, pos in batched(windows()):
            # Equal windows of this task with a block among them are hits; one that is a block stands for them.
            order = np.argsort(g, kind="stable")
            at = H.runs(g[order])
            size = np.diff(at)
            is_block = pos[order] % block == 0
            blocks = np.add.reduceat(is_block.astype(np.int64), at[:-1])
            sure = np.repeat((size > 1) & (blocks > 0), size)
            nth = np.cumsum(is_block) - np.repeat((np.cumsum(is_block) - is_block)[at[:-1]], size)
            sent = np.sort(order[~sure | (is_block & (nth == 1))])
            hits = order[sure]
            rows = _settled(rid[hits], pos[hits].astype(np.int64), tasks, frags)
            yield segments(rows + [(k, -1, pack_records(rid[sent][i], (g[sent][i] & U(0xFFFFFFFF)).astype(np.uint32), narrow(pos[sent][i]))) for k, i in split(fragment_of(g[sent], frags))])

    def hit(held: list) -> Iterator[pa.RecordBatch]:
        rid, low, pos = gather(held, [np.int64, np.uint32, np.uint32])
        if not len(rid):
            return
        order = np.argsort(low, kind="stable")
        at = H.runs(low[order])
        size = np.diff(at)
        indexed = np.add.reduceat((pos[order] % block == 0).astype(np.int64), at[:-1]) > 0
        keep = order[np.repeat((size > 1) & indexed, size)]
        if len(keep):
            yield routed(list(_by_document(rid[keep], pos[keep], tasks)))

    def extend(held: list, texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_rid, at_pos = _places(held)

        def windows() -> Iterator[tuple[np.ndarray, ...]]:
            for b in texts:
                lo = np.searchsorted(at_rid, b.column("rid").to_numpy())
                hi = np.searchsorted(at_rid, b.column("rid").to_numpy(), "right")
                some = np.flatnonzero(hi > lo)
                if not len(some):
                    continue
                b, lo, hi = b.take(pa.array(some)), lo[some], hi[some]
                done = 0
                for chunk in H.chunks(b, "text"):
                    data, start, end, doc, pos, rid = _words(chunk)
                    first = np.searchsorted(doc, np.arange(chunk.num_rows))
                    hits = np.concatenate([at_pos[lo[done + k] : hi[done + k]] + first[k] for k in range(chunk.num_rows)])
                    done += chunk.num_rows
                    near = covered(np.maximum(hits - (span - block), 0), span - block + 1, len(doc))
                    one, two = (H.windows(H.word_hashes(data, start, end, f), span, f) for f in (0, 1))
                    if len(one):
                        at = np.flatnonzero(near[: len(one)] & (doc[: len(one)] == doc[span - 1 :]))
                        yield one[at], two[at], rid[doc[at]], pos[at]

        for one, two, rid, pos in batched(windows()):
            # The first of this task's equal windows stands for them; the others are repeats.
            order = np.lexsort((pos, rid))
            one, two, rid, pos = one[order], two[order], rid[order], pos[order]
            new = H.first_of_equal(one, two)
            rows = _settled(rid[~new], pos[~new], tasks, frags)
            one, two, rid, pos = one[new], two[new], rid[new], pos[new]
            yield segments(rows + [(k, -1, pack_records(rid[i], one[i], two[i], narrow(pos[i]))) for k, i in split(fragment_of(one, frags))])

    def later(held: list) -> Iterator[pa.RecordBatch]:
        rid, one, two, pos = gather(held, [np.int64, U, U, np.int64])
        order = np.lexsort((pos, rid))
        again = order[~H.first_of_equal(one[order], two[order])]
        if len(again):
            yield routed(list(_by_document(rid[again], pos[again], tasks)))

    hits = stage(through_fragments(docs.select("rid", "text").mapInArrow(probe, SEGMENTS), frags, hit), "anchor-hits")
    release(docs.sparkSession)
    marks = stage(through_fragments(beside_texts(hits, docs, tasks, extend, SEGMENTS), frags, later), "repeats")
    discard(hits)
    return marks


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 20, block: int = 10) -> DataFrame:
    """Remove words covered by a window of ``span`` words that also starts earlier.

    Words are runs of non-white-space (ASCII) in the whole text, however long. "Earlier" is a
    smaller id, or the same document further left; windows are judged on the input. Returns, per
    row: doc_id, n_words, n_removed, kept (the rest, joined by one space). Null and empty texts
    have no words; rows with null ids come first, rows with equal ids in the order of their texts
    (repeated rows in any order); an empty table gives an empty table; other columns, whatever
    their names, are ignored.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    own = row_ids(docs)
    tasks = tasks_for(own)
    marks = repeated_windows(own, span, block, tasks)
    schema = pa.schema([("rid", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def keep(held: list, texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_rid, at_pos = _places(held)
        for b in texts:
            for chunk in H.chunks(b, "text"):
                ids = chunk.column("rid").to_numpy()
                lo, hi = np.searchsorted(at_rid, ids), np.searchsorted(at_rid, ids, "right")
                counts, removed, kept = [], [], []
                data, at = H.buffer(chunk.column("text"))
                raw = data.tobytes()
                for k in range(len(ids)):
                    words = raw[at[k] : at[k + 1]].split()
                    counts.append(len(words))
                    if hi[k] > lo[k]:
                        gone = covered(at_pos[lo[k] : hi[k]], span, len(words))
                        removed.append(int(gone.sum()))
                        words = [words[i] for i in np.flatnonzero(~gone)]
                    else:
                        removed.append(0)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], schema=schema)

    out = beside_texts(marks, own, tasks, keep, "rid long, n_words long, n_removed long, kept binary")
    return _with_ids(out, own)


def _with_ids(out: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id instead of rid; a join only where rids were dealt anew."""
    if getattr(own, "_twinlake_path", None):
        return out.join(own.select("rid", "doc_id"), "rid").drop("rid")
    return out.withColumnRenamed("rid", "doc_id")


def digest(out: DataFrame) -> DataFrame:
    """The kept text as its hash."""
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
