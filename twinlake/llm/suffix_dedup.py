"""Byte-level dedup with a run-length compressed Burrows-Wheeler index.

A corpus does not fit one index, so it is dealt by content: every SPAN-byte window belongs to
its anchor, the least of the K-byte strings inside it by hash. Equal windows have equal
anchors at equal offsets, so one task can judge all windows of an anchor. Anchors that occur
once are dropped; for the others, the bytes around each occurrence (its context: all windows of
that anchor) go to the anchor's task. There the distinct contexts are put in the order of
documents and cut to the stretches whose windows' hashes come again. Earlier ones are joined,
and the Burrows-Wheeler transform of the joined text is kept as runs with the suffix positions at
both run ends as samples. Later ones stream backwards through that index and get their matching
statistics; a place whose match is at least SPAN bytes long is a long match. What a task can
settle by itself goes straight to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm import _hashing as H
from twinlake.llm._fragments import SEGMENTS, batched, beside_texts, fragment_of, gather, narrow, pack_records, routed, row_ids, segments, split, spread, through_fragments
from twinlake.llm._stage import discard, release, stage, tasks_for

U = np.uint64
K = 24
#: Context bytes that are indexed, or streamed, together.
BATCH = 2 << 20
#: Never part of UTF-8.
END = 255


@dataclass
class Anchors:
    """Occurrences of anchors in a chunk: text number, first window (within the text), number of windows, hash."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray


def anchors(data: np.ndarray, at: np.ndarray, span: int) -> Anchors:
    sums = H.byte_sums(data)
    h = H.byte_windows(sums, K)
    inside = span - K + 1
    none = np.empty(0, np.int64)
    if len(h) < inside:
        return Anchors(none, none, none, np.empty(0, U))
    low = (h & ~U(0xFFFFFFFF)) | np.arange(len(h), dtype=U)  # ties go left
    size = 1
    while 2 * size <= inside:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if inside > size:
        low = np.minimum(low[: len(low) - (inside - size)], low[inside - size :])
    place = (low & U(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(at, np.arange(len(place)), "right") - 1
    own = np.flatnonzero(np.arange(len(place)) + span <= at[doc + 1])
    place, doc = place[own], doc[own]
    new = np.ones(len(own), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return Anchors(doc[first], own[first] - at[doc[first]], np.diff(np.append(first, len(own))), H.scramble(h[place[first]] + U(0x51ED270B)))


def suffix_order(text: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """The suffixes' starts in order: by ``node``, then by bytes up to the next END; of two ENDs the earlier is the smaller.

    Prefix doubling from eight bytes on, over the suffixes that are not yet told apart.
    """
    n = len(text)
    ends = np.flatnonzero(text == END)
    context = np.searchsorted(ends, np.arange(n))
    left = ends[context] - np.arange(n)
    wide = np.zeros(n + 8, U)
    wide[:n] = text
    key = np.zeros(n, U)
    for i in range(8):
        key = (key << U(8)) | np.where(i <= left, wide[i : i + n], U(0))
    own = np.where(left < 8, context + 1, 0)
    order = np.lexsort((own, key) if node is None else (own, key, node))
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
    if node is not None:
        new[1:] |= node[order[1:]] != node[order[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first  # that of a group is its first place
    size = 8
    while True:
        several = ~new
        several[:-1] |= ~new[1:]
        at = np.flatnonzero(several)
        if not len(at):
            return order
        some, group = order[at], first[at]
        after = rank[some + size]  # still before the END, or they were told apart
        by = np.lexsort((after, group))
        some, group, after = some[by], group[by], after[by]
        order[at] = some
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[at] = fresh
        first[at] = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[some] = first[at]
        size *= 2


@dataclass
class RunIndex:
    """A transform as runs, by letter and first row; a letter is a byte of a node. No array is longer than there are runs."""

    rows: int
    #: letter * rows + first row
    key: np.ndarray
    letter: np.ndarray
    first: np.ndarray
    last: np.ndarray
    #: Where the first row leads, one byte further left.
    to: np.ndarray
    #: Samples: the suffixes at the first and at the last row.
    head: np.ndarray
    tail: np.ndarray

    def runs(self, letter: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row: the letter's run that starts at or before it, that run's follower, and which of them there are (bits 1 and 2)."""
        at = np.searchsorted(self.key, letter * self.rows + row, "right")
        up, down = np.maximum(at - 1, 0), np.minimum(at, len(self.key) - 1)
        there = ((at > 0) & (self.letter[up] == letter)) + 2 * ((at < len(self.key)) & (self.letter[down] == letter))
        return up, down, there


def build_index(text: np.ndarray, node: np.ndarray | None = None) -> RunIndex:
    """The index of joined contexts that end in END each; contexts of different nodes have no letter in common."""
    n = len(text)
    order = suffix_order(text, node)
    bwt = (text.astype(np.int64) if node is None else node * 256 + text)[order - 1]
    first = np.concatenate([[0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1])
    last = np.append(first[1:], n) - 1
    letter = bwt[first]
    by = np.lexsort((first, letter))
    letter, first, last = letter[by], first[by], last[by]
    size = last - first + 1
    return RunIndex(n, letter * n + first, letter, first, last, np.cumsum(size) - size, order[first], order[last])


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the text."""
    wide = np.zeros(len(text) + 16, U)
    wide[: len(text)] = text
    out = np.zeros(len(text) + 8, U)
    for i in range(8):
        out = (out << U(8)) | wide[i : i + len(out)]
    return out


def agreement(eights: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes the text from a on and from b on have in common, at most ``most``."""
    out, done, live, end = np.zeros(len(a), np.int64), 0, np.flatnonzero(most > 0), len(eights) - 1
    while len(live):
        x = eights[np.minimum(a[live] + done, end)] ^ eights[np.minimum(b[live] + done, end)]
        same = np.zeros(len(live), np.int64)
        for bits in range(0, 64, 8):
            same += x < U(1 << bits)
        done += 8
        out[live] = done - 8 + same
        live = live[(same == 8) & (most[live] > done)]
    return np.minimum(out, most)


def matching_statistics(index: RunIndex, eights: np.ndarray, blob: np.ndarray, start: np.ndarray, size: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stream the patterns blob[start : start + size] backwards through an index, a byte of each at a time.

    Yields (bytes read, patterns still read, lengths): how many bytes from the last one read on
    are also somewhere in the contexts of the pattern's node. The current row is that of a
    suffix with this match. If the byte doesn't precede it, the longest match one byte further
    left starts at the end of the byte's nearest run above or below; the sample there says which
    suffix that is, and what it has in common with the old one bounds the length.
    """
    who = np.arange(len(start))
    row, place, length = (np.full(len(who), x, np.int64) for x in (index.first[0], index.head[0], 0))
    for step in range(1, int(size.max(initial=0)) + 1):
        live = size[who] >= step
        if not live.all():
            who, row, place, length = who[live], row[live], place[live], length[live]
        up, down, there = index.runs(node[who] * 256 + blob[start[who] + size[who] - step], row)
        inside = (there & 1 > 0) & (index.last[up] >= row)
        to, at, n = index.to[up] + row - index.first[up], place - 1, length + 1
        jump = np.flatnonzero(~inside)
        if len(jump):
            up, down, there, old, most = up[jump], down[jump], there[jump], place[jump], length[jump]
            above = np.where(there & 1, agreement(eights, old, index.tail[up], np.where(there & 1, most, 0)), -1)
            below = np.where(there & 2, agreement(eights, old, index.head[down], np.where(there & 2, most, 0)), -1)
            best = np.maximum(above, below)
            high = above == best
            to[jump] = np.where(best < 0, row[jump], np.where(high, index.to[up] + index.last[up] - index.first[up], index.to[down]))
            at[jump] = np.where(best < 0, old, np.where(high, index.tail[up], index.head[down]) - 1)
            n[jump] = best + 1
        row, place, length = to, at, n
        yield step, who, length


def _parts(size: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours with ``most`` bytes together, or one alone."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield slice(a, z)
        a = z


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches [start, start + size), one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def repeated_places(blob: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, span: int, most: int = BATCH) -> np.ndarray:
    """Contexts blob[start : start + size], by group, the earlier first -> for each of their windows, in order, whether an earlier context of the group has it.

    The contexts of a group are halved again and again; at each level the left halves are
    indexed and the right halves stream through, so that a context meets all earlier ones.
    Indexes and streams take at most ``most`` bytes at a time, however large a group is.
    """
    windows = size - span + 1
    at = np.cumsum(windows) - windows
    marks = np.zeros(windows.sum(), bool)
    cuts = H.runs(group)
    count = np.diff(cuts)
    nth, total = np.arange(len(group)) - np.repeat(cuts[:-1], count), np.repeat(count, count)
    level = 0
    while len(count) and 1 << level < count.max():
        new = np.ones(len(group), bool)
        half = nth >> level + 1
        new[1:] = (group[1:] != group[:-1]) | (half[1:] != half[:-1])
        node = np.cumsum(new) - 1
        right = nth >> level & 1 == 1
        asks = np.flatnonzero(right & (np.add.reduceat(marks, at, dtype=np.int64) < windows))
        held = np.flatnonzero(~right)
        held = held[np.isin(node[held], node[asks])]
        for part in _parts(size[held] + 1, most):
            own = held[part]
            text = np.full(size[own].sum() + len(own), END, np.uint8)
            begin = np.cumsum(size[own] + 1) - size[own] - 1
            text[_flat(begin, size[own])] = blob[_flat(start[own], size[own])]
            base = node[own[0]]
            index, eights = build_index(text, np.repeat(node[own] - base, size[own] + 1)), eight_bytes(text)
            lo, hi = np.searchsorted(node[asks], base), np.searchsorted(node[asks], node[own[-1]], "right")
            for few in _parts(size[asks[lo:hi]], most):
                who = asks[lo:hi][few]
                for step, live, length in matching_statistics(index, eights, blob, start[who], size[who], node[who] - base):
                    if step >= span:
                        found = live[length >= span]
                        marks[at[who[found]] + size[who[found]] - step] = True
        level += 1
    return marks


def _stretches(rid: np.ndarray, start: np.ndarray, count: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flagged windows of contexts as runs: rid, first window, number of windows."""
    which = np.repeat(np.arange(len(count)), count)
    new = flags.copy()
    new[1:] &= ~flags[:-1] | (which[1:] != which[:-1])
    first = np.flatnonzero(new)
    stop = flags.copy()
    stop[:-1] &= ~flags[1:] | (which[1:] != which[:-1])
    last = np.flatnonzero(stop)
    k = which[first]
    return rid[k], start[k] + first - (np.cumsum(count) - count)[k], last - first + 1


def repeated_bytes(docs: DataFrame, span: int, tasks: int) -> DataFrame:
    """Routed (rid, first, count): windows of ``span`` bytes whose bytes also start earlier."""
    if span <= K:
        raise ValueError(f"windows must be longer than {K} bytes")
    frags = max(8, tasks)

    def by_document(rid: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.lexsort((more[0], rid))
        rid, more = rid[order], [m[order] for m in more]
        for k, i in split(spread(rid, tasks)):
            yield k, pack_records(rid[i], *(narrow(m[i]) for m in more))

    def settled(rid: np.ndarray, *more: np.ndarray) -> list[tuple[int, int, bytes]]:
        return [(k % frags, k, x) for k, x in by_document(rid, *more)]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                for chunk in H.chunks(b, "text"):
                    x = anchors(*H.buffer(chunk.column("text")), span)
                    yield chunk.column("rid").to_numpy()[x.doc], x.start, x.key

        for rid, start, key in batched(found()):
            # An anchor that comes again in this task is one of several; one occurrence stands for them elsewhere.
            order = np.argsort(key, kind="stable")
            cuts = H.runs(key[order])
            size = np.diff(cuts)
            sure, sent = order[np.repeat(size > 1, size)], np.sort(order[cuts[:-1]])
            rows = settled(rid[sure], start[sure])
            yield segments(rows + [(k, -1, pack_records(rid[sent][i], (key[sent][i] & U(0xFFFFFFFF)).astype(np.uint32), narrow(start[sent][i]))) for k, i in split(fragment_of(key[sent], frags))])

    def several(held: list) -> Iterator[pa.RecordBatch]:
        rid, low, start = gather(held, [np.int64, np.uint32, np.int64])
        order = np.argsort(low, kind="stable")
        size = np.diff(H.runs(low[order]))
        keep = order[np.repeat(size > 1, size)] if len(order) else order
        if len(keep):
            yield routed(list(by_document(rid[keep], start[keep])))

    def contexts(held: list, texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_rid, at_start = gather(held, [np.int64, np.int64])
        wanted = np.sort(H.scramble(H.scramble(at_rid.view(U)) ^ at_start.view(U)))
        known = np.unique(at_rid)
        for b in texts:
            some = np.flatnonzero(np.isin(b.column("rid").to_numpy(), known))
            if not len(some):
                continue
            for chunk in H.chunks(b.take(pa.array(some)), "text"):
                rid = chunk.column("rid").to_numpy()
                data, at = H.buffer(chunk.column("text"))
                x = anchors(data, at, span)
                if not len(x.doc):
                    continue
                who = rid[x.doc]
                mark = H.scramble(H.scramble(who.view(U)) ^ x.start.view(U))
                here = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, mark), len(wanted) - 1)] == mark)
                here = here[np.lexsort((x.start[here], who[here]))]
                who, first, count, key = who[here], x.start[here], x.count[here], x.key[here]
                begin, size = at[x.doc[here]] + first, count + span - 1
                # A context that this task has sent is a repeat as a whole, unless it is the earlier one.
                sent = H.first_of_equal(key, *(H.spans_hash(H.byte_sums(data, f), begin, begin + size, f) for f in (0, 1)))
                gone, sent = np.flatnonzero(~sent), np.flatnonzero(sent)
                rows = settled(who[gone], first[gone], count[gone])
                for k, i in split(fragment_of(key[sent], frags)):
                    i = sent[i]
                    rows.append((k, -1, pack_records(who[i], narrow(first[i]), narrow(count[i]), key[i], data[_flat(begin[i], size[i])])))
                yield segments(rows)

    def judge(held: list) -> Iterator[pa.RecordBatch]:
        rid, first, count, key, blob = gather(held, [np.int64, np.int64, np.int64, U, np.uint8])
        held.clear()
        if not len(rid):
            return
        size = count + span - 1
        begin = np.cumsum(size) - size
        by_key = np.lexsort((first, rid, key))
        cuts = H.runs(key[by_key])
        weight = np.add.reduceat(size[by_key], cuts[:-1])
        for keys in _parts(weight, BATCH):
            part = by_key[cuts[keys.start] : cuts[keys.stop]]
            n = size[part]
            local = blob[_flat(begin[part], n)]
            sums = [H.byte_sums(local, f) for f in (0, 1)]
            out = [[], [], []]

            def distinct(key: np.ndarray, who: np.ndarray, start: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
                """Equal contexts but the first are repeats as a whole; an anchor with one distinct context has nothing to compare."""
                new = H.first_of_equal(key, *(H.spans_hash(sums[f], start, start + count + span - 1, f) for f in (0, 1)))
                for column, x in zip(out, (who, first, count), strict=True):
                    column.append(x[~new])
                _, which, many = np.unique(key[new], return_inverse=True, return_counts=True)
                return tuple(x[new][many[which] > 1] for x in (key, who, start, first, count))

            own = distinct(key[part], rid[part], np.cumsum(n) - n, first[part], count[part])
            if len(own[0]):
                # Windows whose hash comes once are no repeats: a context is cut to the stretch of its others.
                k, who, start, begins, c = own
                hashes = H.byte_windows(sums[0], span)[_flat(start, c)]
                order = np.argsort(hashes, kind="stable")
                times = np.diff(H.runs(hashes[order]))
                common = np.empty(len(order), bool)
                common[order] = np.repeat(times > 1, times)
                offset, at = _flat(np.zeros(len(c), np.int64), c), np.cumsum(c) - c
                low = np.minimum.reduceat(np.where(common, offset, np.int64(1) << 60), at)
                high = np.maximum.reduceat(np.where(common, offset, -1), at)
                some = high >= 0
                low, high = low[some], high[some]
                k, who, start, begins, c = distinct(k[some], who[some], start[some] + low, begins[some] + low, high - low + 1)
                if len(k):
                    flags = repeated_places(local, start, c + span - 1, k, span)
                    for column, x in zip(out, _stretches(who, begins, c, flags), strict=True):
                        column.append(x)
            rows = list(by_document(*map(np.concatenate, out)))
            if rows:
                yield routed(rows)

    marks = stage(through_fragments(docs.select("rid", "text").mapInArrow(seek, SEGMENTS), frags, several), "anchors")
    release(docs.sparkSession)
    out = stage(through_fragments(beside_texts(marks, docs, tasks, contexts, SEGMENTS), frags, judge), "long-matches")
    discard(marks)
    return out


def drop_long_matches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 100) -> DataFrame:
    """Remove bytes covered by a string of ``span`` bytes that also starts earlier.

    Texts are UTF-8, whole, however long; matches never cross documents. "Earlier" is a smaller
    id, or the same document further left; strings are judged on the input. Returns, per row:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary). Null texts are
    empty; rows with null ids come first, rows with equal ids in the order of their texts
    (repeated rows in any order); other columns, whatever their names, are ignored; an empty
    table gives an empty table.
    """
    own = row_ids(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    tasks = tasks_for(own)
    marks = repeated_bytes(own, span, tasks)

    def keep(held: list, texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_rid, first, count = gather(held, [np.int64, np.int64, np.int64])
        order = np.argsort(at_rid, kind="stable")
        at_rid, first, count = at_rid[order], first[order], count[order]
        for b in texts:
            for chunk in H.chunks(b, "text"):
                ids = chunk.column("rid").to_numpy()
                data, at = H.buffer(chunk.column("text"))
                lo, hi = np.searchsorted(at_rid, ids), np.searchsorted(at_rid, ids, "right")
                n = np.diff(at)
                removed, spans, kept = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), []
                for k in range(len(ids)):
                    text = data[at[k] : at[k + 1]]
                    if hi[k] > lo[k]:
                        f, c = first[lo[k] : hi[k]], count[lo[k] : hi[k]]
                        d = np.zeros(len(text) + 1, np.int32)
                        np.add.at(d, f, 1)
                        np.add.at(d, f + c + span - 1, -1)
                        gone = np.cumsum(d[:-1]) > 0
                        removed[k] = gone.sum()
                        spans[k] = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[0])
                        text = text[~gone]
                    kept.append(text.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], names=["rid", "n_bytes", "n_removed", "n_spans", "kept"])

    out = beside_texts(marks, own, tasks, keep, "rid long, n_bytes long, n_removed long, n_spans long, kept binary")
    if getattr(own, "_twinlake_path", None):
        return out.join(own.select("rid", "doc_id"), "rid").drop("rid")
    return out.withColumnRenamed("rid", "doc_id")


def digest(out: DataFrame) -> DataFrame:
    """The kept bytes as their hash."""
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
