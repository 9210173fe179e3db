"""N-gram Jaccard self-join by vertical partitioning.

The global order of shingles (by hash) is cut into fragments; a document's set falls into
segments, and what two sets share is counted fragment by fragment and summed per pair.

1. Segments of all sets go to their fragments, which count how many documents hold each
   shingle. What only one document holds can't be shared: a document must have 3/4 of its
   shingles in others, or it has no partner. This leaves copies and near copies.
2. Equal sets become one class. A class's rarest shared shingles (its prefix) must meet a
   partner's. In every block of classes with a prefix shingle in common, members are paired
   with a few pseudo-random centres, not with each other.
3. Partial overlaps of these pairs are counted in FRAGMENTS fragments, each dealt over tasks by
   centre, a centre of many pairs over several; they are summed, and links make groups.
4. Only pairs of a block that are still in different groups are counted as well: the members
   outside the block's main group against the others, if their places in the order and their
   bitmaps allow the similarity (Sandes et al., 2020: the differing bits of two parity bitmaps
   bound what sets don't share). Large blocks are compared part by part, in a task each.
   Every pair within a group is joined already, so no link between groups is lost and a group
   of near copies is never expanded into all its pairs.

Shingles are told apart by 64 bits of hash: a wrong overlap needs two shingles of one pair of
documents to collide, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm import _hashing as H
from twinlake.llm._fragments import ROUTED, SEGMENTS, batched, fragment_of, gather, in_fragments, pack, pack_records, routed, row_ids, segments, split, spread, unpack
from twinlake.llm._stage import discard, fields, shuffle_partitions, stage, tasks_for, whole_row
from twinlake.llm.components import components

U = np.uint64
#: Centres that a member of a block may be paired with.
CENTRES = 8
#: Fragments of the shingles' order when overlaps are counted; a pair has at most a partial overlap in each.
FRAGMENTS = 4
#: Pairs of one centre that are counted together.
CELL = 1024
#: Bytes of segments that a task is given, about.
SHARE = 32 << 20
#: Members of a block, on either side, that are compared in one task.
PART = 2048
#: Words of 64 bits in a bitmap.
WORDS = 16


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, ASCII lower-cased; a shorter text is one shingle."""
    data = H.lower_ascii(data)
    start, end, doc = H.words(data, at)
    h = H.word_hashes(data, start, end)
    g = H.windows(h, size)
    first = np.searchsorted(doc, np.arange(len(at)))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif n:
            out.append(H.scramble(H.windows(h[a:b], int(n)) + U(int(n))))
        else:
            out.append(np.empty(0, U))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; equal for equal sets."""
    with np.errstate(over="ignore"):
        x = np.add.reduce(H.scramble(s ^ U(0x1234567887654321))) + U(len(s))
        y = np.bitwise_xor.reduce(H.scramble(s + U(0x9E3779B97F4A7C15)))
    return int(np.array([x], U).view(np.int64)[0]), int(np.array([y], U).view(np.int64)[0])


def _needed(n, percent: int):
    """The least overlap with a set of n that a partner must have: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def shared_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(rid, n, fp_a, fp_b, shared): each set's size and fingerprint, and, where enough of it is
    held by others, its shared shingles, the rarest first."""
    tasks = tasks_for(docs)
    frags = max(8, tasks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about: list[tuple[int, int, bytes]] = []

        def pieces() -> Iterator[tuple[np.ndarray, ...]]:
            sent: set[bytes] = set()
            for b in batches:
                for chunk in H.chunks(b, "text"):
                    rid = chunk.column("rid").to_numpy()
                    sets = shingle_sets(*H.buffer(chunk.column("text")), size)
                    prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                    n = np.array([len(s) for s in sets], np.int64)
                    for k, i in split(spread(rid, tasks)):
                        about.append((int(rid[i[0]] % frags), k, pack(rid[i], n[i], prints[i, 0], prints[i, 1])))
                    # A set that this task has sent lately isn't sent again: its copies share a class.
                    once = []
                    for i in range(len(sets)):
                        key = prints[i].tobytes()
                        if key not in sent:
                            sent.add(key)
                            once.append(i)
                    if len(sent) > 50_000:
                        sent.clear()
                    yield np.concatenate([sets[i] for i in once]) if once else np.empty(0, U), np.repeat(rid[once], n[once]) if once else np.empty(0, np.int64)

        for h, owner in batched(pieces()):
            yield segments([*about, *((k, -1, pack_records(owner[i], h[i])) for k, i in split(fragment_of(h, frags)))])
            about.clear()
        if about:
            yield segments(about)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            about = np.flatnonzero(kind >= 0)
            if len(about):
                yield pa.RecordBatch.from_arrays([b.column("kind").take(pa.array(about)), pa.array(np.zeros(len(about)), pa.int32()), b.column("payload").take(pa.array(about))], names=["dest", "kind", "payload"])
            held += [b.column("payload")[int(i)].as_buffer() for i in np.flatnonzero(kind < 0)]
        rid, h = gather(held, [np.int64, U])
        del held
        order = np.argsort(h, kind="stable")
        df = np.diff(H.runs(h[order]))
        keep = np.repeat(df > 1, df)
        at_df = np.repeat(df, df)[keep].astype(np.uint32)
        order = order[keep]
        del keep, df
        back = np.argsort(order, kind="stable")  # by document again, as they came
        rid, h, at_df = rid[order][back], h[order][back], at_df[back]
        rows = [(k, pack_records(rid[i], h[i], at_df[i])) for k, i in split(spread(rid, tasks))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(np.ones(len(rows)), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["dest", "kind", "payload"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, held = [], []
        for b in batches:
            for kind, p in zip(b.column("kind").to_numpy(), b.column("payload"), strict=True):
                (held if kind else about).append(p.as_buffer())
        if not about:
            return
        rid, n, fa, fb = (np.concatenate(c) for c in zip(*map(unpack, about), strict=True))
        owner, h, df = gather(held, [np.int64, U, np.uint32])
        order = np.lexsort((h, df, owner))
        owner, h = owner[order], h[order]
        lo, hi = np.searchsorted(owner, rid), np.searchsorted(owner, rid, "right")
        alive = (n > 0) & (hi - lo >= np.maximum(1, _needed(n, percent)))
        for at in range(0, len(rid), 2000):
            to = min(len(rid), at + 2000)
            shared = [h[lo[i] : hi[i]].tobytes() if alive[i] else None for i in range(at, to)]
            yield pa.RecordBatch.from_arrays([pa.array(rid[at:to]), pa.array(n[at:to]), pa.array(fa[at:to]), pa.array(fb[at:to]), pa.array(shared, pa.binary())], names=["rid", "n", "fp_a", "fp_b", "shared"])

    parts = stage(docs.select("rid", "text").mapInArrow(cut, SEGMENTS).repartitionById(frags, F.col("dest")).mapInArrow(count, SEGMENTS), "segments")
    out = stage(parts.repartitionById(tasks, F.col("dest")).mapInArrow(collect, "rid long, n long, fp_a long, fp_b long, shared binary"), "sets")
    discard(parts)
    return out


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n) -> (a, b, both): partial overlaps of the pair's segments in each fragment, summed; n is the size of a.

    ``a`` has few partners, ``b`` may have many: its pairs are dealt to cells of about CELL. A set
    of ``sets`` (id, n, shared) goes to the cells of its pairs, cut into a segment a fragment.
    """
    weight = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 8
    parts = max(-(-shuffle_partitions(pairs.sparkSession) // FRAGMENTS), -(-weight // (FRAGMENTS * SHARE)))
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    cells = pairs.join(many, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("cells"))).alias("cell"))
    members = cells.select(F.col("a").alias("id"), "b", "cell", F.lit(0).alias("centre"))
    centres = cells.select(F.col("b").alias("id"), "b", "cell", F.lit(1).alias("centre")).distinct()
    own = sets.select("id", "shared").join(members.unionByName(centres), "id").select("id", "b", F.pmod("cell", F.lit(parts)).cast("int").alias("part"), "centre", "shared")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x.as_buffer(), U) for x in b.column("shared")]
            if not sets:
                continue
            ids, centre_of, part, centre = (b.column(c).to_numpy() for c in ("id", "b", "part", "centre"))
            at = 0
            while at < len(sets):  # about a megabyte of segments at a time
                to, n = at, 0
                while to < len(sets) and (to == at or n < 1 << 17):
                    n += len(sets[to])
                    to += 1
                h, owner = np.concatenate(sets[at:to]), np.repeat(np.arange(at, to), [len(s) for s in sets[at:to]])
                rows = []
                for k, i in split(fragment_of(h, FRAGMENTS) * np.int32(parts) + part[owner]):
                    cuts = H.runs(owner[i])
                    who = owner[i][cuts[:-1]]
                    rows.append((k, pack(ids[who], centre_of[who], centre[who], np.diff(cuts), h[i])))
                yield routed(rows)
                at = to

    def partial(held: list) -> Iterator[pa.RecordBatch]:
        ids, of, centre, sizes, h = (np.concatenate(p) for p in zip(*map(unpack, held), strict=True))
        start = np.cumsum(sizes) - sizes
        mixed = H.scramble(h ^ H.scramble(np.repeat(of, sizes).view(U)))
        del h
        known = np.sort(mixed[np.repeat(centre == 1, sizes)])
        member = np.flatnonzero(centre == 0)
        if not len(known):
            return
        for at in range(0, len(member), 5000):
            w = member[at : at + 5000]
            reps = sizes[w]
            want = mixed[np.arange(reps.sum()) + np.repeat(start[w] - (np.cumsum(reps) - reps), reps)]
            spot = np.minimum(np.searchsorted(known, want), len(known) - 1)
            both = np.bincount(np.repeat(np.arange(len(w)), reps), known[spot] == want, len(w)).astype(np.int64)
            some = both > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[w][some]), pa.array(of[w][some]), pa.array(both[some])], names=["a", "b", "part"])

    counted = in_fragments(own.mapInArrow(cut, ROUTED), FRAGMENTS * parts, partial, "a long, b long, part long")
    return counted.groupBy("a", "b").agg(F.sum("part").alias("both"))


def _links(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose Jaccard similarity is at least percent / 100."""
    size = lambda who: classes.select(F.col("id").alias(who), F.col("n").alias(f"n{who}"))
    met = overlaps(pairs, classes).join(size("a"), "a").join(size("b"), "b")
    return met.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(h, id, n, own, ahead): a class's rarest shared shingles, enough that partners have one in common.

    ``own`` is what the class shares with no other, per mille; ``ahead`` is how many of its shared
    shingles come from this one on in the common order, rarest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("shared")]
            take = [s[: max(0, len(s) - int(_needed(k, percent)) + 1)] for s, k in zip(sets, n, strict=True)]
            reps = [len(t) for t in take]
            own = np.array([1000 * (int(k) - len(s)) // int(k) for s, k in zip(sets, n, strict=True)], np.int64)
            ahead = [np.arange(len(s), len(s) - k, -1) for s, k in zip(sets, reps, strict=True)]
            none = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(take + none)), pa.array(np.repeat(b.column("id").to_numpy(), reps)), pa.array(np.repeat(n, reps)), pa.array(np.repeat(own, reps)), pa.array(np.concatenate(ahead + none))], names=["h", "id", "n", "own", "ahead"])

    return classes.select("id", "n", "shared").mapInArrow(run, "h long, id long, n long, own long, ahead long")


def _bitmaps(classes: DataFrame) -> DataFrame:
    """(id, n, held, b0, ...): how many shingles a class shares, and the parity of their hashes in each of the bitmap's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x.as_buffer(), U) for x in b.column("shared")]
            bits = np.zeros((len(sets), WORDS), np.int64)
            for k, s in enumerate(sets):
                odd = np.bincount((H.scramble(s + U(0x1B873593)) % U(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
                bits[k] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            held = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), held, *(pa.array(bits[:, i].copy()) for i in range(WORDS))], names=["id", "n", "held", *(f"b{i}" for i in range(WORDS))])

    return classes.select("id", "n", "shared").mapInArrow(run, "id long, n long, held long, " + ", ".join(f"b{i} long" for i in range(WORDS)))


def _rest(prefix: DataFrame, groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with a prefix shingle in common that lie in different groups and may be similar.

    Where a pair's first common shingle is, what both have from there on bounds what they share;
    so a pair may be left out at any shingle after which one of them has too little.
    """
    placed = prefix.select("h", "id", "ahead").join(groups, "id", "left").select("h", "id", "ahead", F.coalesce("component", "id").alias("group"))
    sizes = placed.groupBy("h", "group").agg(F.count("*").alias("size"))
    main = sizes.groupBy("h").agg(F.max_by("group", F.struct("size", "group")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("all"), F.count("*").alias("several"))
    main = main.where("several > 1").select("h", "main", "all", F.ceil((F.col("all") - F.col("most")) / PART).cast("int").alias("rows"), F.ceil(F.col("all") / PART).cast("int").alias("cols"))
    mixed = stage(placed.join(main, "h").drop("all").join(_bitmaps(classes), "id"), "mixed")
    # A block is a table of parts against parts; members go to all parts of their row or column.
    lot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = mixed.where("group <> main").withColumn("row", lot("rows")).withColumn("col", every("cols")).alias("x")
    y = mixed.withColumn("col", lot("cols")).withColumn("row", every("rows")).alias("y")
    differ = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(WORDS)), F.lit(0))
    n = F.col("x.n") + F.col("y.n")
    both = (
        (F.col("x.h") == F.col("y.h")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.col") == F.col("y.col"))
        & (F.col("x.group") != F.col("y.group")) & ((F.col("y.group") == F.col("y.main")) | (F.col("x.id") > F.col("y.id")))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & ((100 + percent) * F.least("x.ahead", "y.ahead") >= percent * n)
        & ((100 + percent) * (F.col("x.held") + F.col("y.held") - differ) >= 2 * percent * n)
    )
    high = F.col("x.id") > F.col("y.id")
    return x.join(y, both).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"), F.when(high, F.col("x.n")).otherwise(F.col("y.n")).alias("n")).distinct()


def _joined(groups: DataFrame, more: DataFrame) -> DataFrame:
    """Groups (id, component) after further links (a, b): only the groups that these touch are joined anew."""
    if not more.take(1):
        return groups
    at = lambda df, c: df.join(groups.select(F.col("id").alias(c), F.col("component").alias(f"g{c}")), c, "left").withColumn(f"g{c}", F.coalesce(f"g{c}", c))
    lifted = stage(components(at(at(more, "a"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))).withColumnRenamed("component", "to"), "groups")
    alone = lifted.join(groups, "id", "left_anti").select("id", F.col("to").alias("component"))
    moved = groups.join(lifted.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(alone)


def _groups(own: DataFrame, size: int, percent: int) -> DataFrame:
    """(rid, n_shingles, component): the groups of documents (rid, text)."""
    sets = shared_sets(own, size, percent)
    equal = stage(sets.where("n > 0").groupBy("fp_a", "fp_b").agg(F.min("rid").alias("id"), F.first("n").alias("n"), F.first("shared", ignorenulls=True).alias("shared")), "classes")
    classes = equal.where(F.col("shared").isNotNull())
    prefix = stage(_prefixes(classes, percent), "prefix")
    close = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))

    # Members of a block meet a pseudo-random centre, one of CENTRES choices, and the member that
    # has least of its own: of an original and its edits, the original.
    lot = F.xxhash64(F.col("id"), F.pmod(F.col("h"), F.lit(CENTRES)))
    centre = prefix.groupBy("h").agg(
        F.min(F.struct(lot.alias("lot"), F.col("id"), F.col("n"))).alias("c"), F.min(F.struct("own", lot.alias("lot"), "id", "n")).alias("d"), F.count("*").alias("size")
    ).where("size > 1")
    centre = centre.select("h", F.array_distinct(F.array(F.struct("c.id", "c.n"), F.struct("d.id", "d.n"))).alias("c"))
    met = prefix.join(centre, "h").select("id", "n", F.explode("c").alias("c")).where((F.col("id") != F.col("c.id")) & close(F.col("n"), F.col("c.n")))
    # A pair's ``a`` is one that is a member where the other is the centre, so that it has few partners.
    high, n_of = F.col("id") > F.col("c.id"), lambda up: F.max(F.when(up, F.col("n")).otherwise(F.col("c.n")))
    met = met.groupBy(F.greatest("id", F.col("c.id")).alias("high"), F.least("id", F.col("c.id")).alias("low")).agg(F.max(high).alias("up"), n_of(high).alias("n_high"), n_of(~high).alias("n_low"))
    one = lambda x, y: F.when(F.col("up"), F.col(x)).otherwise(F.col(y))
    pairs = stage(met.select(one("high", "low").alias("a"), one("low", "high").alias("b"), one("n_high", "n_low").alias("n")), "pairs")
    links = stage(_links(pairs, classes, percent), "jaccard")
    groups = stage(components(links), "groups")

    ordered = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = stage(_rest(prefix, groups, classes, percent).join(ordered, ["a", "b"], "left_anti"), "pairs")
    final = groups
    if rest.take(1):
        final = _joined(groups, stage(_links(rest, classes, percent), "jaccard"))
    discard(prefix, pairs, links, rest)

    of_class = equal.select("fp_a", "fp_b", "id").join(final, "id", "left").select("fp_a", "fp_b", F.coalesce("component", "id").alias("component"))
    out = sets.select("rid", "n", "fp_a", "fp_b").join(of_class, ["fp_a", "fp_b"], "left")
    out = out.select("rid", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rid")).otherwise(F.col("rid")).alias("component"))
    return out


def jaccard_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Groups of documents linked by 100 * |A & B| >= percent * |A | B| over word shingles.

    Returns, per row: doc_id, n_shingles, component_id (the smallest id reachable by links,
    itself included). Words are runs of non-white-space, A-Z lower-cased; a text with fewer
    than ``size`` words is one shingle; null or empty texts have none and link with nothing;
    very long texts count whole. Rows with equal or null ids are rows of their own, repeated rows
    of one group; null ids come first in order and stand as null in component_id; other columns,
    whatever their names, are ignored; an empty table gives an empty table.
    """
    own = row_ids(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    out = _groups(own, size, percent)
    if getattr(own, "_twinlake_path", None):
        ids = own.select("rid", "doc_id")
        out = out.join(ids, "rid").join(ids.select(F.col("rid").alias("component"), F.col("doc_id").alias("component_id")), "component")
        return out.select("doc_id", "n_shingles", "component_id")
    return out.select(F.col("rid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, *, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others, whatever their names and types) without all but the first of each group.

    Groups are those of :func:`jaccard_groups`: texts without words stay, an empty table stays so,
    of repeated rows one stays, and other columns come back as they were.
    """
    own = row_ids(docs.select("doc_id", "text", whole_row(docs.columns).alias("_all")))
    first = _groups(own.select("rid", "text"), size, percent).where("rid = component").select("rid")
    return own.join(first, "rid", "left_semi").select(*fields("_all", docs.columns))
