"""Embedding near-dedup by a forest of random-projection trees with spill.

The upper levels of every tree are fitted on a bounded sample: one random direction a level and
a median per node. A vector near a median goes to both sides. That deals all rows to (tree,
leaf) groups. A leaf with more than GROUP rows is split on, by as many levels as its size asks for, at
medians of a bounded sample of its own, until leaves fit or no longer thin out. In its task a leaf is split on
by further random directions down to small nodes.

Tight groups are never expanded into all their pairs. First every vector looks for a centre:
of the vectors in its leaves within half the link angle, itself included, the one with the least
random number. All vectors of a centre are linked to one another, by the triangle inequality of
angles, so their links are counted, not listed. Then leaves are compared again, and only pairs
with different centres are listed, verified in double precision; the union of all trees'
pairs, and every vector's link to its centre, make the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm import _hashing as H
from twinlake.llm._stage import discard, stage
from twinlake.llm.components import components

SEED = 20_240_607
#: Most levels that one more round of dealing adds to an oversized leaf, and the rows it sees of it, about.
LEVELS, SEEN = 5, 1024
#: The part of GROUP that the upper levels' leaves are to fill, so that few have to be split on.
FILL = 0.75
DEALT = "tree int, dim int, round int, leaf long, id long, centre long, x binary"
LEAF = ["tree", "dim", "round", "leaf"]


def unit_vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimension, usable, flat start) of each list; a usable vector is finite, has no null and isn't zero."""
    n = len(col)
    dims, usable, values = np.zeros(n, np.int64), np.zeros(n, bool), [None] * n
    for i, x in enumerate(col):
        if not x.is_valid or not len(x):
            continue
        v = x.values
        if v.null_count:
            continue
        a = v.to_numpy(zero_copy_only=False).astype(np.float64)
        norm = np.linalg.norm(a)
        if not np.isfinite(a).all():
            continue
        if not 0 < norm < np.inf:
            scale = np.abs(a).max()
            if not scale:
                continue
            a = a / scale
            norm = np.linalg.norm(a)
        dims[i], usable[i], values[i] = len(a), True, a / norm
    return dims, usable, values


def directions(tree: int, depth: int, dim: int, level: int = 0) -> np.ndarray:
    """Random unit directions of a tree's levels, a row each; the same in every task."""
    d = np.random.default_rng([SEED, tree, dim, level]).standard_normal((max(1, depth), dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def fit_tree(x: np.ndarray, axes: np.ndarray, spill: float) -> list[np.ndarray]:
    """For each level, the median of every node's projections; infinite, so that all rows go left, where a cut wouldn't thin the node out."""
    nodes, levels = [np.arange(len(x))], []
    for axis in axes:
        cut, below = np.full(len(nodes), np.inf), []
        for k, rows in enumerate(nodes):
            p = x[rows] @ axis
            m = np.median(p) if len(rows) else 0.0
            a, b = rows[p <= m + spill], rows[p > m - spill]
            if max(len(a), len(b)) <= 0.8 * len(rows):
                cut[k] = m
            else:
                a, b = rows, rows[:0]
            below += [a, b]
        nodes = below
        levels.append(cut)
    return levels


def leaves(x: np.ndarray, levels: list[np.ndarray], axes: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every vector; one within ``spill`` of a cut goes both ways."""
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level, cut in enumerate(levels):
        gap = (x @ axes[level])[row] - cut[node]
        left, right = gap <= spill, gap > -spill
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    return row, node


def nodes(x: np.ndarray, leaf: int, spill: float, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """The rows of each node of one more random tree in this group.

    Splitting stops when a node is small, or when a cut no longer thins it out (a tight cluster).
    """
    work = [np.arange(len(x))]
    while work:
        rows = work.pop()
        if len(rows) > leaf:
            d = rng.standard_normal(x.shape[1])
            p = x[rows] @ (d / np.linalg.norm(d))
            cut = np.median(p)
            a, b = rows[p <= cut + spill], rows[p > cut - spill]
            if max(len(a), len(b)) <= 0.8 * len(rows):
                work += [a, b]
                continue
        yield rows


def lot(ids: np.ndarray) -> np.ndarray:
    return H.scramble(ids.view(np.uint64) + np.uint64(SEED))


def centres(x: np.ndarray, ids: np.ndarray, near: float, leaf: int, spill: float, rng: np.random.Generator, block: int = 512) -> np.ndarray:
    """For each row, the row of least lot among those that a node shows within the cosine ``near``, itself included."""
    order = np.argsort(lot(ids), kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    best = place.copy()
    for rows in nodes(x, leaf, spill, rng):
        rows = rows[np.argsort(place[rows], kind="stable")]
        for i in range(0, len(rows), block):
            some = rows[i : i + block]
            todo = np.arange(len(some))
            for j in range(0, i + len(some), block):  # a row that has met one has its best
                close = x[some[todo]] @ x[rows[j : j + block]].T >= near
                met = close.any(1)
                best[some[todo[met]]] = np.minimum(best[some[todo[met]]], place[rows[j + close[met].argmax(1)]])
                todo = todo[~met]
                if not len(todo):
                    break
    return order[best]


def close_pairs(x: np.ndarray, centre: np.ndarray, least: float, leaf: int, spill: float, rng: np.random.Generator, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different centres with a cosine of at least ``least`` that one more random tree finds in this group."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for rows in nodes(x, leaf, spill, rng):
        for i in range(0, len(rows), block):
            for j in range(i, len(rows), block):
                a, b = rows[i : i + block], rows[j : j + block]
                r, s = np.nonzero((x[a] @ x[b].T >= least) & (centre[a][:, None] != centre[b][None, :]))
                left.append(np.minimum(a[r], b[s]))
                right.append(np.maximum(a[r], b[s]))
    pairs = np.unique(np.column_stack([np.concatenate(left), np.concatenate(right)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision of shipped ones: doubles are unit vectors already, floats are as they were given."""
    rows, data = len(column), b"".join(column.to_pylist())
    if len(data) == 8 * rows * dim:
        return np.frombuffer(data, np.float64).reshape(rows, dim)
    x = np.frombuffer(data, np.float32).reshape(rows, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng([SEED, *(int(k) & (1 << 63) - 1 for k in key)])


class Forest:
    """Deals rows of ``classes`` (id, v) to the leaves of random-projection trees."""

    def __init__(self, classes: DataFrame, trees: int, spill: float, group: int, sample_rows: int) -> None:
        self.trees, self.spill, self.group = trees, spill, group
        self.floats = classes.schema["v"].dataType.elementType.typeName() == "float"
        self.held: list[DataFrame] = []
        n = classes.count()
        sample = [r.v for r in classes.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()]  # sample_rows, a bound
        unit = {d: np.array([np.array(v) / np.linalg.norm(v) for v in sample if len(v) == d]) for d in {len(v) for v in sample}}
        self.depth, most = 0, max(0, int(math.log2(max(1, len(sample) / 16))))
        while n > group and self.depth < most and self._rows(unit, n) > FILL * group:
            self.depth += 1
        self.fits = {d: [fit_tree(x, directions(t, self.depth, d)[: self.depth], spill) for t in range(trees)] for d, x in unit.items()}

    def _rows(self, unit: dict[int, np.ndarray], n: int) -> float:
        """Rows of a leaf at this depth, by the sample, those that go both ways counted twice."""
        dealt = 0
        for d, x in unit.items():
            axes = directions(0, self.depth, d)[: self.depth]
            dealt += len(leaves(x, fit_tree(x, axes, self.spill), axes, self.spill)[0])
        return n * dealt / sum(map(len, unit.values())) / 2**self.depth

    def release(self) -> None:
        """Delete the tables behind what :meth:`deal` gave."""
        discard(*self.held)
        self.held.clear()

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(stage(df, name))
        return self.held[-1]

    def _first(self, classes: DataFrame, trees: int) -> DataFrame:
        """(id, v, centre) -> DEALT by the upper levels."""
        fits, depth, spill, floats = self.fits, self.depth, self.spill, self.floats

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dim, ok, unit = unit_vectors(b.column("v"))
                ids, centre = b.column("id").to_numpy(), b.column("centre").to_numpy()
                for d in np.unique(dim[ok]):
                    own = np.flatnonzero(ok & (dim == d))
                    x = np.array([unit[i] for i in own])
                    given = b.column("v").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if floats else x
                    for t in range(trees):
                        row, node = leaves(x, fits[int(d)][t] if int(d) in fits else [], directions(t, max(1, depth), int(d)), spill)
                        yield _dealt(t, int(d), 0, node, ids[own][row], centre[own][row], given[row])

        return classes.select("id", "v", "centre").mapInArrow(deal, DEALT)

    def deal(self, classes: DataFrame, trees: int) -> tuple[DataFrame, DataFrame | None]:
        """DEALT rows of leaves that fit a task, and those of larger leaves that no longer thin out, if there are any."""
        now, fit, tight, n_round = self._first(classes, trees), None, None, 0
        both = lambda a, b: b if a is None else a.unionByName(b)
        sizes = now.groupBy(*LEAF).agg(F.count("*").alias("n"))
        large = self._stage(sizes.where(F.col("n") > self.group).withColumn("stuck", F.lit(False)), "leaves")
        while large.take(1):
            rows = now.join(large, LEAF)
            fit = both(fit, now.join(large, LEAF, "left_anti"))
            tight = both(tight, rows.where("stuck").drop("n", "stuck"))
            more = stage(rows.where("not stuck"), "oversized")
            now = self._stage(self._split(more, n_round + 1), "leaves")
            n_round += 1
            # A child with most of its parent's rows is a cluster that cuts don't thin out.
            parents = more.groupBy(*LEAF).agg(F.first("n").alias("whole")).select("tree", "dim", (F.col("leaf") * (1 << LEVELS)).alias("low"), "whole")
            sizes = now.groupBy(*LEAF).agg(F.count("*").alias("n")).where(F.col("n") > self.group)
            same = [sizes["tree"] == parents["tree"], sizes["dim"] == parents["dim"], sizes["leaf"] - F.pmod(sizes["leaf"], F.lit(1 << LEVELS)) == parents["low"]]
            large = self._stage(sizes.join(parents, same).select(*[sizes[c] for c in LEAF], "n", (F.col("n") > 0.8 * F.col("whole")).alias("stuck")), "leaves")
            discard(more)
        return both(fit, now), tight

    def _split(self, rows: DataFrame, n_round: int) -> DataFrame:
        """Rows of oversized leaves (with n) -> DEALT, as many levels further down as their rows ask for, LEVELS at most."""
        spill, group = self.spill, FILL * self.group

        def fit(key: tuple, table: pa.Table) -> pa.Table:
            t, d, _, leaf = (k.as_py() for k in key)
            levels = min(LEVELS, max(1, math.ceil(math.log2(table.column("n")[0].as_py() / group))))
            cuts = fit_tree(_matrix(table.column("x"), d), directions(t, LEVELS, d, n_round)[:levels], spill)
            return pa.table({**{c: pa.array([k.as_py()], pa.int64() if c == "leaf" else pa.int32()) for c, k in zip(LEAF, key, strict=True)}, "cuts": pa.array([np.concatenate(cuts).tolist()], pa.list_(pa.float64()))})

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tree, dim, leaf, ids, centre = (b.column(c).to_numpy() for c in ("tree", "dim", "leaf", "id", "centre"))
                for t, d, k in sorted(set(zip(tree.tolist(), dim.tolist(), leaf.tolist(), strict=True))):
                    own = np.flatnonzero((tree == t) & (dim == d) & (leaf == k))
                    cuts = np.array(b.column("cuts")[int(own[0])].as_py())
                    given = b.column("x").take(pa.array(own))
                    row, node = leaves(_matrix(given, d), [cuts[(1 << i) - 1 : (2 << i) - 1] for i in range(len(cuts).bit_length())], directions(t, LEVELS, d, n_round), spill)
                    yield _dealt(t, d, n_round, k * (1 << LEVELS) + node, ids[own][row], centre[own][row], given.take(pa.array(row)))

        few = rows.where(F.pmod(F.xxhash64("id", F.lit(n_round)), F.col("n")) < SEEN).select(*LEAF, "n", "x")
        cuts = few.groupBy(*LEAF).applyInArrow(fit, "tree int, dim int, round int, leaf long, cuts array<double>")
        return rows.join(cuts, LEAF).select(*LEAF, "id", "centre", "x", "cuts").mapInArrow(split, DEALT)


def _dealt(tree: int, dim: int, n_round: int, leaf: np.ndarray, ids: np.ndarray, centre: np.ndarray, x: np.ndarray | pa.Array) -> pa.RecordBatch:
    n = len(leaf)
    x = x if isinstance(x, pa.Array) else pa.array([v.tobytes() for v in x], pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, tree, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, n_round, np.int32)), pa.array(leaf), pa.array(ids), pa.array(centre), x,
    ], names=DEALT.replace(",", "").split()[::2])


def _find_centres(fit: DataFrame, tight: DataFrame | None, near: float, leaf: int, spill: float) -> DataFrame:
    """(id, to): a centre of each vector that has another than itself, over all its leaves."""

    def seek(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        best = ids[centres(_matrix(table.column("x"), key[1].as_py()), ids, near, leaf, spill, _rng(*(k.as_py() for k in key)))]
        other = best != ids
        return pa.table({"id": pa.array(ids[other]), "to": pa.array(best[other])})

    found = fit.groupBy(*LEAF).applyInArrow(seek, "id long, to long")
    if tight is not None:
        # The vectors of a tight leaf look only at its least one.
        chief = tight.groupBy(*LEAF).agg(F.min_by(F.struct("id", "x"), F.xxhash64("id")).alias("c"))

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, to = b.column("id").to_numpy(), b.column("to").to_numpy()
                d = b.column("dim").to_numpy()
                close = np.zeros(len(own), bool)
                for k in np.unique(d):
                    i = np.flatnonzero(d == k)
                    close[i] = np.einsum("ij,ij->i", *(_matrix(b.column(c).take(pa.array(i)), int(k)) for c in ("x", "y"))) >= near
                i = np.flatnonzero(close & (own != to))
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(to[i])], names=["id", "to"])

        pairs = tight.join(chief, LEAF).select("dim", "id", "x", F.col("c.id").alias("to"), F.col("c.x").alias("y"))
        found = found.unionByName(pairs.mapInArrow(beside, "id long, to long"))
    return found.groupBy("id").agg(F.min_by("to", F.xxhash64("to")).alias("to"))


def _find_links(fit: DataFrame, tight: DataFrame | None, least: float, leaf: int, spill: float, part: int) -> DataFrame:
    """(a, b): pairs of different centres."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        a, b = close_pairs(_matrix(table.column("x"), key[1].as_py())[order], table.column("centre").to_numpy()[order], least, leaf, spill, _rng(*(k.as_py() for k in key)))
        return pa.table({"a": pa.array(ids[order[a]]), "b": pa.array(ids[order[b]])})

    found = fit.groupBy(*LEAF).applyInArrow(compare, "a long, b long")
    if tight is not None:
        # Vectors outside a leaf's main centre against all of the leaf, as a table of parts.
        counts = tight.groupBy(*LEAF, "centre").agg(F.count("*").alias("n")).groupBy(*LEAF).agg(F.max_by("centre", F.struct("n", "centre")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        counts = counts.select(*LEAF, "main", F.ceil((F.col("all") - F.col("most")) / part).cast("int").alias("rows"), F.ceil(F.col("all") / part).cast("int").alias("cols")).where("rows > 0")
        placed = tight.join(counts, LEAF)
        at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = placed.where("centre <> main").withColumn("row", at("rows")).withColumn("col", every("cols")).withColumn("rest", F.lit(True))
        y = placed.withColumn("col", at("cols")).withColumn("row", every("rows")).withColumn("rest", F.lit(False))

        def against(key: tuple, table: pa.Table) -> pa.Table:
            ids, centre, rest = (table.column(c).to_numpy() for c in ("id", "centre", "rest"))
            v = _matrix(table.column("x"), key[1].as_py())
            mine, all_ = np.flatnonzero(rest), np.flatnonzero(~rest)
            out = [np.empty((0, 2), np.int64)]
            for i in range(0, len(mine), 512):
                a = mine[i : i + 512]
                r, s = np.nonzero((v[a] @ v[all_].T >= least) & (centre[a][:, None] != centre[all_][None, :]))
                out.append(np.sort(np.column_stack([ids[a[r]], ids[all_[s]]]), axis=1))
            pairs = np.unique(np.concatenate(out), axis=0)
            return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

        found = found.unionByName(x.unionByName(y).groupBy(*LEAF, "row", "col").applyInArrow(against, "a long, b long"))
    return found.distinct()


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.95,
    trees: int = 12,
    spill: float = 0.02,
    leaf: int = 256,
    group: int = 4096,
    sample_rows: int = 4096,
) -> DataFrame:
    """Link vectors with a cosine of at least ``least``; groups are what links connect.

    Returns, per row: vec_id, n_links (other vectors linked directly), component_id (the smallest
    id reachable), kept (vec_id = component_id), centre_id: vectors of one centre are all linked,
    so centres, memberships and listed pairs stand for all links. Null vectors, zero ones and
    those with null or non-finite components link with nothing, nor do rows with null ids;
    vectors of different lengths never do. Equal vectors are one class that is compared once and
    linked with itself; rows with equal ids count as one node (its rows are listed each); other
    columns, whatever their names, are ignored; an empty table gives an empty table.
    ``sample_rows`` bounds the sample that the trees' upper levels see; every row is indexed.
    Found links are true ones; measured recall is in the tests and the README.
    """
    floats = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<float>" if floats else "array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = stage(rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("key", F.when(F.col("good"), F.sha2(F.array_join("v", ",").cast("binary"), 256))), "vectors")
    usable = rows.where("good")
    classes = stage(usable.groupBy("key").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("size"), F.first("v").alias("v")), "classes")
    forest = Forest(classes, trees, spill, group, sample_rows)

    # Half the link angle, and a little less: two vectors this close to a third are linked.
    near = math.sqrt((1 + least) / 2) + 1e-9
    to = stage(_find_centres(*forest.deal(classes.withColumn("centre", F.col("id")), max(1, trees // 3)), near, leaf, spill), "centres")
    forest.release()
    about = stage(classes.join(to, "id", "left").select("key", "id", "size", "v", F.coalesce("to", "id").alias("centre")), "classes")
    links = stage(_find_links(*forest.deal(about, trees), least, leaf, spill, group // 2), "links")
    forest.release()
    discard(classes, to)

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(about.select(F.col("id").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others")).withColumnRenamed("a", "id")
    within = about.groupBy("centre").agg(F.sum("size").alias("mates"))
    groups = components(links.unionByName(about.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b"))))
    per = about.select("key", "id", "centre").join(within, "centre").join(degree, "id", "left").join(groups, "id", "left")
    per = per.select("key", "centre", (F.col("mates") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("vec_id", "key").join(per, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.coalesce("centre", "vec_id").alias("centre_id"),
    )
