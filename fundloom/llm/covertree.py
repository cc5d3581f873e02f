"""All pairs of vectors within a cosine threshold, by a dual traversal of a cover tree.

Unit vectors whose cosine is at least ``least`` are those at a distance of
``sqrt(2 - 2 least)`` or less, so the triangle inequality of distances prunes.
Equal vectors are one point from the start.

The tree is built level by level as Spark tables. A cell with more than ``LEAF``
points is divided: centres, its own among them, are taken farthest first from a
sample until all of the sample is within half the cell's radius, and every point
goes to the nearest one. The sample only chooses centres; radii are the greatest
distances of all points of a cell, so bounds hold whatever it was. A cell in
which any two points are close enough (a radius of half the threshold) stays
whole, however many points it has: its pairs are counted, not compared. Inside
a leaf, points within that radius of one another are joined to last nodes.

The traversal begins with the root against itself. A pair of cells is dropped
if the distance of its centres exceeds both radii and the threshold, is all
links if distance and radii together stay below the threshold, and is divided
otherwise. Pairs of leaves that remain are compared two leaves at a time, node
against node by the same bounds, and point against point in double precision
where no bound tells. A whole cell of any size is first met by its centre: only
points near enough to it are compared with its members, in chunks.

Pairs of leaves may be as many as the square of the leaves, so vectors aren't
dealt by pairs: leaves are a table, and a cartesian product reads two parts of it
in each task, without a shuffle. Tables are deleted once nothing reads them, and
files of shuffles with their query, so disk grows with the vectors alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.llm.components import connected_components
from fundloom.llm.shared import Scratch, materialise, shuffles_dropped

#: Points of a leaf, at most, unless all its pairs are links; centres of a cell; points that centres are chosen from.
LEAF, FANOUT, SAMPLE = 8192, 16, 512
#: Centres of whole cells that a leaf meets in one task.
HEADERS = 1024
#: Rounding that bounds leave room for.
SLACK = 1e-9
#: Rows of a product of node centres at a time.
TILE = 512


def units_of(data: bytes | memoryview, dim: int, kind: str) -> np.ndarray:
    """Unit vectors of raw ones; scaled first, so that no square overflows or vanishes."""
    v = np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, of each row of ``a`` and each of ``b``."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def farthest_first(points: np.ndarray, most: int, radius: float | None) -> list[int]:
    """Rows of ``points`` from the first on, each farthest from those before, until all are within half the radius."""
    chosen, away = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < most:
        k = int(away.argmax())
        if radius is None:
            radius = 2.0 ** math.ceil(math.log2(away[k])) if away[k] > 0 else 0.0
        if away[k] <= (radius / 2 if len(chosen) > 1 else 0):
            break
        chosen.append(k)
        away = np.minimum(away, distances(points, points[k : k + 1])[:, 0])
    return chosen


def last_nodes(u: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each node, its radius): rows within ``radius`` of a node's first row stand together."""
    n = len(u)
    close, low = np.zeros(n, bool), u.astype(np.float32)
    least = np.float32(1 - radius * radius / 2 - 1e-5)
    for at in range(0, n, TILE):
        close[at : at + TILE] = ((low[at : at + TILE] @ low.T) >= least).sum(axis=1) > 1
    free = np.flatnonzero(close)
    order, starts, radii = [np.flatnonzero(~close)], list(range(n - len(free))), [0.0] * (n - len(free))
    at = n - len(free)
    while len(free):
        d = distances(u[free], u[free[:1]])[:, 0]
        d[0] = 0
        own = d <= radius
        order.append(free[own])
        starts.append(at)
        radii.append(float(d[own].max()))
        at += int(own.sum())
        free = free[~own]
    return np.concatenate(order), np.array(starts, np.int64), np.array(radii)


class Block:
    """Points of one leaf, or of a part of one, that stand by last nodes (``_packed``)."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, units: np.ndarray, starts: np.ndarray, radii: np.ndarray):
        self.nodes, self.weights, self.units, self.starts, self.radii = nodes, weights, units, starts, radii
        self.ends = np.append(starts[1:], len(nodes))
        self.centres = units if len(starts) == len(nodes) else units[starts]
        self.low = self.centres.astype(np.float32)
        self.total = np.add.reduceat(weights, starts)
        self.added = np.zeros(len(nodes), np.int64)


def compare(a: Block, b: Block, reach: float, least: float) -> list[tuple[int, int]]:
    """Count the links between two blocks in ``added`` of both, and return links that join the same components.

    A block against itself counts the links within it, each node's own among them.
    """
    found: list[tuple[int, int]] = []
    same = a is b
    if same:
        size = a.ends - a.starts
        a.added += np.repeat(a.total, size) - a.weights
        first = np.repeat(a.nodes[a.starts], size)
        apart = np.flatnonzero(a.nodes != first)
        found += zip(a.nodes[apart].tolist(), first[apart].tolist(), strict=True)
    bound = reach + a.radii.max() + b.radii.max() + 1e-6
    screen = np.float32(1 - bound * bound / 2 - 1e-5)
    for at in range(0, len(a.starts), TILE):
        near = (a.low[at : at + TILE] @ b.low[at if same else 0 :].T) >= screen
        i, j = np.nonzero(near)
        i, j = i + at, j + (at if same else 0)
        if same:
            i, j = i[j > i], j[j > i]
        if not len(i):
            continue
        cosine = np.einsum("ij,ij->i", a.centres[i], b.centres[j])
        away, room = np.sqrt(np.maximum(0, 2 - 2 * cosine)), a.radii[i] + b.radii[j]
        single = (a.ends[i] - a.starts[i] == 1) & (b.ends[j] - b.starts[j] == 1)
        linked = single & (cosine >= least)
        whole = ~single & (away + room <= reach - SLACK)
        np.add.at(a.added, a.starts[i[linked]], b.weights[b.starts[j[linked]]])
        np.add.at(b.added, b.starts[j[linked]], a.weights[a.starts[i[linked]]])
        for p, q in zip(i[whole].tolist(), j[whole].tolist(), strict=True):
            a.added[a.starts[p] : a.ends[p]] += b.total[q]
            b.added[b.starts[q] : b.ends[q]] += a.total[p]
        some = linked | whole
        found += zip(a.nodes[a.starts[i[some]]].tolist(), b.nodes[b.starts[j[some]]].tolist(), strict=True)
        part = ~single & ~whole & (away <= room + reach + SLACK)
        for p, q in zip(i[part].tolist(), j[part].tolist(), strict=True):
            left, right = slice(a.starts[p], a.ends[p]), slice(b.starts[q], b.ends[q])
            hit = a.units[left] @ b.units[right].T >= least
            if hit.any():
                a.added[left] += hit @ b.weights[right]
                b.added[right] += hit.T @ a.weights[left]
                found.append((int(a.nodes[a.starts[p]]), int(b.nodes[b.starts[q]])))
    return found


FOUND = "node long, added long, other long"


def _found(blocks: list[Block], links: list[tuple[int, int]]) -> pa.RecordBatch:
    nodes = [b.nodes[b.added > 0] for b in blocks]
    added = [b.added[b.added > 0] for b in blocks]
    n = sum(map(len, nodes))
    ends = np.array(links, np.int64).reshape(-1, 2)
    empty = pa.nulls(len(ends), pa.int64()), pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*nodes, ends[:, 0]])), pa.concat_arrays([pa.array(np.concatenate([*added, np.zeros(0, np.int64)])), empty[0]]), pa.concat_arrays([empty[1], pa.array(ends[:, 1])])], names=["node", "added", "other"])


#: Columns of a block, and how their bytes are read.
PARTS = {"nodes": np.int64, "weights": np.int64, "starts": np.int64, "radii": np.float64}


def _compared(kind: str, reach: float, least: float):
    """Over pairs of blocks (key, dim, same, raw, nodes..., raw_, nodes_...): counts and links. Pairs of one block follow each other, so it is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, a = None, None
        for batch in batches:
            names, dims = batch.column("key").to_pylist(), batch.column("dim").to_pylist()

            def block(k: int, end: str, batch: pa.RecordBatch = batch, dims: list[int] = dims) -> Block:
                nodes, weights, starts, radii = (np.frombuffer(batch.column(c + end)[k].as_buffer(), t) for c, t in PARTS.items())
                return Block(nodes, weights, units_of(batch.column("raw" + end)[k].as_buffer(), dims[k], kind), starts, radii)

            for k, same in enumerate(batch.column("same").to_pylist()):
                if a is None or names[k] != key:
                    key, a = names[k], block(k, "")
                b = a if same else block(k, "_")
                links = compare(a, b, reach, least)
                found = _found([a] if same else [a, b], links)
                a.added[:] = 0
                if found.num_rows:
                    yield found

    return run


def _near_headers(kind: str, reach: float):
    """Of one leaf's part with a list of whole cells (dim, nodes, weights, raw, cells, centres, radii): (cell, node, weight, dim, raw) of points that may reach one."""

    def run(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        u = units_of(row["raw"], row["dim"], kind)
        x, k = np.nonzero(distances(u, units_of(b"".join(row["centres"]), row["dim"], kind)) <= np.array(row["radii"]) + reach + SLACK)
        width = len(row["raw"]) // len(u)
        nodes, weights = (np.frombuffer(row[c], np.int64)[x] for c in ("nodes", "weights"))
        raw = [row["raw"][i * width : (i + 1) * width] for i in x.tolist()]
        columns = [pa.array([row["cells"][i] for i in k.tolist()], pa.string()), pa.array(nodes), pa.array(weights), pa.array([row["dim"]] * len(x), pa.int32()), pa.array(raw, pa.binary())]
        return pa.table(columns, names=["cell", "node", "weight", "dim", "raw"])

    return run


def _points(kind: str):
    """Over (row, vec_id, vector): its bytes, or null for a vector that links with nothing, and a digest of them."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, keys, dims = [], [], []
            for vector in batch.column("vector"):
                data = None
                if vector.is_valid and len(vector.values) and not vector.values.null_count:
                    v = vector.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # no negative zero
                    if np.isfinite(v).all() and v.any():
                        data = v.tobytes()
                raw.append(data)
                dims.append(len(vector.values) if data else None)
                keys.append(hashlib.blake2b(data, digest_size=16, key=str(len(vector.values)).encode()).digest() if data else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["row", "vec_id", "dim", "key", "raw"])

    return run


def _centres(kind: str, fanout: int):
    """Of the sample of one cell: its centre and new centres, with the paths of their cells."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        first = rows[0]
        raw = ([first["centre"]] if first["centre"] is not None else []) + [r["raw"] for r in rows]
        chosen = farthest_first(units_of(b"".join(raw), first["dim"], kind), fanout, 2.0 ** math.ceil(math.log2(first["radius"])) if first["centre"] is not None else None)
        columns = [[first["cell"]] * len(chosen), [f"{first['cell']}/{k}" for k in range(len(chosen))], [raw[k] for k in chosen]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["parent", "cell", "centre"])

    return run


def _nearest(kind: str):
    """Points of a part of one cell, each in the cell of the nearest of the new centres."""

    def run(points: pa.Table, centres: pa.Table) -> pa.Table:
        dim = points.column("dim")[0].as_py()
        u = units_of(b"".join(points.column("raw").to_pylist()), dim, kind)
        c = units_of(b"".join(centres.column("centre").to_pylist()), dim, kind)
        d = distances(u, c)
        k = d.argmin(axis=1)
        cells = pa.array([centres.column("cell")[i].as_py() for i in k.tolist()], pa.string())
        return pa.table([points.column("node"), points.column("weight"), points.column("dim"), points.column("raw"), cells, pa.array(d[np.arange(len(k)), k])], names=POINT_NAMES)

    return run


POINTS = "node long, weight long, dim int, raw binary, cell string, away double"
POINT_NAMES = ["node", "weight", "dim", "raw", "cell", "away"]


def cover_tree(points: DataFrame, kind: str, reach: float, scratch: Scratch, leaf: int, fanout: int, sample: int) -> tuple[DataFrame, DataFrame, int]:
    """(points with their leaf, cells, depth) for ``points(node, weight, dim, raw)``; vectors of each dimension are a tree of their own.

    Cells: (cell, parent, centre, radius, n, weight, first, leaf); a root has no centre and the radius 2.
    A table of points is dropped once the next level of it is written, ``points`` too.
    """
    given, points = points, points.select("node", "weight", "dim", "raw", F.concat(F.lit("r"), "dim").alias("cell"), F.lit(2.0).alias("away"))
    cells, known, depth = None, None, 0
    while True:
        sizes = points.groupBy("cell").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("node").alias("first"), F.max("away").alias("radius"))
        sizes = sizes.where(F.length(F.regexp_replace("cell", "[^/]", "")) == depth)
        if known is None:
            here = sizes.select("cell", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("binary").alias("centre"), "radius", "n", "weight", "first")
        else:
            here = sizes.join(known, "cell").select("cell", "parent", "centre", "radius", "n", "weight", "first")
        here = scratch.table(here.withColumn("leaf", (F.col("n") <= leaf) | (F.col("radius") <= reach / 2 - SLACK)), "cells")
        cells = here if cells is None else cells.unionByName(here)
        open_ = here.where("NOT leaf").select("cell", "n", "radius", "centre", "first")
        if not open_.take(1):
            return points, cells, depth
        held = points.join(open_.withColumnRenamed("cell", "open"), F.col("cell") == F.col("open"))
        drawn = held.where((F.col("node") == F.col("first")) | (F.pmod(F.xxhash64("node", F.lit(depth)), F.col("n")) < sample)).select("cell", "node", "dim", "raw", "radius", "centre")
        known = scratch.table(drawn.groupBy("cell").applyInArrow(_centres(kind, fanout), "parent string, cell string, centre binary"), "centres")
        # Parts of bounded size, so that no cell is one task's; each part meets its cell's new centres.
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / leaf)).alias("part")
        left = held.select("node", "weight", "dim", "raw", "cell", part)
        parts = open_.select(F.col("cell").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / leaf) - 1)).alias("part_"))
        right = parts.join(known, F.col("of") == F.col("parent")).select("of", "part_", F.col("cell").alias("cell"), "centre")
        divided = left.groupBy("cell", "part").cogroup(right.groupBy("of", "part_")).applyInArrow(_divided(kind), POINTS)
        kept = points.join(open_.select(F.col("cell").alias("open")), F.col("cell") == F.col("open"), "left_anti")
        before = points if depth else given
        points, depth = scratch.table(kept.select(*POINT_NAMES).unionByName(divided), "points"), depth + 1
        scratch.drop(before)


def _divided(kind: str):
    nearest = _nearest(kind)

    def run(points: pa.Table, centres: pa.Table) -> pa.Table:
        if not len(points):
            return pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("dim", pa.int32()), ("raw", pa.binary()), ("cell", pa.string()), ("away", pa.float64())]).empty_table()
        return nearest(points, centres)

    return run


def _bounded(kind: str, reach: float):
    """Over pairs of cells with centres and radii: those that may hold links, and whether all their pairs are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, whole = [], []
            for k, r in enumerate(batch.select(["cell", "cell_", "centre", "centre_", "radius", "radius_"]).to_pylist()):
                away = 0.0
                if r["cell"] != r["cell_"] and r["centre"] is not None and r["centre_"] is not None:
                    both = units_of(r["centre"] + r["centre_"], len(r["centre"]) // np.dtype(kind).itemsize, kind)
                    away = float(distances(both[:1], both[1:])[0, 0])
                if away <= r["radius"] + r["radius_"] + reach + SLACK:
                    keep.append(k)
                    whole.append(away + r["radius"] + r["radius_"] <= reach - SLACK)
            out = batch.select(["cell", "cell_"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(whole, pa.bool_())], names=["cell", "cell_", "whole"])

    return run


def leaf_pairs(cells: DataFrame, depth: int, kind: str, reach: float, scratch: Scratch) -> DataFrame:
    """(cell, cell_, whole): pairs of leaves that may hold links, each once, by descending from the roots."""
    own = [c for c in ("cell", "centre", "radius")]
    step = cells.where("parent IS NOT NULL").select(F.col("parent").alias("above"), *own).unionByName(cells.where("leaf").select(F.col("cell").alias("above"), *own))
    step = scratch.table(step, "steps")
    pairs = cells.where("parent IS NULL").select(F.col("cell").alias("p"), F.col("cell").alias("q"))
    for _ in range(max(1, depth)):
        left, right = step.withColumnRenamed("above", "p"), step.select(F.col("above").alias("q"), *(F.col(c).alias(f"{c}_") for c in own))
        met = pairs.join(left, "p").join(right, "q").where("p <> q OR cell <= cell_").select("cell", "cell_", "centre", "centre_", "radius", "radius_")
        found = scratch.table(met.mapInArrow(_bounded(kind, reach), "cell string, cell_ string, whole boolean"), "pairs")
        pairs = found.select(F.col("cell").alias("p"), F.col("cell_").alias("q"))
    return found


def _packed(points: DataFrame, keys: list[str], kind: str, reach: float) -> DataFrame:
    """Points as one row for each value of ``keys``: their ids, weights and vectors as bytes, by last nodes, whose starts and radii come along."""

    def run(table: pa.Table) -> pa.Table:
        raw, dim = b"".join(table.column("raw").to_pylist()), table.column("dim")[0].as_py()
        order, starts, radii = last_nodes(units_of(raw, dim, kind), reach / 2 - SLACK)
        numbers = [*(np.asarray(table.column(c).to_numpy(), np.int64)[order] for c in ("node", "weight")), starts, radii]
        columns = [*(table.column(k)[:1] for k in keys), table.column("dim")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in (*numbers, np.frombuffer(raw, kind).reshape(-1, dim)[order]))]
        return pa.table(columns, names=[*keys, "dim", *PARTS, "raw"])

    types = dict(points.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", dim int, " + ", ".join(f"{c} binary" for c in (*PARTS, "raw"))
    return points.select(*keys, "node", "weight", "dim", "raw").groupBy(*keys).applyInArrow(run, schema)


def _met(left: DataFrame, right: DataFrame, meet: Column, same: Column, kind: str, reach: float, least: float) -> DataFrame:
    """Counts and links of the pairs of blocks that ``meet``; ``right`` has its columns with an underscore, ``left`` a ``key`` of its block.

    A product of the parts of both tables, each read where it is met: no
    vector is shuffled, and a task holds one part.
    """
    pairs = left.join(right.hint("shuffle_replicate_nl"), meet)
    sides = [c + end for end in ("", "_") for c in (*PARTS, "raw")]
    return pairs.select("key", "dim", same.alias("same"), *sides).mapInArrow(_compared(kind, reach, least), FOUND)


def vector_links(points: DataFrame, kind: str, least: float, scratch: Scratch, leaf: int = LEAF, fanout: int = FANOUT, sample: int = SAMPLE) -> DataFrame:
    """(node, added, other) for ``points(node, weight, dim, raw)``: shares of the weights that a node links with, and links that join all components."""
    reach = math.sqrt(2 - 2 * least)
    placed, cells, depth = cover_tree(points, kind, reach, scratch, leaf, fanout, sample)
    pairs = leaf_pairs(cells, depth, kind, reach, scratch)
    size = cells.select("cell", "n", "weight", "first", "centre", "radius")
    whole = pairs.where("whole")
    # Pairs that are links as a whole: sums of weights by cell, each point to the first of one partner, and firsts to firsts.
    other = size.select(F.col("cell").alias("cell_"), F.col("weight").alias("weight_"), F.col("first").alias("first_"))
    twice = whole.select("cell", "cell_").unionByName(whole.where("cell <> cell_").select(F.col("cell_").alias("cell"), F.col("cell").alias("cell_")))
    partner = twice.join(other, "cell_")
    by_cell = partner.groupBy("cell").agg(F.sum("weight_").alias("sum"), F.min("first_").alias("to"), F.max((F.col("cell") == F.col("cell_")).cast("int")).alias("own"))
    by_cell = scratch.table(by_cell, "whole")
    in_whole = placed.join(by_cell, "cell").select("node", (F.col("sum") - F.col("own") * F.col("weight")).alias("added"), F.col("to").alias("other"))
    null = F.lit(None).cast("long")
    firsts = partner.join(size.select("cell", "first"), "cell").select(F.col("first").alias("node"), null.alias("added"), F.col("first_").alias("other"))
    # Leaves with leaves.
    ask = scratch.table(pairs.where("NOT whole").join(size.select("cell", "n"), "cell").join(size.select(F.col("cell").alias("cell_"), F.col("n").alias("n_")), "cell_").select("cell", "cell_", "n", "n_"), "ask")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / leaf)).alias("part")
    whole_counts = scratch.table(in_whole, "in-whole")
    partners = ask.where(f"n <= {leaf} AND n_ <= {leaf}").groupBy("cell").agg(F.collect_list("cell_").alias("partners"))
    packed = _packed(placed.join(size.select("cell", "n"), "cell").select(*POINT_NAMES, part), ["cell", "part"], kind, reach)
    # Not compressed, so that a part of the table is as large in memory as on disk.
    blocks = scratch.table(packed.join(partners, "cell", "left"), "blocks", "none")
    scratch.drop(placed)
    members = blocks.select(*(F.col(c).alias(f"{c}_") for c in ("cell", "part", *PARTS, "raw")))
    # Blocks of leaves that meet none don't take part.
    asks = blocks.where("partners IS NOT NULL").withColumn("key", F.col("cell"))
    found = _met(asks, members.where("part_ = 0"), F.array_contains("partners", F.col("cell_")), F.col("cell") == F.col("cell_"), kind, reach, least)
    out = whole_counts.unionByName(firsts).unionByName(scratch.table(found, "found"))
    # Whole cells of any size: their centres first.
    large = ask.where(f"n > {leaf} OR n_ > {leaf}")
    if not large.take(1):
        return out
    turned = large.select(F.when(F.col("n") > leaf, F.col("cell")).otherwise(F.col("cell_")).alias("of"), F.when(F.col("n") > leaf, F.col("cell_")).otherwise(F.col("cell")).alias("cell"))
    headers = turned.join(size.select(F.col("cell").alias("of"), "centre", "radius"), "of").withColumn("list", F.pmod(F.xxhash64("of"), F.lit(64)))
    lists = headers.groupBy("cell", "list").agg(F.collect_list(F.struct("of", "centre", "radius")).alias("h"))
    lists = lists.select("cell", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("h") / HEADERS).cast("int") - 1), lambda i: F.slice("h", i * HEADERS + 1, HEADERS))).alias("h"))
    asked = lists.join(blocks, "cell").select("cell", "part", F.col("h.of")[0].alias("of"), "dim", "nodes", "weights", "raw", F.col("h.of").alias("cells"), F.col("h.centre").alias("centres"), F.col("h.radius").alias("radii"))
    near = scratch.table(asked.groupBy("cell", "part", "of").applyInArrow(_near_headers(kind, reach), "cell string, node long, weight long, dim int, raw binary"), "near")
    counts = near.groupBy("cell").agg(F.count("*").alias("n"))
    asking = scratch.table(_packed(near.join(counts, "cell").select("cell", "node", "weight", "dim", "raw", part), ["cell", "part"], kind, reach), "asking", "none")
    scratch.drop(near)
    asking = asking.withColumn("key", F.concat_ws(":", "cell", "part"))
    last = _met(asking, members, F.col("cell") == F.col("cell_"), F.lit(False), kind, reach, least)
    return out.unionByName(scratch.table(last, "found"))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.95, leaf: int = LEAF, fanout: int = FANOUT, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding)``.

    Rows link if the cosine of their vectors is ``least`` or more in double
    precision; ``n_links`` is the number of other rows linked, ``component_id``
    the smallest vec_id reachable, ``kept`` whether it is the row's own.

    Vectors that are null, empty, zero or hold nulls or numbers that aren't
    finite link with nothing, and vectors of different lengths don't link.
    Equal rows link with each other, each counts. A null vec_id is no
    component's id as long as another row has one. An empty table gives no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    element = dict(vectors.dtypes)["embedding"]
    kind = "<f4" if element == "array<float>" else "<f8"
    vector = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    with shuffles_dropped(spark), Scratch(spark, "vectors") as scratch:
        named = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        rows = scratch.table(named.mapInArrow(_points(kind), "row long, vec_id long, dim int, key binary, raw binary"), "rows")
        keys = scratch.table(rows.select("vec_id", "key"), "keys")
        points = rows.where("raw IS NOT NULL").groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.min("vec_id").alias("least"))
        points = scratch.table(points, "points")
        scratch.drop(rows)
        classes = scratch.table(points.select("key", "node", "weight", "least"), "classes")
        found = scratch.table(vector_links(points, kind, least, scratch, leaf, fanout, sample), "links")
        groups = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), "vector-groups")
        added = found.where("added IS NOT NULL").groupBy("node").agg(F.sum("added").alias("added"))
        placed = classes.join(groups, "node", "left").join(added, "node", "left")
        placed = scratch.table(placed.select("key", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("added", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "placed")
        first = placed.groupBy("component").agg(F.min("least").alias("component_id"))
        told = placed.join(first, "component").select("key", "n_links", "component_id")
        out = keys.join(told, "key", "left")
        component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
        return materialise(out, "vectors-kept")
