"""Joining sets within Jaccard distance 1 - THRESHOLD inside given regions, for connected components.

Regions are groups of nodes such that linked nodes meet in one of them. Regions of few nodes are joined directly. Nodes of
larger ones are grouped anew, by the members that are rarest among them and by size, and these regions are joined recursively:

- Pivots are measured against every node of the region; nodes within the radius of a pivot are linked to it, and pivots leave.
- Of the pivots, those that lie further than NEAR from each other create Voronoi cells. A node within NEAR of its nearest pivot
  lies in that one's cell. Windows of the triangle inequality replicate boundary nodes: a node lies in the cell of every pivot
  that is at most twice the radius further away than its nearest one and at most NEAR plus the radius away. Nodes further than
  NEAR from all pivots form the far cell. Two linked nodes then share a cell: if either is within NEAR of its nearest pivot,
  the other one is in the window of that pivot's cell; if neither is, both are in the far cell.
- In a cell, nodes that are linked to its pivot are in one component and need not meet each other; those of them that are
  nearer to it than its nearest other node by more than the radius are done.

Cells replace their region only if they are MOST_SHARE of it at most and GROWTH times it in sum, so that the work of all levels
stays below that of measuring every pair; else the balls of single pivots are tried, and a region in which all nodes are near
each other goes on whole, without its pivots.

A cell of at most CELL members in all is joined to its end in memory, in one task. Larger ones are split by distributed rounds
as long as a round halves them; what a round does not halve is joined in pairs of blocks of bounded size, in one more round. So
rounds grow with the logarithm of a region's size, no task holds more than CELL members, and only links that join two
components are emitted: a group of thousands of near copies costs some distances per node, not its square of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components

#: Two sets link when THRESHOLD[1] * intersection >= THRESHOLD[0] * union.
THRESHOLD = (75, 100)
RADIUS = 1 - THRESHOLD[0] / THRESHOLD[1]
#: Nodes further than this from a pivot are not in its cell's core, and pivots of cells are further from each other.
NEAR = 0.5
#: Regions of at most so many nodes are joined directly.
SMALL = 16
#: Members of all sets of a cell that is joined in one task, and nodes that are measured against pivots in one task.
CELL, BLOCK = 1 << 21, 1024
#: Pivots of a distributed round and of a step in memory.
PIVOTS, STEP_PIVOTS = 48, 24
#: Cells may hold so many times the rows of their region in sum, and each one such a share of them.
GROWTH, MOST_SHARE = 1.25, 0.75
#: Common members that are counted at a time.
HITS = 1 << 20
EPS = 1e-9


def _linked(shared: Column, na: Column, nb: Column) -> Column:
    return THRESHOLD[1] * shared >= THRESHOLD[0] * (na + nb - shared)


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow them to link.

    A sketch counts a set's members by class of hash (counts are capped), so the sum of differences is at most the size of
    the symmetric difference: the triangle inequality again, with the classes as pivots. Large sets have a `wide` sketch of
    more classes, for the pairs that the first one leaves.
    """

    def possible(pairs: DataFrame, sketch: str, how: str) -> DataFrame:
        sides = [nodes.filter(F.col(sketch).isNotNull()).select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col(sketch).alias(f"{sketch}_{x}")) for x in "ab"]
        apart = F.aggregate(F.zip_with(f"{sketch}_a", f"{sketch}_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
        most = F.least("na", "nb", F.expr("na + nb") - F.ceil((F.col("na") + F.col("nb") + apart) / 2))
        joined = pairs.join(sides[0], "a", how).join(sides[1], "b", how)
        return joined.filter(F.coalesce(_linked(most, F.col("na"), F.col("nb")), F.lit(True))).select("a", "b")

    return possible(possible(pairs, "sketch", "inner"), "wide", "left")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by exact counts. Only the sets that occur are moved."""
    own = sets.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
    joined = pairs.join(own.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").join(own.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
    return joined.filter(_linked(F.size(F.array_intersect("ma", "mb")), F.size("ma"), F.size("mb"))).select("a", "b")


def distinct_regions(members: DataFrame, least: int = 2) -> DataFrame:
    """(region, node, size): of regions with the same nodes one is kept; regions below `least` nodes go."""
    seal = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("x"), F.sum(F.hash("node", F.lit(7)).cast("long")).alias("y"))
    kept = seal.filter(F.col("size") >= least).groupBy("size", "x", "y").agg(F.min("region").alias("region")).select("region", "size")
    return members.join(kept, "region")


def _direct(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) within regions of at most SMALL nodes that may link."""
    sized = members.join(nodes.select("node", "n"), "node")
    left = sized.select("region", F.col("node").alias("a"), F.col("n").alias("na"))
    right = sized.select("region", F.col("node").alias("b"), F.col("n").alias("nb"))
    alike = _linked(F.least("na", "nb"), F.col("na"), F.col("nb"))
    pairs = left.join(right, "region").filter("a < b").filter(alike).select("a", "b").distinct()
    return _bounded(pairs, nodes) if "sketch" in nodes.columns else pairs


def link(members: DataFrame, nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of nodes that link to another one, over links within the regions.

    `members`: region, node (long); `nodes`: node, n, weight (how central: higher first) and, where sets are large, sketch and
    wide (arrays of counts by class, the second one or null); both materialised. `fetch` gives the sets (node, members: array
    of distinct longs) of a table of nodes; it is asked once, for the nodes of pairs that sizes and sketches allow to link and
    those of large regions.
    """
    members = materialize(distinct_regions(members.distinct()), "regions")
    first = materialize(_direct(members.filter(F.col("size") <= SMALL), nodes), "candidates")
    flat = [first.select(F.col(x).alias("node"), F.lit(False).alias("crowd")) for x in "ab"]
    crowd = members.filter(F.col("size") > SMALL).select("node", F.lit(True).alias("crowd"))
    asked = materialize(flat[0].union(flat[1]).union(crowd).groupBy("node").agg(F.max("crowd").alias("crowd")), "asked")
    sets = materialize(fetch(asked.select("node")).join(asked, "node"), "members")
    edges = materialize(_links(first, sets), "links")
    sets_of_crowd = sets.filter("crowd").select("node", "members")
    regions = _banded(_rekeyed(sets_of_crowd), nodes).withColumn("star", F.lit(False)).withColumn("before", F.lit(2**62))
    return components(join_regions(regions, sets_of_crowd, nodes, edges))


def join_regions(regions: DataFrame, sets: DataFrame, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(a, b): links that connect all nodes which link within a region, besides `edges`.

    `regions`: region, node, star (nodes of a region that are known to be in one component) and before (members of the region
    it was cut from).
    """
    while True:
        sized = regions.join(nodes.select("node", "n"), "node")
        total = sized.groupBy("region").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"), F.max(~F.col("star")).alias("open")).filter("size > 1 and open")
        now = materialize(sized.join(total, "region").select("region", "node", "star", "before", "total", "size"), "cells")
        small = F.col("total") <= CELL
        whole = ~small & (2 * F.col("total") > F.col("before"))
        blocks = F.ceil(2 * F.col("total") / CELL).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        paired = now.filter(whole).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        tasks = now.filter(small).select("region", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "star").union(paired.select("region", F.least("own", "other"), F.greatest("own", "other"), "node", "star"))
        new = _joined(tasks, sets)
        edges = materialize(new if edges is None else edges.union(new), "links")
        large = now.filter(~small & ~whole)
        if not large.limit(1).count():
            return edges
        met = materialize(_met(large, nodes, sets), "met")
        edges = edges.union(met.select(F.col("node").alias("a"), F.explode("links").alias("b")))
        regions = _cells(met)


def _rekeyed(sets: DataFrame) -> DataFrame:
    """New regions for the nodes of large ones: by the shingles that are rarest among these nodes.

    In any order common to all, two linked sets of n members share one of their first n - ceil(0.75 n) + 1. With the rarest
    first, sets that only have frequent members in common part ways.
    """
    top, base = THRESHOLD
    rows = sets.select("node", F.size("members").cast("long").alias("n"), F.explode("members").alias("region"))
    counts = rows.groupBy("region").agg(F.count(F.lit(1)).alias("held"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("held", "region"))
    heads = F.expr(f"n - (n * {top} + {base - 1}) div {base} + 1")
    return rows.join(counts, "region").withColumn("rank", rank).filter((F.col("rank") <= heads) & (F.col("held") > 1)).select("region", "node")


def _banded(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Regions in overlapping bands of set sizes: sets whose sizes differ by more than the threshold allows cannot link.

    Large regions whose most central node is the same are one region then: those of a group of near copies mostly overlap,
    and a pair needs to meet only once.
    """
    band = F.floor(F.log("n") / F.lit(math.log(THRESHOLD[1] / THRESHOLD[0]))).cast("int")
    some = distinct_regions(members).join(nodes.select("node", "n", "weight"), "node").withColumn("band", F.explode(F.array(band, band + 1)))
    some = some.withColumn("region", F.xxhash64("region", "band"))
    leads = some.groupBy("region").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("weight", "node"))["node"].alias("lead")).filter("k > 1")
    joined = some.join(leads, "region").withColumn("region", F.when(F.col("k") > SMALL, F.xxhash64("lead", "band")).otherwise(F.col("region")))
    joined = materialize(joined.select("region", "node").distinct(), "bands")
    return distinct_regions(joined).select("region", "node")


class Sets:
    """Sets of one task: their members end to end and where each one starts, and counts of what they share."""

    def __init__(self, values: np.ndarray, at: np.ndarray):
        self.values, self.at, self.sizes = values, at, np.diff(at)

    @classmethod
    def of(cls, lists: pa.ChunkedArray) -> Sets:
        lists = lists.combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        return cls(lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0])

    def __len__(self) -> int:
        return len(self.sizes)

    def _members(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[rows]
        ends = np.cumsum(n)
        return self.values[np.repeat(self.at[rows] - (ends - n), n) + np.arange(int(n.sum()))], np.repeat(np.arange(len(rows)), n)

    def distances(self, rows: np.ndarray, other: Sets, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of own sets `rows` to another's `columns`, and which of these link. An inverted index over the columns'
        members counts what is shared, HITS at a time."""
        keys, owner = other._members(columns)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        shared = np.zeros(len(rows) * len(columns), np.int64)
        values, row = self._members(rows)
        low, high = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
        found = np.flatnonzero(high > low)
        low, n, row = low[found], (high - low)[found], row[found]
        ends = np.cumsum(n)
        start = 0
        while start < len(n):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + HITS, side="right")))
            k = n[start:stop]
            index = np.repeat(low[start:stop] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            cell = np.repeat(row[start:stop], k) * len(columns) + owner[index]
            if len(shared) <= 4 * len(cell):
                shared += np.bincount(cell, minlength=len(shared))
            else:
                np.add.at(shared, cell, 1)
            start = stop
        shared = shared.reshape(len(rows), len(columns))
        union = self.sizes[rows][:, None] + other.sizes[columns][None, :] - shared
        return 1 - shared / np.maximum(union, 1), THRESHOLD[1] * shared >= THRESHOLD[0] * union


def separated(between: np.ndarray) -> list[int]:
    """The pivots that create cells: each, in order, that lies further than NEAR from all chosen before it."""
    chosen: list[int] = []
    for j in range(len(between)):
        if not chosen or between[j, chosen].min() > NEAR:
            chosen.append(j)
    return chosen


def windows(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, far) of nodes at distances `d` from the pivots of cells: in whose cells each node lies, replicas included, and
    whether it lies in the far cell."""
    least = d.min(1)
    return d <= np.minimum(least + 2 * RADIUS, NEAR + RADIUS)[:, None] + EPS, least > NEAR


class _Groups:
    """Components of a cell's nodes."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


def _parts(d: np.ndarray, linked: np.ndarray, place: Callable) -> list[np.ndarray]:
    """The cells, as places in `d`, and the far cell; without nodes that are done."""
    cells, far = place(d)
    parts = [np.flatnonzero(far)]
    for j in range(d.shape[1]):
        others = cells[:, j] & ~linked[:, j]
        if others.any():
            parts.append(np.flatnonzero(cells[:, j] & (~linked[:, j] | (d[:, j] >= d[others, j].min() - RADIUS - EPS))))
    return parts


def join_cell(sets: Sets, star: np.ndarray, place: Callable = windows) -> list[tuple[int, int]]:
    """Links (a, b) that connect all sets of a cell which link, by recursion into Voronoi cells; those marked `star` are in
    one component already."""
    groups, links = _Groups(len(sets)), []
    known = np.flatnonzero(star)
    for x in known[1:].tolist():
        groups.join(int(known[0]), x)
    todo = [np.arange(len(sets))]
    while todo:
        own = todo.pop()
        roots = np.array([groups.find(x) for x in own.tolist()])
        names, count = np.unique(roots, return_counts=True)
        if len(names) < 2:
            continue
        outer = np.flatnonzero(roots != names[np.argmax(count)])
        direct = len(own) <= 2 * STEP_PIVOTS
        # All nodes outside the largest component, or some of them from all over the cell.
        picked = outer if direct else outer[np.unique(np.linspace(0, len(outer) - 1, min(STEP_PIVOTS, len(outer))).astype(int))]
        d, linked = sets.distances(own, sets, own[picked])
        linked[picked, np.arange(len(picked))] = False
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = int(own[i]), int(own[picked[j]])
            if groups.join(a, b):
                links.append((a, b))
        if direct or len(picked) == len(outer):
            continue
        rest = np.ones(len(own), bool)
        rest[picked] = False
        left, lead = own[rest], separated(d[picked])
        near, near_linked = d[rest][:, lead], linked[rest][:, lead]
        for choice in [list(range(len(lead))), *([j] for j in range(len(lead)) if len(lead) > 1)]:
            parts = _parts(near[:, choice], near_linked[:, choice], place)
            if sum(map(len, parts)) <= GROWTH * len(left) and max(map(len, parts), default=0) <= MOST_SHARE * len(left):
                break
        else:
            parts = [np.arange(len(left))]
        todo += [left[p] for p in parts if len(p) > 1]
    return links


def _joined(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the links of each cell (region, i, j), joined in memory."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")  # results do not depend on the order of rows
        table = table.take(pa.array(order))
        links = join_cell(Sets.of(table.column("members")), table.column("star").to_numpy(zero_copy_only=False))
        nodes = nodes[order]
        return pa.table({"a": pa.array([int(nodes[a]) for a, _ in links], pa.int64()), "b": pa.array([int(nodes[b]) for _, b in links], pa.int64())})

    return tasks.join(sets, "node").groupBy("region", "i", "j").applyInArrow(run, "a long, b long")


def _met(cells: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Every node of a large cell against the cell's pivots: region, total, node, star, pivot (whether it is one), places (the
    cells in which its windows lie: pivot, d, star), far (whether it lies in the far cell) and links (linked pivots).

    Pivots are central nodes that are not marked star. Nodes come in blocks of BLOCK, each with all pivots of its region.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: [] for n in schema.names}, schema=schema)
        right = right.take(pa.array(np.argsort(right.column("at").to_numpy(), kind="stable")))
        own, measured = Sets.of(left.column("members")), Sets.of(right.column("pivot_members"))
        pivots, nodes = right.column("pivot").to_numpy(), left.column("node").to_numpy()
        every = np.arange(len(measured))
        lead = separated(measured.distances(every, measured, every)[0])
        places, fars, links = [], [], []
        for start in range(0, len(own), 128):
            d, linked = own.distances(np.arange(start, min(start + 128, len(own))), measured, every)
            linked &= nodes[start : start + 128, None] != pivots[None, :]
            inside, far = windows(d[:, lead])
            for i in range(len(d)):
                places.append([{"pivot": int(pivots[lead[j]]), "d": float(d[i, lead[j]]), "star": bool(linked[i, lead[j]])} for j in np.flatnonzero(inside[i])])
                links.append([int(x) for x in pivots[linked[i]]])
            fars += far.tolist()
        columns = {k: left.column(k) for k in ("region", "total", "node", "star")}
        return pa.table(columns | {"pivot": np.isin(nodes, pivots), "places": places, "far": fars, "links": links}, schema=schema)

    cell = pa.list_(pa.struct([("pivot", pa.int64()), ("d", pa.float64()), ("star", pa.bool_())]))
    schema = pa.schema([("region", pa.int64()), ("total", pa.int64()), ("node", pa.int64()), ("star", pa.bool_()), ("pivot", pa.bool_()), ("places", cell), ("far", pa.bool_()), ("links", pa.list_(pa.int64()))])
    order = Window.partitionBy("region").orderBy("star", F.desc("weight"), "node")
    ranked = cells.join(nodes.select("node", "weight"), "node").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= PIVOTS)
    chosen = ranked.filter("not star").select("region", F.col("node").alias("pivot"), "at", "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = cells.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).select("region", "block", "total", "node", "star").join(sets, "node")
    spread = chosen.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = sets.select(F.col("node").alias("pivot"), F.col("members").alias("pivot_members"))
    spread = spread.select(F.col("region").alias("of_region"), F.col("block").alias("of_block"), "pivot", "at").join(own, "pivot")
    kinds = "region long, total long, node long, star boolean, pivot boolean, places array<struct<pivot:long,d:double,star:boolean>>, far boolean, links array<long>"
    return rows.groupBy("region", "block").cogroup(spread.groupBy("of_region", "of_block")).applyInArrow(run, kinds)


def _cells(met: DataFrame) -> DataFrame:
    """(region, node, star, before): the cells that go on. Pivots leave: all their links in the region are known."""
    rest = met.filter("not pivot").withColumn("before", F.col("total")).drop("total")
    far = rest.filter("far").select(F.col("region").alias("parent"), F.xxhash64("region", F.lit("far")).alias("region"), "node", "star", "before")
    placed = rest.select(F.col("region").alias("parent"), "node", "before", F.explode("places").alias("c"))
    placed = placed.select("parent", F.xxhash64("parent", "c.pivot").alias("region"), "node", "before", "c.d", "c.star")
    # Within a cell: if the nearest node that is not linked to the pivot lies at w, linked ones nearer than w - RADIUS are done.
    outside = placed.filter(~F.col("star")).groupBy("region").agg(F.min("d").alias("w"))
    kept = placed.join(outside, "region").filter(~F.col("star") | (F.col("d") >= F.col("w") - RADIUS - EPS))
    cells = materialize(far.union(kept.select("parent", "region", "node", "star", "before")), "parts")
    parts = cells.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("k")).groupBy("parent").agg(F.sum("k").alias("k"), F.max("k").alias("most"))
    size = rest.groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    split = size.join(parts, size["region"] == parts["parent"]).filter((F.col("k") <= GROWTH * F.col("rows")) & (F.col("most") <= MOST_SHARE * F.col("rows"))).select("parent")
    whole = rest.join(split.select(F.col("parent").alias("region")), "region", "left_anti").select("region", "node", "star", "before")
    return cells.join(split, "parent").select("region", "node", "star", "before").union(whole)
