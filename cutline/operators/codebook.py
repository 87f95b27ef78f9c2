"""Palettes, moment statistics and codebooks learnt by principal-axis splits."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutline.plans.stage import stage

MAX_CODES = 256  # of a palette
HELD_CODES = 4096  # of a codebook sent to every task
GROUPS = 512  # held by a task before it passes them on
CELL_CODES = 16  # of the sample, in a cell
CELL_POINTS = 1 << 18  # of a cell, in a task


def palette_stats(pixels: DataFrame, by: Sequence[str] = ("anim_id",)) -> DataFrame:
    """Exact colour count; slot 0 is reserved for transparent black.

    Up to 256 slots fit a palette of depth 1, 2, 4 or 8 bits.
    """
    packed = F.expr("(a * 16777216L) + (b * 65536L) + (g * 256L) + r")
    slots = F.count_distinct(F.when(packed != 0, packed)) + 1
    out = pixels.groupBy(*by).agg(slots.alias("slots"))
    depth = (
        F.when(F.col("slots") <= 2, 1).when(F.col("slots") <= 4, 2)
        .when(F.col("slots") <= 16, 4).otherwise(8)
    )
    return out.withColumns({"depth": depth, "indexed": F.col("slots") <= MAX_CODES})


def palette_capped(pixels: DataFrame, by: Sequence[str] = ("anim_id",), cap: int = 300) -> DataFrame:
    """Colour count up to `cap`, where counting stops; slot 0 is reserved for transparent black.

    Each task keeps at most `cap` - 1 colours of a group, and such sets are merged into another: no
    row per distinct colour is shuffled.  Counts below the cap are exact, `saturated` tells others.
    """
    by = list(by)
    packed = F.expr("(a * 16777216L) + (b * 65536L) + (g * 256L) + r").cast("long").alias("c")
    rows = pixels.select(*by, packed)
    head = T.StructType([rows.schema[c] for c in by])
    held = T.StructType([*head, T.StructField("colours", T.ArrayType(T.LongType()))])
    schema = T.StructType([*head, T.StructField("slots", T.LongType()), T.StructField("saturated", T.BooleanType())])
    held_arrow, arrow = to_arrow_schema(held), to_arrow_schema(schema)

    def partial(batches):
        known: dict[tuple, np.ndarray] = {}

        def sets():
            cols = [pa.array([g[k] for g in known], held_arrow.field(c).type) for k, c in enumerate(by)]
            lists = pa.array(list(known.values()), held_arrow.field("colours").type)
            known.clear()
            return pa.RecordBatch.from_arrays([*cols, lists], schema=held_arrow)

        for batch in batches:
            for group, part in _parts(pa.Table.from_batches([batch]), by):
                seen = known.get(group, np.empty(0, np.int64))
                if len(seen) < cap - 1:
                    new = part.column("c").drop_null().to_numpy()
                    seen = np.union1d(seen, new[new != 0])[:cap - 1]
                known[group] = seen
                if len(known) >= GROUPS:
                    yield sets()
        if known:
            yield sets()

    def merged(key, table):
        seen = np.empty(0, np.int64)
        for part in table.column("colours"):
            if len(seen) < cap - 1:
                seen = np.union1d(seen, part.values.to_numpy(zero_copy_only=False))[:cap - 1]
        slots = len(seen) + 1
        return pa.table([*(pa.array([k.as_py()], f.type) for k, f in zip(key, arrow)),
                         pa.array([slots]), pa.array([slots >= cap])], schema=arrow)

    return rows.mapInArrow(partial, held).groupBy(*by).applyInArrow(merged, schema)


def _moments(dims: Sequence[str]) -> list[Column]:
    """count, sums and upper-triangle product sums; integers stay exact."""
    sums = [F.sum(F.col(c)).alias(f"m{i}") for i, c in enumerate(dims)]
    prods = [
        F.sum(F.col(dims[i]) * F.col(dims[j])).alias(f"r{i}_{j}")
        for i in range(len(dims)) for j in range(i, len(dims))
    ]
    return [F.count("*").alias("n"), *sums, *prods]


def moment_stats(points: DataFrame, dims: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group and pair i <= j: n, sum of products and n * covariance.

    d(d+1)/2 sums outgrow one generated aggregate, so each task adds matrix products of its
    groups up (at most `GROUPS` of them are held) and emits one array per group; the
    arrays of a group, one or few per task, are added element by element.
    """
    dims, by = list(dims), list(by)
    head = T.StructType([points.schema[c] for c in by])
    held = T.StructType([*head, T.StructField("sums", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([
        *head, *(T.StructField(n, T.IntegerType()) for n in "ij"), T.StructField("n", T.LongType()),
        *(T.StructField(n, T.DoubleType()) for n in ("s", "cov_n"))])
    first, second = np.triu_indices(len(dims))
    d = len(dims)

    def partial(batches):
        known: dict[tuple, np.ndarray] = {}

        def rows():
            cols = [pa.array([g[k] for g in known], f.type) for k, f in enumerate(held_arrow) if k < len(by)]
            sums = pa.array([v.tolist() for v in known.values()], held_arrow.field("sums").type)
            known.clear()
            return pa.RecordBatch.from_arrays([*cols, sums], schema=held_arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for group, part in _parts(table, by):
                x = np.stack([part.column(c).to_numpy().astype(np.float64) for c in dims], axis=1)
                sums = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[first, second]])
                known[group] = known[group] + sums if group in known else sums
                if len(known) >= GROUPS:
                    yield rows()
        if known:
            yield rows()

    def merged(key, batches):
        total = 0
        for batch in batches:
            flat = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, -1)
            total = total + flat.sum(axis=0)
        n, m, s = total[0], total[1:d + 1], total[d + 1:]
        head = [pa.array([k.as_py()] * len(s), f.type) for k, f in zip(key, arrow)]
        yield pa.RecordBatch.from_arrays(
            [*head, pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)),
             pa.array(np.full(len(s), int(n))), pa.array(s), pa.array(s - m[first] * m[second] / n)], schema=arrow)

    held_arrow, arrow = to_arrow_schema(held), to_arrow_schema(schema)
    sums = points.select(*by, *dims).mapInArrow(partial, held)
    return sums.groupBy(*by).applyInArrow(lambda key, table: pa.Table.from_batches(merged(key, table.to_batches())), schema)


def _parts(table: pa.Table, by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each group of a batch."""
    code = table.select(by).append_column("at", pa.array(np.arange(table.num_rows)))
    groups = code.group_by(by, use_threads=False).aggregate([("at", "list")])
    for k in range(groups.num_rows):
        yield (tuple(groups.column(c)[k].as_py() for c in by),
               table.take(groups.column("at_list")[k].values))


class PlaneTree:
    """A binary tree of planes over codes, searched for the nearest code by branch and bound.

    A code lies on its own side of every plane above it, so what is beyond a plane is at least
    as far as the plane: a branch is left out once that exceeds the best distance so far.
    Every batch walks the tree twice, all its points together: down to the leaf they fall in,
    which gives a first distance, and once more through all branches not ruled out.
    """

    def __init__(self, centres: np.ndarray, codes: np.ndarray):
        self.centres, self.codes = centres, codes
        self.axis: list[np.ndarray | None] = []
        self.cut: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.rows: list[np.ndarray | None] = []

    def add(self, axis=None, cut=0.0, rows=None) -> int:
        self.axis.append(axis)
        self.cut.append(cut)
        self.kids.append((-1, -1))
        self.rows.append(rows)
        return len(self.axis) - 1

    @classmethod
    def over(cls, centres: np.ndarray, codes: np.ndarray, leaf: int = 8) -> "PlaneTree":
        """Halved along the principal axis until at most `leaf` codes are left, or equal ones."""
        tree = cls(centres, codes)

        def grow(rows: np.ndarray) -> int:
            part = centres[rows]
            if len(rows) > leaf and (part != part[0]).any():
                spread = np.cov(part, rowvar=False).reshape(part.shape[1], -1)
                axis = np.linalg.eigh(spread)[1][:, -1]
                at = part @ axis
                low = at <= np.median(at)
                if low.all():
                    low = at < at.max()
                if low.any():
                    me = tree.add(axis, float((at[low].max() + at[~low].min()) / 2))
                    tree.kids[me] = (grow(rows[low]), grow(rows[~low]))
                    return me
            return tree.add(rows=rows)

        grow(np.arange(len(centres)))
        return tree

    def leaves_within(self, x: np.ndarray, best: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points) of each leaf not farther than `best` (read anew at every step); own leaves if it is None."""
        stack = [(0, np.arange(len(x)), np.zeros(len(x)))] if len(x) else []
        while stack:
            node, who, bound = stack.pop()
            if best is not None:
                near = bound * (1 - 1e-9) - 1e-12 <= best[who]
                who, bound = who[near], bound[near]
            if not len(who):
                continue
            if self.axis[node] is None:
                yield node, who
                continue
            gap = x[who] @ self.axis[node] - self.cut[node]
            for kid, mine in zip(self.kids[node], (gap <= 0, gap > 0)):
                if best is None:
                    stack.append((kid, who[mine], bound[mine]))
                else:
                    stack.append((kid, who, np.where(mine, bound, np.maximum(bound, gap * gap))))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distance, code) of the nearest code; of equal ones the lower code."""
        best = np.full(len(x), np.inf)
        pick = np.full(len(x), len(self.codes))

        def visit(leaf: int, who: np.ndarray) -> None:
            rows = self.rows[leaf]  # in the order of the codes
            for k in range(0, len(who), 4096):
                part = who[k:k + 4096]
                d = np.zeros((len(part), len(rows)))
                for c in range(x.shape[1]):
                    d += (x[part, c][:, None] - self.centres[rows, c]) ** 2
                at = d.argmin(axis=1)
                d, at = d[np.arange(len(part)), at], rows[at]
                better = (d < best[part]) | ((d == best[part]) & (at < pick[part]))
                best[part[better]], pick[part[better]] = d[better], at[better]

        for leaf, who in self.leaves_within(x, None):
            visit(leaf, who)
        for leaf, who in self.leaves_within(x, best):
            visit(leaf, who)
        return best, self.codes[np.where(pick < len(self.codes), pick, 0)]  # no distance: any code


def _search(points: DataFrame, dims: Sequence[str], scale: float, tree: PlaneTree, kind: T.DataType) -> DataFrame:
    """Adds `code` by the tree, on Arrow batches."""
    names = [f"c{k}" for k in range(len(points.columns))]  # names may clash
    at = [points.columns.index(c) for c in dims]
    schema = T.StructType([*points.toDF(*names).schema, T.StructField("code", kind)])
    arrow = to_arrow_schema(schema)
    held = points.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            x = np.stack([np.asarray(batch.column(k), np.float64) * scale for k in at], axis=1)
            found = held.value.nearest(x)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow.field("code").type)], schema=arrow)

    return points.toDF(*names).mapInArrow(run, schema).toDF(*points.columns, "code")


@dataclass
class _Node:
    n: int
    m: np.ndarray
    r: np.ndarray
    mean: np.ndarray
    axis: np.ndarray
    weight: float
    cut: float
    children: tuple["_Node", "_Node"] | None = None
    split: bool = field(default=False)


def _node(n: int, m: np.ndarray, r: np.ndarray) -> _Node:
    """Mean, principal axis by power iteration, and the cut through the mean."""
    inv = 1 / n if n else 0.0
    spread = r - np.outer(m, m) * inv
    axis, weight = np.full(len(m), 0.5), 0.0
    for _ in range(10 if n else 0):
        axis = spread @ axis
        norm = float(np.sqrt(axis @ axis))
        if norm == 0:
            break
        axis = axis / norm
        if abs(norm - weight) < 1e-9:
            break
        weight = norm
    mean = m * inv
    return _Node(n, m, r, mean, axis, weight, float(axis @ mean))


class Codebook:
    """A binary tree of planes over `dims`; its leaves are the codes."""

    def __init__(self, root: _Node, dims: Sequence[str], scale: float):
        self.root, self.dims, self.scale = root, list(dims), scale
        # Stable sort by size, larger first, over leaves in the order of creation.
        self.codes = sorted(self._leaves(), key=lambda nd: -nd.n)

    def _leaves(self) -> list[_Node]:
        out, todo = [], [self.root]
        while todo:
            nd = todo.pop(0)
            if nd.split:
                todo = [*nd.children, *todo]
            else:
                out.append(nd)
        return out

    def _side(self, nd: _Node) -> str:
        dot = " + ".join(
            f"({float(e)!r}D * {c} * {self.scale!r}D)" for e, c in zip(nd.axis, self.dims)
        )
        return f"{dot} <= {nd.cut!r}D"

    def descend(self, leaf_value, split=lambda nd: nd.split) -> str:
        """SQL that walks the planes down to `leaf_value(leaf)`."""

        def walk(nd: _Node) -> str:
            if not split(nd):
                return leaf_value(nd)
            left, right = nd.children
            return f"CASE WHEN {self._side(nd)} THEN {walk(left)} ELSE {walk(right)} END"

        return walk(self.root)

    def assign(self, points: DataFrame) -> DataFrame:
        """Adds `code` by walking the planes."""
        number = {id(nd): i for i, nd in enumerate(self.codes)}
        return points.withColumn("code", F.expr(self.descend(lambda nd: str(number[id(nd)]))))

    def nearest(self, points: DataFrame) -> DataFrame:
        """Adds `code`, the code whose mean is nearest, which may lie beyond a plane; ties take the lower code."""
        number = {id(nd): i for i, nd in enumerate(self.codes)}
        means = np.array([nd.mean for nd in self.codes], np.float64)
        tree = PlaneTree(means, np.arange(len(self.codes)))
        empty = np.array([number[id(nd)] for nd in self.codes if not nd.n], np.int64)

        def grow(nd: _Node) -> int:
            if not nd.split:
                return tree.add(rows=np.array([number[id(nd)]]))
            me = tree.add(np.asarray(nd.axis), nd.cut)
            tree.kids[me] = tuple(grow(c) for c in nd.children)
            return me

        grow(self.root)
        if len(empty):  # the mean of no points lies on no side: such codes are tried with every leaf
            tree.rows = [None if r is None else np.union1d(r, empty) for r in tree.rows]
        return _search(points, self.dims, self.scale, tree, T.IntegerType())

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, nd.n, [float(v) for v in nd.mean], [float(v) for v in nd.axis], nd.weight)
            for i, nd in enumerate(self.codes)
        ]
        return spark.createDataFrame(
            rows, "code int, n long, mean array<double>, axis array<double>, lambda double"
        )

    def colors(self, spark: SparkSession) -> DataFrame:
        """Codes as r, g, b, a bytes; colours divided by alpha (premultiplied input)."""
        def byte(v: float) -> int:
            return min(255, int(255 * v + 0.5))

        rows = []
        for i, nd in enumerate(self.codes):
            alpha = float(nd.mean[3])
            inv = 0.0 if alpha < 0.001 else 1 / alpha
            rows.append((i, nd.n, *[byte(float(v) * inv) for v in nd.mean[:3]], byte(alpha)))
        return spark.createDataFrame(rows, "code int, n long, r int, g int, b int, a int")


def pca_split_codebook(
    points: DataFrame, dims: Sequence[str], k: int, scale: float = 1.0
) -> Codebook:
    """Split the leaf with the largest principal eigenvalue until k leaves exist.

    A split needs the moments of its left half.  One job computes them for all
    leaves that lack them, so the number of passes follows the depth of the tree,
    not k.  The driver sees at most k rows of 1 + d + d(d+1)/2 numbers per pass.
    """
    if not 1 <= k <= MAX_CODES:
        raise ValueError(f"k must be between 1 and {MAX_CODES}")
    d = len(dims)

    def read(row) -> tuple[int, np.ndarray, np.ndarray]:
        m = np.array([float(row[f"m{i}"] or 0) * scale for i in range(d)])
        r = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                r[i, j] = r[j, i] = float(row[f"r{i}_{j}"] or 0) * scale * scale
        return int(row["n"]), m, r

    root = _node(*read(points.agg(*_moments(dims)).first()))
    book = Codebook(root, dims, scale)
    leaves = [root]

    def fill() -> None:
        """Moments of the left halves of every leaf that has none yet."""
        number = {id(nd): i for i, nd in enumerate(leaves)}
        wanted = [nd for nd in leaves if nd.children is None and nd.weight >= 1e-3]
        keep = {id(nd) for nd in wanted}

        def half(nd: _Node) -> str:
            if id(nd) not in keep:
                return "NULL"
            return f"CASE WHEN {book._side(nd)} THEN {number[id(nd)]} END"

        halves = points.withColumn("__leaf", F.expr(book.descend(half)))
        rows = halves.where("__leaf is not null").groupBy("__leaf").agg(*_moments(dims)).collect()
        found = {row["__leaf"]: read(row) for row in rows}
        for nd in wanted:
            n, m, r = found.get(number[id(nd)], (0, np.zeros(d), np.zeros((d, d))))
            nd.children = (_node(n, m, r), _node(nd.n - n, nd.m - m, nd.r - r))

    heap = [(-root.weight, 0)]
    while heap and len(leaves) < k:
        weight, at = heapq.heappop(heap)
        nd = leaves[at]
        if -weight < 1e-3:
            break
        if nd.children is None:
            fill()
        left, right = nd.children
        nd.split = True
        leaves[at] = left
        leaves.append(right)
        heapq.heappush(heap, (-left.weight, at))
        heapq.heappush(heap, (-right.weight, len(leaves) - 1))
    out = Codebook(root, dims, scale)
    out.codes = sorted(leaves, key=lambda nd: -nd.n)
    return out


def assign_nearest(points: DataFrame, codes: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Adds `code`, the exact nearest of codes(code, dims...); ties take the lower code.

    Up to `HELD_CODES` codes are sent to every task as a plane tree.  More are cut into cells
    by the tree of a bounded sample, and stay distributed: a point is sent to its own cell,
    and then to the cells whose planes are not farther than what it found there.
    """
    dims = list(dims)
    listed = codes.select("code", *dims)
    held = _codes(listed.limit(HELD_CODES + 1), dims)
    if not len(held[0]):
        raise ValueError("a codebook holds at least one code")
    kind = codes.schema["code"].dataType
    if len(held[0]) <= HELD_CODES:
        return _search(points, dims, 1.0, PlaneTree.over(*held), kind)
    # of codes at one place only the lowest can be an answer
    place = [F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(dims)]
    listed = stage(listed.select("code", *place).groupBy(*[f"x{k}" for k in range(len(dims))]).agg(
        F.min("code").alias("code")), "codes")
    step = max(1, listed.count() // HELD_CODES)
    sample = listed.where(F.pmod(F.xxhash64("code"), F.lit(step)) == 0).orderBy(F.xxhash64("code")).limit(HELD_CODES)
    dims_at = [f"x{k}" for k in range(len(dims))]
    return _nearest_in_cells(points, listed, dims, dims_at, PlaneTree.over(*_codes(sample, dims_at), leaf=CELL_CODES))


def _codes(rows: DataFrame, dims: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, codes) by code."""
    held = rows.toArrow()
    code = held.column("code").to_numpy()
    order = np.argsort(code, kind="stable")
    return np.stack([held.column(c).to_numpy().astype(np.float64) for c in dims], axis=1)[order], code[order]


def _nearest_in_cells(points: DataFrame, codes: DataFrame, dims: list[str], dims_at: list[str], cells: PlaneTree) -> DataFrame:
    """As `assign_nearest`; `cells` only cuts, it was made from some of the codes.

    In a cell points meet its codes as a tree of their own.  A cell with many points is dealt to
    several tasks, which all get its codes.
    """
    names = [f"c{k}" for k in range(len(points.columns))]
    at = [points.columns.index(c) for c in dims]
    position = lambda cols: F.array(*(F.col(c).cast("double") for c in cols)).alias("x")
    plain = stage(points.toDF(*names).withColumn("id", F.monotonically_increasing_id()), "points")
    x = plain.select("id", position(names[k] for k in at))
    tree = points.sparkSession.sparkContext.broadcast(cells)
    kind = codes.schema["code"].dataType
    found = T.StructType([T.StructField("id", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("code", kind)])
    arrow = to_arrow_schema(found)

    def own(rows: DataFrame) -> DataFrame:
        """Rows (.., x) with the cell they lie in."""
        def run(batches):
            for batch in batches:
                v, cell = _matrix(batch, "x"), np.zeros(batch.num_rows, np.int64)
                for leaf, who in tree.value.leaves_within(v, None):
                    cell[who] = leaf
                yield batch.append_column("cell", pa.array(cell))

        return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("cell", T.LongType())]))

    def others(rows: DataFrame) -> DataFrame:
        """Rows (id, x, own, d) once for each other cell within the squared distance d."""
        def run(batches):
            for batch in batches:
                home, d = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "d"))
                for leaf, who in tree.value.leaves_within(_matrix(batch, "x"), d):
                    part = batch.take(pa.array(who[home[who] != leaf])).select(["id", "x"])
                    yield part.append_column("cell", pa.array(np.full(part.num_rows, leaf)))

        return rows.select("id", "x", "own", "d").mapInArrow(run, "id long, x array<double>, cell long")

    def meet(key, left, right):
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        mine, theirs = (t.combine_chunks().to_batches()[0] for t in (left, right))
        code = theirs.column("code").to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        local = PlaneTree.over(_matrix(theirs, "x")[order], code[order])
        d, pick = local.nearest(_matrix(mine, "x"))
        return pa.table([mine.column("id"), pa.array(d), pa.array(pick, arrow.field("code").type)], schema=arrow)

    book = stage(own(codes.select("code", position(dims_at))), "cells")

    def best_of(rows: DataFrame) -> DataFrame:
        rows = stage(rows, "met")
        deal = F.broadcast(rows.groupBy("cell").agg((F.count("*") / CELL_POINTS + 1).cast("int").alias("tasks")))  # a row per cell
        dealt = rows.join(deal, "cell").select("id", "x", "cell", F.pmod("id", F.col("tasks")).cast("int").alias("task"))
        given = book.join(deal, "cell").select("code", "x", "cell", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
        return dealt.groupBy("cell", "task").cogroup(given.groupBy("cell", "task")).applyInArrow(meet, found)

    home = stage(own(x), "home")
    first = stage(best_of(home.select("id", "x", "cell")), "first")
    known = home.withColumnRenamed("cell", "own").join(first.select("id", "d"), "id", "left").withColumn(
        "d", F.coalesce("d", F.lit(float("inf"))))
    best = F.min(F.struct("d", "code")).alias("best")
    both = first.unionByName(best_of(others(known))).groupBy("id").agg(best)
    return plain.join(both, "id").select(*names, "best.code").toDF(*points.columns, "code")


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))
