"""Ordered scans per key (running max, prefix sum, last / next value) that stay
distributed when one key owns a large share of all rows.

A plain window puts a whole key into one task.  Here every key is first cut into
chunks of consecutive rows:

1. *Split points.*  Rows whose hash of (key, order) is 0 modulo `rows_per_chunk`
   become split points, so chunks hold about that many rows whatever the shape of
   the data, bursts and equal timestamps included, and a recomputed task sees the
   same points.  One point in `_FANOUT` is of the second level, one in its square of
   the third.  A row finds its chunk by three equi-joins, each with the short sorted
   list of one segment (about `_FANOUT` points), so what rides on a row does not
   grow with the key and the number of points has no limit.
2. *Local scan.*  A window over (key, chunk).
3. *Carry.*  One total per (key, chunk), only for keys that have split points, then
   a window over those few totals; the carry of the earlier chunks is joined back.

Points and totals number one per `rows_per_chunk` rows.  They are broadcast while the
size of the tables read bounds them by `BROADCAST_BYTES`, and joined by Spark's own
choice (shuffle, with splitting of skewed keys) beyond that.

Rows are shuffled once, by (key, chunk).  Keys without a split point take part in
step 2 only; if there is none at all, the points' small table is empty and the plan is
that of a plain window, without joins.  Split points can come from another frame (`split_source`): any set of
points cuts the order into valid chunks, so a cheap base table will do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.plans.stage import stage

ROWS_PER_CHUNK = 1 << 18
BROADCAST_BYTES = 64 << 20
CONF_ROWS = "spark.cutline.rowsPerChunk"
CHUNK = "__chunk"
_HOT = "__hot"
_FANOUT = 128
_POINT_BYTES = 64  # of one point or total, generously


@dataclass(frozen=True)
class Op:
    kind: str
    col: Column
    inclusive: bool = False


def running_max(col: Column, inclusive: bool = False) -> Op:
    """Largest value so far; nulls are skipped."""
    return Op("max", col, inclusive)


def running_sum(col: Column, inclusive: bool = False) -> Op:
    """Sum so far, 0 before the first value."""
    return Op("sum", col, inclusive)


def row_index() -> Op:
    """0-based position inside the key."""
    return Op("sum", F.lit(1).cast("bigint"), False)


def last_value(col: Column, inclusive: bool = True) -> Op:
    """Latest non-null value at or before the row."""
    return Op("last", col, inclusive)


def next_value(col: Column) -> Op:
    """Earliest non-null value strictly after the row."""
    return Op("next", col, False)


def previous_row(col: Column) -> Op:
    """Value in the row just before, null included."""
    return Op("lag", F.struct(col.alias("v")), False)


def rows_per_chunk(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(CONF_ROWS, str(ROWS_PER_CHUNK)))


def bounded(side: DataFrame, source: DataFrame) -> DataFrame:
    """`side`, with one row per chunk of `source`, marked for broadcast if its bound is small.

    The bound takes a row of `source` for every byte of the tables it is read from.
    """
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    fits = size * _POINT_BYTES // rows_per_chunk(source) <= BROADCAST_BYTES
    return F.broadcast(side) if fits else side


def split_points(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Split points with the segment they lie in: key, order, level, __c2, __c1."""
    names = [*key, *order]
    rows = rows_per_chunk(df)
    level = "case " + " ".join(
        f"when pmod(__h, {rows * _FANOUT ** k}) = 0 then {k}" for k in (2, 1)) + " else 0 end"
    points = (
        df.selectExpr(*names, f"xxhash64({', '.join(names)}) as __h")
        .where(f"pmod(__h, {rows}) = 0").distinct()
        .selectExpr(*names, f"{level} as __level")
    )
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(*key, "__c2").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    count = lambda n, w: F.sum(F.when(F.col("__level") >= n, 1).otherwise(0)).over(w)
    return points.withColumn("__c2", count(2, so_far)).withColumn("__c1", count(1, inside))


def _count_before(points: str, position: str) -> str:
    """Binary search in SQL: how many of the sorted `points` are at or before `position`."""
    middle = "(__acc.lo + __acc.hi) div 2"
    return f"""case when {points} is null then 0L else aggregate(
        sequence(1, greatest(1, cast(ceil(log2(size({points}) + 1)) as int))),
        struct(0L as lo, cast(size({points}) as bigint) as hi),
        (__acc, __round) -> case when __acc.lo >= __acc.hi then __acc
            when get({points}, cast({middle} as int)) <= {position} then struct({middle} + 1 as lo, __acc.hi as hi)
            else struct(__acc.lo as lo, {middle} as hi) end,
        __acc -> __acc.lo) end"""


def _joined(
    df: DataFrame, key: Sequence[str], order: Sequence[str], split_source: DataFrame | None
) -> tuple[DataFrame, bool]:
    """(rows with their chunk, a number that grows with the order, and whether their key was split; was any)."""
    source = split_source if split_source is not None else df
    points = stage(split_points(source, key, order), "points")
    if points.isEmpty():
        return df.withColumns({_HOT: F.lit(False), CHUNK: F.lit(0).cast("bigint")}), False
    position = f"struct({', '.join(order)})"
    out = df
    for level, cell in ((2, "__c2"), (1, "__c1"), (0, "__c0")):
        at = [*key, *[c for c in ("__c2", "__c1") if c > cell]]
        own = f"array_sort(collect_list(case when __level >= {level} then {position} end)) as __points"
        side = points.where(f"__level >= {level}") if level < 2 else points
        side = side.groupBy(*at).agg(F.expr(own), *([F.lit(True).alias(_HOT)] if level == 2 else []))
        out = (
            out.join(bounded(side, source), at, "left")
            .selectExpr(
                *[c for c in out.columns if c != _HOT],
                _HOT, f"{_count_before('__points', position)} as {cell}")
        )
    return out.selectExpr(
        *df.columns, f"coalesce({_HOT}, false) as {_HOT}",
        f"shiftleft(__c2, 40) + shiftleft(__c1, 20) + __c0 as {CHUNK}"), True


def with_chunks(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    split_source: DataFrame | None = None,
) -> DataFrame:
    """Add the chunk number of each row; keys without split points have one chunk."""
    return _joined(df, key, order, split_source)[0].drop(_HOT)


class Scan:
    """Rows of `df` in (key, order), with running columns added by `run`."""

    def __init__(
        self,
        df: DataFrame,
        key: Sequence[str],
        order: Sequence[str],
        split_source: DataFrame | None = None,
    ):
        self.key, self.order = list(key), list(order)
        rows, self.split = _joined(df, self.key, self.order, split_source)
        self._source = split_source if split_source is not None else df
        self._all = rows.drop(_HOT)
        self._hot = rows.where(_HOT).drop(_HOT)

    def _copy(self, all_rows: DataFrame, hot_rows: DataFrame) -> "Scan":
        out = object.__new__(Scan)
        out.key, out.order, out._all, out._hot = self.key, self.order, all_rows, hot_rows
        out._source, out.split = self._source, self.split
        return out

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> "Scan":
        """Row-wise step (columns added, rows filtered) between two scans."""
        return self._copy(fn(self._all), fn(self._hot))

    @property
    def rows(self) -> DataFrame:
        """All rows with their chunk number."""
        return self._all

    @property
    def hot(self) -> DataFrame:
        """Rows of the keys that were split, with their chunk number."""
        return self._hot

    def bounded(self, side: DataFrame) -> DataFrame:
        """`side`, with one row per chunk, for a join with the rows."""
        return bounded(side, self._source)

    @property
    def df(self) -> DataFrame:
        return self._all.drop(CHUNK)

    def run(self, **ops: Op) -> "Scan":
        carry = self._carry(ops) if self.split else None
        return self._copy(
            self._local(self._all, ops, carry), self._local(self._hot, ops, carry)
        )

    def _carry(self, ops: dict[str, Op]) -> DataFrame:
        position = F.struct(*self.order)
        totals = []
        for name, op in ops.items():
            present = F.when(op.col.isNotNull(), position)
            total = {
                "max": lambda: F.max(op.col),
                "sum": lambda: F.sum(op.col),
                "last": lambda: F.max_by(op.col, present),
                "lag": lambda: F.max_by(op.col, present),
                "next": lambda: F.min_by(op.col, present),
            }[op.kind]()
            totals.append(total.alias(name))
        per_chunk = self._hot.groupBy(*self.key, CHUNK).agg(*totals)
        ahead = Window.partitionBy(*self.key).orderBy(CHUNK).rowsBetween(
            Window.unboundedPreceding, -1
        )
        behind = Window.partitionBy(*self.key).orderBy(F.desc(CHUNK)).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carried = []
        for name, op in ops.items():
            value = {
                "max": lambda: F.max(name).over(ahead),
                "sum": lambda: F.sum(name).over(ahead),
                "last": lambda: F.last(name, ignorenulls=True).over(ahead),
                "lag": lambda: F.last(name, ignorenulls=True).over(ahead),
                "next": lambda: F.last(name, ignorenulls=True).over(behind),
            }[op.kind]()
            carried.append(value.alias(f"__carry_{name}"))
        return per_chunk.select(*self.key, CHUNK, *carried)

    def _local(self, df: DataFrame, ops: dict[str, Op], carry: DataFrame) -> DataFrame:
        group = Window.partitionBy(*self.key, CHUNK)
        forward = group.orderBy(*self.order)
        backward = group.orderBy(*[F.desc(c) for c in self.order])
        local = {}
        for name, op in ops.items():
            frame = (backward if op.kind == "next" else forward).rowsBetween(
                Window.unboundedPreceding, 0 if op.inclusive else -1
            )
            fn = {
                "max": lambda: F.max(op.col),
                "sum": lambda: F.sum(op.col),
            }.get(op.kind, lambda: F.last(op.col, ignorenulls=True))()
            local[name] = fn.over(frame)
        if carry is None:  # every key is one chunk, nothing comes before
            out = df.withColumns(local)
            for name, op in ops.items():
                if op.kind == "sum":
                    out = out.withColumn(name, F.coalesce(name, F.lit(0)))
                elif op.kind == "lag":
                    out = out.withColumn(name, F.col(name).getField("v"))
            return out
        out = df.withColumns(local).join(self.bounded(carry), [*self.key, CHUNK], "left")
        merged = {}
        for name, op in ops.items():
            here, before = F.col(name), F.col(f"__carry_{name}")
            if op.kind == "max":
                merged[name] = F.greatest(here, before)
            elif op.kind == "sum":
                merged[name] = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
            elif op.kind == "lag":
                merged[name] = F.coalesce(here, before).getField("v")
            else:
                merged[name] = F.coalesce(here, before)
        return out.withColumns(merged).drop(*[f"__carry_{n}" for n in ops])
