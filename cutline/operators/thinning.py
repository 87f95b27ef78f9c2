"""Greedy rate reduction: keep a sample once `interval` has passed since the last
kept one.

The rule is sequential per key, yet a key is not held to one task.  A chunk of
consecutive rows acts on the running threshold as a step function ("a threshold up
to this row leaves that one behind").  For keys that were cut into chunks:

1. `_reach_fn` folds chunk summaries (first, last, largest gap) and bounds the
   thresholds with which each chunk can be entered at all: one threshold, hence one
   chain, is real, and its position is known up to the gaps it has jumped over.
2. `_step_fn` computes the step function of every chunk in parallel, for rows
   within those bounds only.  Chains that start at different rows soon meet, which
   keeps the functions short where an interval holds few rows; where it holds many,
   the bounds do.
3. Step functions compose, and composition is associative: in rounds, the functions of
   `FAN` neighbours become one (`_compose_fn`), until `FAN` are left of a key; then, back
   down the same tree, a group's threshold at its start gives that of each member
   (`_entries_fn`).  A composed function has a step for each threshold its first chunk
   can be entered with, so it does not grow with the number of chunks: no task sees more
   than the steps of `FAN` functions, whatever the rate of a key.
4. Every chunk emits its rows on its own.

Step 1 sees one row per chunk.  Bounds that turn out loose cost time, never exactness.
If no key was cut, only step 4 is left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cutline.plans import scan as S
from cutline.plans.stage import stage

_NEVER = -(2**62)
_PASS = -(2**63)
_HOPS, _WINDOWS = 64, 16
FAN = 8


def _ident(batch: pa.RecordBatch, keys: list[str], i: int) -> tuple:
    return tuple(batch.column(k)[i].as_py() for k in keys)


def _fresh(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> np.ndarray:
    """Flags the rows where a new segment starts; `last` ended the batch before."""
    flags = np.zeros(batch.num_rows, dtype=bool)
    for k in keys:
        col = batch.column(k)
        moved = pc.not_equal(col.slice(1), col.slice(0, len(col) - 1))
        flags[1:] |= moved.to_numpy(zero_copy_only=False)
    flags[0] = _ident(batch, keys, 0) != last
    return flags


def _idents(batch: pa.RecordBatch, keys: list[str]) -> list[tuple]:
    return list(zip(*[batch.column(k).to_pylist() for k in keys]))


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint sorted windows; the closest neighbours are joined beyond a few."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(windows):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    while len(out) > _WINDOWS:
        i = min(range(len(out) - 1), key=lambda j: out[j + 1][0] - out[j][1])
        out[i:i + 2] = [(out[i][0], out[i + 1][1])]
    return out


def _picks(live: list, first: int, last: int, gap: int) -> list[tuple[int, int]]:
    """Where a threshold inside `live` can make its next pick up to `last`."""
    out = []
    for lo, hi in live:
        if lo <= last:
            top = min(hi, last)
            out.append((max(lo, first), first if top <= first else min(top + gap, last)))
    return out


def _through(live: list, first: int, last: int, gap: int, jump: int) -> list[tuple[int, int]]:
    """Thresholds possible after a chunk, given those possible before it."""
    done, todo = [], live
    for _ in range(_HOPS):
        done += [(max(lo, last + 1), hi) for lo, hi in todo if hi > last]
        todo = _merged([(a + jump, b + jump) for a, b in _picks(todo, first, last, gap)])
        if not todo:
            return _merged(done)
    return _merged([*done, (last + 1, last + jump)])


def _reach_fn(keys: list[str], jump: int, schema: pa.Schema):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, live, idx = None, [], 0
        for batch in batches:
            ids = _idents(batch, keys)
            stats = zip(*[batch.column(c).to_pylist() for c in ("first", "last", "gap")])
            out = []
            for ident, (first, last, gap) in zip(ids, stats):
                if ident[:-1] != key:
                    key, live, idx = ident[:-1], [(_NEVER, _NEVER)], 0
                spots = _merged(_picks(live, first, last, gap))
                top = max(hi for _, hi in live)
                out.append((*ident, idx, top, [a for a, _ in spots], [b for _, b in spots]))
                idx += 1
                live = _through(live, first, last, gap, jump)
            if out:
                cols = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return fn


def _steps(
    t: np.ndarray, picked: np.ndarray, interval: int, slack: int
) -> tuple[np.ndarray, np.ndarray]:
    """Step function of one sorted chunk at the rows in `picked`: (up to this
    threshold, threshold after).  A chunk nothing is picked from keeps one step
    that no threshold meets, so that it is not lost."""
    if not len(picked):
        return np.array([_PASS]), np.array([_PASS])
    n = len(t)
    after = np.searchsorted(t, t + (interval - slack))
    jump = np.where(after < n, after, np.arange(n))
    while True:
        twice = jump[jump]
        if np.array_equal(twice, jump):
            break
        jump = twice
    left = t[jump[picked]] + interval
    edge = np.append(left[1:] != left[:-1], True)
    return t[picked][edge], left[edge]


def _segments(
    batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]
) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(values of `keys`, arrays of `columns`) of consecutive rows that agree in `keys`."""
    ident, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = _fresh(batch, keys, ident)
        data = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        cuts = sorted({0, *np.flatnonzero(fresh).tolist(), batch.num_rows})
        for a, b in zip(cuts, cuts[1:]):
            if fresh[a] and parts:
                yield ident, [np.concatenate(p) for p in zip(*parts)]
                parts = []
            ident = _ident(batch, keys, a)
            parts.append([d[a:b] for d in data])
    if parts:
        yield ident, [np.concatenate(p) for p in zip(*parts)]


def _batch(ident: tuple, columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    head = [pa.array([v] * len(columns[0]), f.type) for v, f in zip(ident, schema)]
    return pa.RecordBatch.from_arrays([*head, *map(pa.array, columns)], schema=schema)


def _step_fn(keys: list[str], interval: int, slack: int, schema: pa.Schema):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ident, (t, near, node, top) in _segments(batches, keys, ["t_us", "near", "node", "top"]):
            upto, left = _steps(t, np.flatnonzero(near), interval, slack)
            size = len(upto)
            yield _batch(ident, [np.repeat(node[0], size), np.repeat(top[0], size), upto, left], schema)

    return fn


def _apply(upto: np.ndarray, left: np.ndarray, at: np.ndarray, slack: int) -> np.ndarray:
    """Thresholds after a chunk with these steps; one above all steps stays."""
    step = np.searchsorted(upto, at - slack)
    return np.where(step < len(upto), left[np.minimum(step, len(upto) - 1)], at)


def _composed(parts: list[tuple[np.ndarray, np.ndarray]], top: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps of consecutive chunks as one, for thresholds (less slack) up to `top`."""
    upto, left = parts[0]
    for u, v in parts[1:]:
        beyond = u > upto[-1]
        left = np.concatenate([_apply(u, v, left, slack), v[beyond]])
        upto = np.concatenate([upto, u[beyond]])
        edge = np.append(left[1:] != left[:-1], True)
        upto, left = upto[edge], left[edge]
        last = int(np.searchsorted(upto, top)) + 1  # steps further on are met by no threshold
        upto, left = upto[:last], left[:last]
    return upto, left


def _compose_fn(keys: list[str], slack: int, schema: pa.Schema):
    """Rows (*keys, node, top, upto, left) by node to the same columns, a node for each value of `keys`."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ident, (node, top, upto, left) in _segments(batches, keys, ["node", "top", "upto", "left"]):
            cuts = np.flatnonzero(np.diff(node)) + 1
            parts = list(zip(np.split(upto, cuts), np.split(left, cuts)))
            upto, left = _composed(parts, int(top[0]), slack)
            size = len(upto)
            yield _batch(ident[:-1], [np.repeat(ident[-1], size), np.repeat(top[0], size), upto, left], schema)

    return fn


def _entries_fn(keys: list[str], slack: int, schema: pa.Schema):
    """Rows (*keys, entry, node, upto, left) by node: the threshold at the start of every node."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ident, (entry, node, upto, left) in _segments(batches, keys, ["entry", "node", "upto", "left"]):
            cuts = np.flatnonzero(np.diff(node)) + 1
            at, found = entry[:1], []
            for u, v in zip(np.split(upto, cuts), np.split(left, cuts)):
                found.append(at)
                at = _apply(u, v, at, slack)
            yield _batch(ident[:-1], [node[np.concatenate([[0], cuts])], np.concatenate(found)], schema)

    return fn


def _entries(steps: DataFrame, key: list[str], nodes: int, slack: int) -> DataFrame:
    """(*key, node, entry) of every chunk from its steps (*key, node, top, upto, left), at most `nodes` a key."""
    head = [steps.schema[c] for c in key]
    longs = lambda *names: T.StructType([*head, *[T.StructField(n, T.LongType()) for n in names]])
    at, parent = [*key, "parent"], F.floor(F.col("node") / FAN).alias("parent")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(*at).sortWithinPartitions(*at, "node", "upto")

    levels = [steps]
    while nodes > FAN:
        nodes = -(-nodes // FAN)
        form = _arrow_schema(steps, key, node=_LONG, top=_LONG, upto=_LONG, left=_LONG)
        rows = grouped(levels[-1].select(*key, parent, "node", "top", "upto", "left"))
        levels.append(stage(
            rows.mapInArrow(_compose_fn(at, slack, form), longs("node", "top", "upto", "left")), "composed"))
    known = None
    for level in reversed(levels):
        rows = level.select(*key, parent, "node", "upto", "left")
        if known is None:
            rows = rows.withColumn("entry", F.lit(_NEVER).cast("long"))
        else:
            rows = rows.join(known.withColumnRenamed("node", "parent"), at)
        form = _arrow_schema(steps, key, node=_LONG, entry=_LONG)
        known = grouped(rows).mapInArrow(_entries_fn(at, slack, form), longs("node", "entry"))
    return known


def _emit_fn(keys: list[str], interval: int, slack: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, due = None, _NEVER
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _fresh(batch, keys, ident)
            ident = _ident(batch, keys, batch.num_rows - 1)
            t = batch.column("t_us").to_numpy()
            entry = batch.column("__entry")
            cuts = sorted({0, *np.flatnonzero(fresh).tolist(), batch.num_rows})
            keep = []
            for a, b in zip(cuts, cuts[1:]):
                if fresh[a]:
                    due = entry[a].as_py()
                    due = _NEVER if due is None else due
                at = a + int(np.searchsorted(t[a:b], due - slack))
                while at < b:
                    keep.append(at)
                    due = int(t[at]) + interval
                    at += 1
                    if at < b and t[at] + slack < due:
                        at += int(np.searchsorted(t[at:b], due - slack))
            yield batch.take(pa.array(keep, pa.int64()))

    return fn


_LONG = pa.int64()
_LIST = pa.list_(_LONG)


def _arrow_schema(df: DataFrame, names: Sequence[str], **extra: pa.DataType) -> pa.Schema:
    known = [pa.field(n, to_arrow_type(df.schema[n].dataType)) for n in names]
    return pa.schema([*known, *[pa.field(n, kind) for n, kind in extra.items()]])


def _by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*key).sortWithinPartitions(*key, *order)


def thin_min_gap(
    samples: DataFrame, interval_us: int, slack_us: int = 1, key: Sequence[str] = ("asset_id",)
) -> DataFrame:
    """Samples kept by the greedy rule: t + slack >= last kept + interval."""
    if interval_us <= slack_us:
        return samples
    key, order = list(key), ["t_us", "sample_id"]
    parts = [*key, S.CHUNK]
    scan = S.Scan(samples, key, order)
    rows = scan.rows
    entry = F.lit(None).cast("long").alias("__entry")
    if scan.split:
        entry = F.col("__entry")
        rows = rows.join(scan.bounded(_chunk_entries(scan, key, order, interval_us, slack_us)), parts, "left")
    rows = rows.select(*samples.columns, S.CHUNK, entry)
    return (
        rows.repartition(*parts)
        .sortWithinPartitions(*parts, *order)
        .mapInArrow(_emit_fn(parts, interval_us, slack_us), rows.schema)
        .select(*samples.columns)
    )


def _chunk_entries(scan: S.Scan, key: list[str], order: list[str], interval_us: int, slack_us: int) -> DataFrame:
    """(*key, chunk, __entry): the threshold at the start of every chunk of the keys that were cut."""
    parts = [*key, S.CHUNK]
    hot = scan.hot.select(*parts, *order)
    head = [hot.schema[c] for c in parts]
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]

    before = F.lag("t_us").over(Window.partitionBy(*parts).orderBy(*order))
    chunks = hot.withColumn("gap", F.col("t_us") - before).groupBy(*parts).agg(
        F.min("t_us").alias("first"), F.max("t_us").alias("last"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("gap"),
    )
    spots = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("spot_lo", "spot_hi")]
    form = _arrow_schema(hot, parts, node=_LONG, top=_LONG, spot_lo=_LIST, spot_hi=_LIST)
    reach = stage(_by_key(chunks, key, [S.CHUNK]).mapInArrow(
        _reach_fn(parts, interval_us - slack_us, form), T.StructType([*head, *longs("node", "top"), *spots])), "reach")
    near = F.expr("exists(arrays_zip(spot_lo, spot_hi), s -> t_us between s.spot_lo and s.spot_hi)")
    steps = stage(
        hot.join(scan.bounded(reach), parts)
        .select(*parts, *order, near.alias("near"), "node", "top")
        .repartition(*parts)
        .sortWithinPartitions(*parts, *order)
        .mapInArrow(
            _step_fn(parts, interval_us, slack_us, _arrow_schema(hot, parts, node=_LONG, top=_LONG, upto=_LONG, left=_LONG)),
            T.StructType([*head, *longs("node", "top", "upto", "left")]),
        ), "steps")
    nodes = (reach.agg(F.max("node")).first()[0] or 0) + 1
    found = _entries(steps.drop(S.CHUNK), key, nodes, slack_us)
    return reach.select(*parts, "node").join(found, [*key, "node"]).select(*parts, F.col("entry").alias("__entry"))


def thin_to_rate(samples: DataFrame, out_fps: float, src_fps: float) -> DataFrame:
    """Reduce to out_fps, or leave alone when the source is not faster."""
    if not out_fps < src_fps - 0.01:
        return samples
    return thin_min_gap(samples, round(1e6 / out_fps))


def thin_tracks(samples: DataFrame, rates: DataFrame, out_fps: float) -> DataFrame:
    """Reduce every track to out_fps; tracks that are no faster are left alone.

    `rates` holds (asset_id, track, fps), a row per track.
    """
    key = ["asset_id", "track"]
    fast = F.coalesce(F.lit(out_fps) < F.col("fps") - 0.01, F.lit(False))
    rated = samples.join(rates.select(*key, "fps"), key, "left").withColumn("fast", fast).drop("fps")
    thinned = thin_min_gap(rated.where("fast").drop("fast"), round(1e6 / out_fps), key=key)
    return thinned.unionByName(rated.where("not fast").drop("fast"))


def throttle(events: DataFrame, gap_us: int = 33_000, key: Sequence[str] = ("asset_id",)):
    """Emit at most one event per gap: the same rule without slack."""
    return thin_min_gap(events, gap_us, slack_us=0, key=key)
