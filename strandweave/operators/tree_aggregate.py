"""Per-key totals and positions when a few keys hold most rows.

Method: rows are cut into chunks of a fixed number of rows as a task reads them, so a task
never holds more than ``chunk`` rows of anything, whatever keys and orders look like. Each
chunk is reduced to one state per key. States climb a tree: in every round, ``fan_in``
neighbouring nodes are merged, so no reducer receives more than ``fan_in`` states of a key.
For positions in a sequence rows are first sorted over all tasks by range, so that chunks
follow each other, and the sums are sent down the same tree again (exclusive prefix sums),
which gives every chunk the number of earlier rows of each of its keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CHUNK = 1 << 16
FAN_IN = 16
_NONE_FIRST, _NONE_LAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of exactly ``size`` rows (the last may be smaller)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - rows)
            held.append(part)
            rows += part.num_rows
            b = b.slice(part.num_rows)
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _states(rows: pa.Table, keys: list[str], order: str, part: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """(part, chunk, kind, key, n, first, last) of the rows of one chunk: one state for every key in it."""
    at = rows[order].combine_chunks()
    known = at.is_valid().to_numpy(zero_copy_only=False)
    at = at.fill_null(0).to_numpy()
    for kind, name in enumerate(keys):
        col = rows[name].combine_chunks()
        ok = col.is_valid().to_numpy(zero_copy_only=False)
        if not ok.any():
            continue
        values, cell = np.unique(col.fill_null(0).to_numpy()[ok], return_inverse=True)
        first, last = np.full(len(values), _NONE_FIRST, np.int64), np.full(len(values), _NONE_LAST, np.int64)
        has = known[ok]
        np.minimum.at(first, cell[has], at[ok][has])
        np.maximum.at(last, cell[has], at[ok][has])
        none = last == _NONE_LAST
        same = lambda x, t: pa.array(np.full(len(values), x), t)
        yield pa.RecordBatch.from_arrays(
            [same(part, pa.int64()), same(chunk, pa.int64()), same(kind, pa.int32()), pa.array(values), pa.array(np.bincount(cell, minlength=len(values))), pa.array(first, mask=none), pa.array(last, mask=none)],
            ["part", "chunk", "kind", "key", "n", "first", "last"],
        )


def _leaves(keys: list[str], order: str, size: int):
    """Local combine of the chunks of a task, in the order in which it reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, t in enumerate(_chunks(batches, size)):
            yield from _states(t, keys, order, part, i)

    return run


def _numbered(order: str, keys: list[str], size: int):
    """Rows with the number of their task and of their chunk in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, t in enumerate(_chunks(batches, size)):
            place = [pa.array(np.full(t.num_rows, x, np.int64)) for x in (part, i)]
            at = pa.array(np.arange(t.num_rows, dtype=np.int64))
            yield from pa.table([*place, at, *(t[c] for c in (order, *keys))], names=["part", "chunk", "_at", order, *keys]).to_batches()

    return run


_LEAF = "part bigint, chunk bigint, kind int, key bigint, n bigint, first bigint, last bigint"


def _node(states: DataFrame, most: int) -> Column:
    """Chunks numbered in order: ``most`` is the highest number of a chunk in its task."""
    return F.col("part") * (most + 1) + F.col("chunk")


def _merge(states: DataFrame, by: Column) -> DataFrame:
    return states.groupBy(by.alias("node"), "kind", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def _climb(leaves: DataFrame, fan_in: int) -> tuple[list[DataFrame], int]:
    """The states of every level of the tree, leaves first, the last with one node; and the highest number of a chunk."""
    most, parts = leaves.agg(F.max("chunk"), F.max("part")).first()
    tree = [leaves.select(_node(leaves, most or 0).alias("node"), "kind", "key", "n", "first", "last")]
    span = ((parts or 0) + 1) * ((most or 0) + 1)
    while span > 1:
        tree.append(_merge(tree[-1], F.floor(F.col("node") / fan_in).cast("bigint")))
        span = -(-span // fan_in)
    return tree, most or 0


def _source(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.select(F.col(order).cast("bigint").alias(order), *[F.col(k).cast("bigint").alias(k) for k in keys])


def key_totals(rows: DataFrame, keys: list[str], *, order: str = "ingest_seq", chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """One row per (kind, key): ``kind`` (column name), ``key``, ``n``, ``first`` and ``last`` arrival number.

    Every row counts, also one with a null order (which has no arrival number) and one
    delivered twice. Rows with a null key are in no group of that kind; an empty table gives
    no row. Rows are never shuffled, only the states of chunks.
    """
    leaves = cut(_source(rows, keys, order).mapInArrow(_leaves(keys, order, chunk), _LEAF))
    root = _climb(leaves, fan_in)[0][-1]
    names = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("kind") + 1)
    return root.select(names.alias("kind"), "key", "n", F.col("first").alias("first_seq"), F.col("last").alias("last_seq"))


def _positions(keys: list[str], order: str):
    def run(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(left))
        if not rows.num_rows:
            return
        rows = rows.sort_by("_at").combine_chunks()
        before = pa.Table.from_batches(list(right)).combine_chunks()
        kinds = before["kind"].to_numpy()
        cols, names = [rows[order]], [order]
        for kind, name in enumerate(keys):
            mine = kinds == kind
            known = before["key"].to_numpy()[mine]
            sort = np.argsort(known)
            known, start, total = known[sort], before["start"].to_numpy()[mine][sort], before["total"].to_numpy()[mine][sort]
            col = rows[name].combine_chunks()
            null = col.is_null().to_numpy(zero_copy_only=False)
            key = col.fill_null(0).to_numpy()
            pos, tot = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            if (~null).any():
                k = key[~null]
                by_key = np.argsort(k, kind="stable")
                sorted_k = k[by_key]
                edge = np.r_[True, sorted_k[1:] != sorted_k[:-1]]
                begin = np.maximum.accumulate(np.where(edge, np.arange(len(k)), 0))
                local = np.empty(len(k), np.int64)
                local[by_key] = np.arange(len(k)) - begin
                at = np.searchsorted(known, k)
                pos[~null] = start[at] + local
                tot[~null] = total[at]
            cols += [rows[name], pa.array(pos, mask=null), pa.array(tot, mask=null)]
            names += [name, f"{name}_pos", f"{name}_n"]
        yield from pa.table(cols, names=names).to_batches()

    return run


def key_positions(rows: DataFrame, keys: list[str], *, order: str = "ingest_seq", chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """Every row's place in the sequence of each of its keys, in order of ``order``, from 0.

    Columns: ``order``, and for each key its value, ``{key}_pos`` and ``{key}_n`` (rows of the
    key in all). A null key has null position and count. Rows with a null order come first;
    equal orders follow each other by the keys, then in order of input. No task holds more
    than one chunk of ``chunk`` rows, however often an order is repeated.
    """
    src = _source(rows, keys, order).withColumn("_tie", F.monotonically_increasing_id())
    total = [F.col(order).asc_nulls_first(), *[F.col(k).asc_nulls_first() for k in keys], F.col("_tie")]
    placed = src.repartitionByRange(*total).sortWithinPartitions(*total).drop("_tie")
    # rows and chunks are read twice and must not be cut anew
    placed = cut(placed.mapInArrow(_numbered(order, keys, chunk), f"part bigint, chunk bigint, _at bigint, {order} bigint, {', '.join(f'`{k}` bigint' for k in keys)}"))
    leaves = cut(placed.mapInArrow(_chunk_states(keys, order), _LEAF))
    tree, most = _climb(leaves, fan_in)
    down = tree[-1].select("node", "kind", "key", F.lit(0).cast("bigint").alias("start"), F.col("n").alias("total"))
    for states in reversed(tree[:-1]):
        parent = F.floor(F.col("node") / fan_in).cast("bigint")
        earlier = Window.partitionBy("parent", "kind", "key").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        children = states.withColumn("parent", parent).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        up = down.select(F.col("node").alias("parent"), "kind", "key", F.col("start").alias("p_start"), "total")
        down = children.join(up, ["parent", "kind", "key"]).select("node", "kind", "key", (F.col("p_start") + F.col("before")).alias("start"), "total")
    src = placed.select(_node(placed, most).alias("node"), "_at", order, *keys)
    schema = f"{order} bigint, " + ", ".join(f"`{k}` bigint, `{k}_pos` bigint, `{k}_n` bigint" for k in keys)
    return src.groupBy("node").cogroup(down.groupBy("node")).applyInArrow(_cogroup(keys, order), schema)


def _chunk_states(keys: list[str], order: str):
    """The states of chunks that are numbered already; a chunk is whole in its task, and its rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        mine = None
        for b in batches:
            place = b.column("part").to_numpy() * (1 << 31) + b.column("chunk").to_numpy()
            edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                here = (b.column("part")[lo].as_py(), b.column("chunk")[lo].as_py())
                if mine is not None and here != mine:
                    yield from _states(pa.Table.from_batches(held), keys, order, *mine)
                    held = []
                mine = here
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from _states(pa.Table.from_batches(held), keys, order, *mine)

    return run


def _cogroup(keys: list[str], order: str):
    inner = _positions(keys, order)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = list(inner(iter(left.to_batches()), iter(right.to_batches())))
        if got:
            return pa.Table.from_batches(got)
        names = [order] + [c for k in keys for c in (k, f"{k}_pos", f"{k}_n")]
        return pa.table({n: pa.array([], pa.int64()) for n in names})

    return run
