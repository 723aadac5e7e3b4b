"""One dense feature row per entity from an event table.

Method: every input partition encodes (entity, type) pairs as dense indices and reduces its
rows with ``numpy.bincount`` (counts) and ``numpy.maximum.at`` (latest moment), so a hot
entity leaves a chunk of input as at most one partial per type. Partials go to the hash
bucket of their entity in one exchange; each bucket adds them up as they come, scatters its
entities into dense blocks of fixed width and emits Arrow columns. A bucket holds one block
and reduces what it holds of a hot entity again and again, so its memory stays bounded.

The vocabulary of types is a table of its own; it is collected only up to ``max_types``
(default 20,000) and a larger one raises, because a dense row would then be the wrong form
(use ``entity_type_counts``, the long form, which has no bound).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

NULL_TYPE = "\x00null"  # key of a null type; a type of that text cannot be delivered by JSON or Parquet feeds
BLOCK = 512  # entities in a dense block
HELD = 400_000  # partials a bucket holds before it reduces them
_NEVER, _ALWAYS = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _reduced(cells: np.ndarray, n: np.ndarray, last: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal cells as one: sums of ``n``, latest ``last``, earliest ``first``."""
    got, at = np.unique(cells, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(got)).astype(np.int64)
    late, early = np.full(len(got), _NEVER, np.int64), np.full(len(got), _ALWAYS, np.int64)
    np.maximum.at(late, at, last)
    np.minimum.at(early, at, first)
    return got, total, late, early


def _codes(col: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    enc = col.combine_chunks()
    enc = enc.dictionary_encode() if isinstance(enc, pa.Array) else enc.combine_chunks().dictionary_encode()
    return enc.dictionary, enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, type, moment) rows of a partition -> one row per (entity, type) and input chunk."""
    pending: list[pa.RecordBatch] = []
    rows = 0

    def reduce(chunk: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(chunk)
        (ents, ent), (types, type_) = _codes(t["entity"]), _codes(t["type"])
        moment = t["moment"].combine_chunks()
        known = moment.is_valid().to_numpy(zero_copy_only=False)
        at = moment.fill_null(0).to_numpy()
        width = max(len(types), 1)
        cells, n, last, first = _reduced(ent * width + type_, np.ones(t.num_rows), np.where(known, at, _NEVER), np.where(known, at, _ALWAYS))
        none = last == _NEVER
        return pa.RecordBatch.from_arrays(
            [ents.take(pa.array(cells // width)), types.take(pa.array(cells % width)), pa.array(n), pa.array(last, mask=none), pa.array(first, mask=none)],
            ["entity", "type", "n", "last", "first"],
        )

    for b in batches:
        pending.append(b)
        rows += b.num_rows
        if rows >= 500_000:
            yield reduce(pending)
            pending, rows = [], 0
    if rows:
        yield reduce(pending)


def _id_type(events: DataFrame, entity: str) -> str:
    return "string" if dict(events.dtypes)[entity] == "string" else "bigint"


def _partial_counts(events: DataFrame, entity: str, type_: str, moment: str) -> DataFrame:
    kind = _id_type(events, entity)
    rows = events.where(F.col(entity).isNotNull()).select(
        F.col(entity).cast(kind).alias("entity"), F.coalesce(F.col(type_), F.lit(NULL_TYPE)).alias("type"), F.col(moment).cast("bigint").alias("moment")
    )
    return rows.mapInArrow(_partials, f"entity {kind}, type string, n bigint, last bigint, first bigint")


def entity_type_counts(events: DataFrame, *, entity: str, type_: str, moment: str) -> DataFrame:
    """The long form: (entity, type, n, last, first), exact, with no bound on entities or types.

    Entities are whole numbers or strings. Defined cases: a null entity belongs to no row and
    is left out; a null type counts under ``NULL_TYPE``; a null moment counts but gives no
    recency; repeated rows count each.
    """
    partial = _partial_counts(events, entity, type_, moment)
    return partial.groupBy("entity", "type").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.min("first").alias("first"))


def type_vocabulary(counts: DataFrame, max_types: int = 20_000) -> list[str]:
    """All types in code-point order. Raises beyond ``max_types``."""
    got = [r[0] for r in counts.select("type").distinct().limit(max_types + 1).collect()]
    if len(got) > max_types:
        raise ValueError(f"more than {max_types} types: use the long form entity_type_counts")
    return sorted(got)


def _dense(types: list[str], kind: str, as_of: int):
    """Add up the partials of a bucket, ordered by entity, and scatter them into dense rows."""
    index = {t: i for i, t in enumerate(types)}
    width = len(types)
    id_type = pa.string() if kind == "string" else pa.int64()

    def emit(ids: np.ndarray, row: np.ndarray, col: np.ndarray, n: np.ndarray, last: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        size = len(ids) * width
        dense = np.bincount(row * width + col, weights=n, minlength=size).astype(np.int64)
        late = np.full(size, _NEVER, np.int64)
        np.maximum.at(late, row * width + col, last)
        seen = late > _NEVER
        since = np.where(seen, as_of - np.where(seen, late, 0), 0)
        offsets = pa.array(np.arange(0, size + 1, width, dtype=np.int32))
        ent_last = late.reshape(len(ids), width).max(axis=1)
        ent_first = np.full(len(ids), _ALWAYS, np.int64)
        np.minimum.at(ent_first, row, first)
        none = ent_last == _NEVER
        by_ent = dense.reshape(len(ids), width)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array(by_ent.sum(axis=1)), pa.array((by_ent > 0).sum(axis=1).astype(np.int32)),
             pa.array(ent_first, mask=none), pa.array(ent_last, mask=none), pa.array(as_of - np.where(none, 0, ent_last), mask=none),
             pa.ListArray.from_arrays(offsets, pa.array(dense)),
             pa.ListArray.from_arrays(offsets, pa.array(since, mask=~seen))],
            ["entity", "n_total", "n_types", "first_min", "last_min", "since_min", "n", "since"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # entities held, and their partials as cells (place of the entity * width + type)
        ids: list = []
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def all_held() -> tuple[np.ndarray, ...]:
            return _reduced(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for b in batches:
            if not b.num_rows:
                continue
            names, ent = _codes(pa.chunked_array([b.column("entity")]))
            told, type_ = _codes(pa.chunked_array([b.column("type")]))
            column = np.array([index[t] for t in told.to_pylist()], np.int64)[type_]
            # rows come ordered by entity: codes follow the order in which entities appear
            new = names.to_pylist()
            base = len(ids)
            if ids and new[0] == ids[-1]:
                base -= 1
                ids += new[1:]
            else:
                ids += new
            last, first = b.column("last"), b.column("first")
            held.append(((ent + base) * width + column, b.column("n").to_numpy(), last.fill_null(_NEVER).to_numpy(), first.fill_null(_ALWAYS).to_numpy()))
            rows += b.num_rows
            if len(ids) > BLOCK:
                cells, n, last, first = all_held()
                # whole entities only: the last one may go on in the next batch
                done = len(ids) - 1
                for lo in range(0, done - done % BLOCK, BLOCK):
                    mine = (cells >= lo * width) & (cells < (lo + BLOCK) * width)
                    yield emit(ids[lo : lo + BLOCK], cells[mine] // width - lo, cells[mine] % width, n[mine], last[mine], first[mine])
                left = done - done % BLOCK
                rest = cells >= left * width
                held, ids = [(cells[rest] - left * width, n[rest], last[rest], first[rest])], ids[left:]
                rows = int(rest.sum())
            elif rows > HELD:
                held = [all_held()]
                rows = len(held[0][0])
        if ids:
            cells, n, last, first = all_held()
            for lo in range(0, len(ids), BLOCK):
                mine = (cells >= lo * width) & (cells < (lo + BLOCK) * width)
                yield emit(ids[lo : lo + BLOCK], cells[mine] // width - lo, cells[mine] % width, n[mine], last[mine], first[mine])

    return run


def entity_features(
    events: DataFrame, *, entity: str, type_: str, moment: str, as_of: int | None = None, types: list[str] | None = None
) -> DataFrame:
    """One row per entity: totals, and for every type of the vocabulary its count and the minutes since the last one.

    Columns: entity, n_total, n_types, first_min, last_min, since_min, and ``n`` / ``since`` as
    arrays in the order of ``types`` (default: all types in code-point order, with null as
    ``NULL_TYPE``). ``moment`` is in minutes since 1970; ``as_of`` defaults to the latest
    moment of all rows. An entity without any known moment has null recency; ``n`` is 0 and
    ``since`` null for types it never did. An empty table gives an empty result.
    """
    kind = _id_type(events, entity)
    partial = _partial_counts(events, entity, type_, moment)
    if types is None or as_of is None:
        # read twice: for the vocabulary and for the rows; one pass over the events
        partial = cut(partial)
    if types is None:
        types = type_vocabulary(partial)
    if as_of is None:
        as_of = partial.agg(F.max("last")).first()[0] or 0
    schema = f"entity {kind}, n_total bigint, n_types int, first_min bigint, last_min bigint, since_min bigint, n array<bigint>, since array<bigint>"
    ordered = partial.repartition("entity").sortWithinPartitions("entity")
    return ordered.mapInArrow(_dense(types, kind, as_of), schema).withColumnRenamed("entity", entity)


def vocabulary_table(events: DataFrame, type_: str) -> DataFrame:
    """(place, type): what stands at each place, from 0, of the arrays of ``entity_features``; a null type is ``NULL_TYPE``."""
    got = events.select(F.coalesce(F.col(type_), F.lit(NULL_TYPE)).alias("type")).distinct()
    # bounded like the vocabulary itself: the arrays of a row are as long
    return got.select((F.row_number().over(Window.orderBy(F.col("type").cast("binary"))) - 1).cast("int").alias("place"), "type")
