"""Visually identical text with different characters: one consistent form, and copies of known posts.

Method: DuckDB runs inside every Arrow partition. Embedded SQL folds compatibility forms,
invisible characters, spaces and look-alike letters (``nfc_normalize``, ``translate``,
regular expressions; see ``charforms``). Texts are made distinct inside a batch first, as
one text stands in many rows and in several fields. The known posts are folded once and
go to the tasks as skeletons, without a shuffle, if they are within ``max_posts`` and
``max_chars``; more of them are joined by their skeletons, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .charforms import duckdb_setup, fold_sql


def _connect():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    con.execute("SET preserve_insertion_order = false")
    duckdb_setup(con)
    return con


def _arrow(result) -> pa.Table:
    return result.to_arrow_table()


def consistent_form(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` with ``{field}_form`` for each text field.

    Texts that read the same get the same form, others different ones. Null stays null, an
    empty text empty; columns that were there under these names are replaced; a text of only invisible characters becomes empty.
    """
    rows = rows.drop(*[f"{f}_form" for f in fields])
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"{f}_form", T.StringType()) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(n) for n in names]
            for f in fields:
                enc = b.column(f).cast(pa.string()).dictionary_encode()
                texts = pa.table({"i": pa.array(range(len(enc.dictionary)), pa.int64()), "s": enc.dictionary})
                con.register("texts", texts)
                got = _arrow(con.sql(f"SELECT i, form_show(sk) AS f FROM ({fold_sql('texts')})")).sort_by("i")
                con.unregister("texts")
                forms = got["f"].combine_chunks().cast(pa.string())
                cols.append(forms.take(enc.indices))
            yield pa.RecordBatch.from_arrays(cols, [*names, *(f"{f}_form" for f in fields)])

    return rows.mapInArrow(run, schema)


def _skeletons(texts: pa.Table) -> pa.Table:
    """(i, s, sk) of a table (i, s)."""
    con = _connect()
    con.register("known", texts.rename_columns(["i", "s"]))
    return _arrow(con.sql(f"SELECT i, s, sk FROM ({fold_sql('known')})"))


def _with_skeleton(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` (..., text) with ``sk``, the skeleton of ``text``, folded in Arrow partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        for b in batches:
            if not b.num_rows:
                continue
            enc = b.column("text").cast(pa.string()).dictionary_encode()
            con.register("texts", pa.table({"i": pa.array(range(len(enc.dictionary)), pa.int64()), "s": enc.dictionary}))
            got = _arrow(con.sql(f"SELECT i, sk FROM ({fold_sql('texts')})")).sort_by("i")
            con.unregister("texts")
            sk = got["sk"].combine_chunks().cast(pa.string()).take(enc.indices)
            yield pa.RecordBatch.from_arrays([*b.columns, sk], [*b.schema.names, "sk"])

    return rows.mapInArrow(run, f"{schema}, sk string")


def _join_copies(rows: DataFrame, key: str, fields: list[str], posts: DataFrame, item: str, text: str) -> DataFrame:
    """``find_copies`` for posts of any number: both sides by their skeletons, equal texts of a field once."""
    long = rows.select(F.col(key).cast("bigint").alias(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x")).select(key, "x.field", "x.text").where("text is not null")
    folded = _with_skeleton(long.select("text").distinct(), "text string").select("text", "sk")
    known = _with_skeleton(posts.where(F.col(text).isNotNull()).select(F.col(item).cast("bigint").alias(item), F.col(text).alias("text")), f"{item} bigint, text string").withColumnRenamed("text", "post")
    same = folded.join(known, "sk").where("text <> post").select("text", item)
    return long.join(same, "text").select(key, "field", item)


def find_copies(rows: DataFrame, key: str, fields: list[str], posts: DataFrame, *, item: str = "item_id", text: str = "post_text", max_posts: int = 100_000, max_chars: int = 16_000_000) -> DataFrame:
    """(key, field, item): the whole field reads the same as a post but is not the same string.

    Null fields are never a case. Two posts that read the same are both reported, unless the
    field is an exact copy of that post. Posts beyond ``max_posts`` or ``max_chars`` are joined
    by their skeletons instead of being sent to the tasks; the rows are the same.
    """
    known = posts.where(F.col(text).isNotNull()).select(item, text)
    n, chars = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    if n > max_posts or chars > max_chars:
        return _join_copies(rows, key, fields, posts, item, text)
    sink = pa.BufferOutputStream()
    folded = _skeletons(known.toArrow())
    with pa.ipc.new_stream(sink, folded.schema) as w:
        w.write_table(folded)
    packed = sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        con.register("known", pa.ipc.open_stream(packed).read_all())
        con.execute("CREATE TABLE posts AS SELECT i AS item, s AS post, sk FROM known")
        con.unregister("known")
        for b in batches:
            if not b.num_rows:
                continue
            for f in fields:
                enc = b.column(f).cast(pa.string()).dictionary_encode()
                if not len(enc.dictionary):
                    continue
                texts = pa.table({"i": pa.array(range(len(enc.dictionary)), pa.int64()), "s": enc.dictionary})
                con.register("texts", texts)
                hits = _arrow(con.sql(f"SELECT t.i, p.item FROM ({fold_sql('texts')}) t JOIN posts p ON p.sk = t.sk WHERE t.s <> p.post"))
                con.unregister("texts")
                if not hits.num_rows:
                    continue
                rows_of = pa.table({"i": enc.indices.cast(pa.int64()), "key": b.column(key)}).filter(pa.compute.is_in(enc.indices.cast(pa.int64()), value_set=hits["i"].combine_chunks()))
                out = rows_of.join(hits, "i", join_type="inner")
                out = pa.table({key: out["key"].cast(pa.int64()), "field": pa.array([f] * out.num_rows, pa.string()), item: out["item"].cast(pa.int64())})
                yield from out.combine_chunks().to_batches()

    return rows.select(key, *fields).mapInArrow(run, f"{key} bigint, field string, {item} bigint")
