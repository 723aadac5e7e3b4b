import numbers

import duckdb
import pandas as pd

import __spark_entry__ as entry


def _norm(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    return sorted(tuple("~" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else str(round(float(v), 6)) if isinstance(v, numbers.Number) else str(list(v)) if hasattr(v, "tolist") and hasattr(v, "__len__") else str(v) for v in r) for r in df[cols].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_sql_twins(spark, data):
    import os

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    bad = []
    for name, text in sql.items():
        got, want = qs[name](spark, data).toPandas(), con.execute(text).df()
        if sorted(got.columns) != sorted(want.columns) or _norm(got) != _norm(want):
            bad.append(name)
    assert not bad
