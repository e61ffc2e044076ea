"""Holds a query against its SQL on the same tables."""

from pathlib import Path

import duckdb


def connection(folder):
    c = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


def assert_same(spark, folder, query, sql):
    got, want = query(spark, folder).toPandas(), connection(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
